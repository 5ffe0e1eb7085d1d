"""Source texts with comments and literals blanked, by one regular expression a language over the whole text."""

from __future__ import annotations

import re
from collections.abc import Callable

# File suffixes by language.
SUFFIXES = {
    "python": (".py",),
    "js": (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".html"),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".hpp", ".cc", ".cxx", ".hh"),
    "csharp": (".cs",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "go": (".go",),
    "rust": (".rs",),
    "php": (".php", ".phtml"),
    "ruby": (".rb", ".rake", ".gemspec"),
    "shell": (".sh", ".bash", ".zsh"),
    "cobol": (".cbl", ".cob", ".cpy"),
    "fortran": (".f90", ".f95", ".f03", ".f08", ".pf"),
    "fortran_fixed": (".f", ".for", ".ftn"),
}


def language_of(path: str) -> str | None:
    low = path.lower()
    return next((name for name, ends in SUFFIXES.items() if low.endswith(ends)), None)


def blanked(text: str) -> str:
    """As many spaces, line breaks kept."""
    return re.sub(r"[^\n]", " ", text)


_BLOCK, _LINE = r"/\*.*?(?:\*/|\Z)", r"//[^\n]*"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_NESTED = r"/\*(?:(?!/\*|\*/).)*(?:/\*(?:(?!\*/).)*\*/(?:(?!/\*|\*/).)*)*(?:\*/|\Z)"
#: A slash begins a regular expression behind an operator, an opening bracket, a word that an expression follows, or the head of a condition.
_REGEX = r"(?P<before>(?:[({\[,;:!&|?+\-*%=<>~^]|\b(?:return|typeof|case|in|of|do|else|yield|await|new|delete|void|throw)|\b(?:if|while|for|switch|catch)\s*\([^()\n]*\)|^)[ \t]*)(?P<regex>/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[dgimsuvy]*)"

_SOURCES = {
    "js": (_BLOCK, _LINE, _REGEX, _DOUBLE, _SINGLE, r"`(?:\\.|[^`\\])*(?:`|\Z)"),
    "java": (_BLOCK, _LINE, r'""".*?(?:"""|\Z)', _DOUBLE, _SINGLE),
    "c": (_BLOCK, _LINE, _DOUBLE, _SINGLE),
    "cpp": (_BLOCK, _LINE, r'R"(?P<tag>[^(\s]*)\(.*?(?:\)(?P=tag)"|\Z)', _DOUBLE, r"(?<![0-9a-fA-F])'(?:\\.|[^'\\\n])*'?"),
    "csharp": (_BLOCK, _LINE, r'\$*"""+.*?(?:"""+|\Z)', r'(?:\$@|@\$|@)"(?:""|[^"])*(?:"|\Z)', _DOUBLE, _SINGLE),
    "swift": (_NESTED, _LINE, r'(?P<hash>#*)""".*?(?:"""(?P=hash)|\Z)', r'(?P<one>#+)"[^\n]*?"(?P=one)', _DOUBLE),
    "kotlin": (_NESTED, _LINE, r'""".*?(?:"""+|\Z)', _DOUBLE, _SINGLE),
    "go": (_BLOCK, _LINE, _DOUBLE, _SINGLE, r"`[^`]*(?:`|\Z)"),
    "rust": (_NESTED, _LINE, r'b?r(?P<hash>#*)".*?(?:"(?P=hash)|\Z)', r'b?"(?:\\.|[^"\\])*(?:"|\Z)', r"b?'(?:\\[^\n]*?|[^'\\\n])'"),
    "php": (_BLOCK, _LINE, r"#(?!\[)[^\n]*", r"<<<[ \t]*['\"]?(?P<doc>\w+)['\"]?\n.*?(?:\n[ \t]*(?P=doc)\b|\Z)", r'"(?:\\.|[^"\\])*(?:"|\Z)', r"'(?:\\.|[^'\\])*(?:'|\Z)"),
    "ruby": (r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)", r"(?<![\w$])#(?!\{)[^\n]*", r"<<[~-]?['\"]?(?P<doc>[A-Z_]+)['\"]?(?P<rest>[^\n]*\n).*?(?:^[ \t]*(?P=doc)\b|\Z)", _DOUBLE, _SINGLE, r"%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})"),
    "python": (r"#[^\n]*", r"(?P<prefix>(?:\b[rbfuRBFU]{1,2})?)(?P<quote>\"\"\"|'''|\"|')"),
    "fortran": (r"![^\n]*", r"'(?:[^'\n]|'')*'?", r'"(?:[^"\n]|"")*"?'),
}
_FLAGS = re.DOTALL | re.MULTILINE
PATTERNS = {name: re.compile("|".join(f"(?:{x})" for x in parts), _FLAGS) for name, parts in _SOURCES.items()}


def _regular(text: str, language: str) -> str:
    def blank(m: re.Match) -> str:
        found = m.groupdict()
        if found.get("regex"):
            return m["before"] + blanked(m["regex"])
        if found.get("doc") and found.get("rest") is not None:  # code goes on behind the name of a here-document
            at = m.end("rest") - m.start()
            return blanked(m[0][: m.start("rest") - m.start()]) + m["rest"] + blanked(m[0][at:])
        return blanked(m[0])

    return PATTERNS[language].sub(blank, text)


def _python(text: str) -> str:
    """Strings blanked but for the expressions inside f-strings."""
    out, at = [], 0
    while m := PATTERNS["python"].search(text, at):
        out.append(text[at : m.start()])
        if m[0].startswith("#"):
            out.append(blanked(m[0]))
            at = m.end()
            continue
        quote, live = m["quote"], "f" in m["prefix"].lower()
        out.append(blanked(m[0]))
        at, depth = m.end(), 0
        while at < len(text):
            c = text[at]
            if not depth and text.startswith(quote, at):
                out.append(blanked(quote))
                at += len(quote)
                break
            if c == "\n" and len(quote) == 1 and not text[at - 1] == "\\":
                break
            if live and not depth and text[at : at + 2] in ("{{", "}}"):
                step, keep = 2, False
            elif live and c in "{}":
                depth = max(0, depth + (1 if c == "{" else -1))
                step, keep = 1, False
            elif c == "\\" and not depth:
                step, keep = 2, False  # a raw string, too, does not end at an escaped quote
            else:
                step, keep = 1, bool(depth)
            piece = text[at : at + step]
            out.append(piece if keep else blanked(piece))
            at += step
    out.append(text[at:])
    return "".join(out)


def _php(text: str) -> str:
    """Code stands between <?php (or <?=) and ?> alone."""
    out, at = [], 0
    for m in re.finditer(r"<\?(?:php\b|=)(.*?)(?:\?>|\Z)", text, re.DOTALL):
        out.append(blanked(text[at : m.start(1)]))
        out.append(_regular(m[1], "php"))
        at = m.end(1)
    out.append(blanked(text[at:]))
    return "".join(out)


def _shell(text: str) -> str:
    """Comments, here-documents and what stands in quotes; the quotes stay, as they are part of a word."""
    out, at = [], 0
    pattern = re.compile(r"(?P<comment>(?:(?<=^)|(?<=[\s;&|(]))#[^\n]*)|(?P<doc><<-?[ \t]*(?P<mark>['\"]?)(?P<name>\w+)(?P=mark)(?P<rest>[^\n]*\n)(?P<body>.*?)(?P<end>^[ \t]*(?P=name)[ \t]*$|\Z))|(?P<escaped>\\.)|(?P<single>'[^']*(?:'|\Z))|(?P<double>\"(?:\\.|[^\"\\])*(?:\"|\Z))", _FLAGS)
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        if m["comment"] is not None:
            out.append(blanked(m[0]))
        elif m["doc"] is not None:
            out.append(text[m.start() : m.start("body")] + blanked(m["body"]) + blanked(m["end"]))
        elif m["escaped"] is not None:
            out.append(m[0])
        else:
            inner = m[0][1:-1] if len(m[0]) > 1 and m[0][-1] == m[0][0] else m[0][1:]
            out.append(m[0][0] + blanked(inner) + m[0][1 + len(inner) :])
        at = m.end()
    out.append(text[at:])
    return "".join(out)


def _fortran_fixed(text: str) -> str:
    """Cards: one statement a line, continued ones joined to the line they continue; labels stay in front, columns from 73 on go."""
    lines, parent = text.split("\n"), None
    out = [""] * len(lines)
    for i, line in enumerate(lines):
        if not line.strip() or line[0] in "Cc*!":
            continue
        mark, body = line[5:6], f"{line[:5]} {line[6:72]}"
        if mark.strip() and mark != "0" and parent is not None:
            out[parent] = f"{out[parent].rstrip()} {line[6:72].strip()}"
        elif body.strip():
            out[i], parent = body, i
    return _regular("\n".join(out), "fortran")


def is_cards(lines: list[str]) -> bool:
    """Fixed form: nine in ten of three or more lines of over six columns have a sequence area and an indicator as cards have them."""
    long = [x for x in lines if len(x.rstrip()) > 6]
    cards = [x for x in long if re.match(r"(?:\d{6}| {6})[ *\-/dD$]", x)]
    return len(long) >= 3 and len(cards) * 10 >= len(long) * 9


def _cobol(text: str) -> str:
    """Comments, literals, and all that stands outside a PROCEDURE DIVISION; cards lose their sequence area and what follows column 72."""
    lines = text.split("\n")
    cards, inside, out = is_cards(lines), False, []
    for line in lines:
        if cards:
            line = (" " * 7 if line[6:7] in ("*", "/") else " " * 6 + " ") + ("" if line[6:7] in ("*", "/") else line[7:72])
        elif line.lstrip().startswith("*"):
            line = ""
        line = re.sub(r"\*>.*", lambda m: " " * len(m[0]), line)
        line = re.sub(r"'(?:[^']|'')*'?|\"(?:[^\"]|\"\")*\"?", lambda m: " " * len(m[0]), line)
        if re.match(r"\s*(?:IDENTIFICATION|ID|ENVIRONMENT|DATA)\s+DIVISION\b", line, re.I):
            inside = False
        out.append(line if inside else "")
        if re.match(r"\s*PROCEDURE\s+DIVISION\b", line, re.I):
            inside = True
            out[-1] = line
    return "\n".join(out)


_SPECIAL: dict[str, Callable[[str], str]] = {"python": _python, "php": _php, "shell": _shell, "fortran_fixed": _fortran_fixed, "cobol": _cobol}


def masked(text: str, language: str | None) -> str:
    """The text with comments and literals blanked, line by line as long as it was (cards excepted); unknown languages as C."""
    if language in _SPECIAL:
        return _SPECIAL[language](text)
    return _regular(text, language if language in PATTERNS else "c")
