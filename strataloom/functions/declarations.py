"""Declarations of a source file: where they begin and end, what they are called, how complex they are.

Brackets of the masked text are matched once; a declaration is a head at the beginning of a line and what its own
brackets hold. Bodies of functions are stepped over (but in JavaScript and Python, whose nested functions count), types
and what is only walked through are entered.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from typing import NamedTuple

from . import lexing, streams

NAME = r"[A-Za-z_$][\w$]*"
HEADER = 12  # lines in which the body of a declaration has to open


class Declaration(NamedTuple):
    start: int
    end: int
    name: str
    kind: str


class Source:
    """Masked text with its lines and the partner of each bracket."""

    def __init__(self, text: str, language: str | None, prepared: str | None = None) -> None:
        self.text, self.language = text, language
        self.masked = lexing.masked(text, language)
        self.code = prepared if prepared is not None else self.masked
        self.lines = self.masked.split("\n")
        self.starts = [0]
        for line in self.lines[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.partner: dict[int, int] = {}
        open_: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c, at = m[0], m.start()
            if c in "([{":
                open_.append(at)
                continue
            want = "([{"[")]}".index(c)]
            if c == "}" and any(self.code[x] == want for x in open_):
                while self.code[open_[-1]] != want:  # a bracket that was never closed
                    open_.pop()
            if open_ and self.code[open_[-1]] == want:
                self.partner[open_.pop()] = at

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def indented_end(self, line: int) -> int:
        """The last line of what is indented under a line; a closing bracket at its own depth belongs to it."""
        width = lambda x: len(x) - len(x.lstrip())
        lines = self.text.split("\n")
        base = width(lines[line - 1])
        for k in range(line, len(lines)):
            if lines[k].strip() and width(lines[k]) <= base:
                return k + 1 if lines[k].lstrip()[0] in "}])" else k
        return len(lines)

    def extent(self, line: int, at: int) -> tuple[int, int | None, bool]:
        """(last line, place of the body's opening brace, has a body or a value) of the declaration whose head ends at ``at``."""
        arrow, limit = False, self.starts[min(line + HEADER, len(self.starts)) - 1] if line + HEADER <= len(self.starts) else len(self.code)
        while at < limit:
            c = self.code[at]
            if c in "([":
                if at not in self.partner:
                    return self.indented_end(line), None, True
                at = self.partner[at]
            elif c == "{":
                if at not in self.partner:
                    return max(line, self.indented_end(line)), at, True
                close = self.partner[at]
                rest = self.code[close + 1 : self.code.find("\n", close) if "\n" in self.code[close:] else len(self.code)]
                if "{" in rest and not arrow and rest.lstrip()[:1] not in (";", ",", "}"):  # the literal type of a result
                    at = close
                else:
                    return self.line_of(close), at, True
            elif c == ";":
                return self.line_of(at), None, arrow
            elif c == "}" or (c == "," and arrow):
                return self.line_of(at - 1) if c == "," else max(line, self.line_of(at) - 1), None, arrow
            elif self.code.startswith("=>", at):
                arrow = True
                at += 1
            at += 1
        return line, None, arrow


def _without_angles(text: str) -> str:
    """Balanced angle brackets of a line blanked, so that type arguments are no syntax."""
    out, open_ = list(text), []
    for i, c in enumerate(text):
        if c == "\n":
            open_ = []
        elif c == "<":
            open_.append(i)
        elif c == ">" and open_ and (i == 0 or text[i - 1] not in "-="):
            for k in range(open_.pop(), i + 1):
                out[k] = " "
    return "".join(out)


def _rx(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("NAME", NAME))


# Words that look like the name of a member, by language.
NOT_MEMBERS = {
    "js": set("await case catch for function if return switch throw typeof while with".split()),
    "java": set("if for while switch catch return new super this do else synchronized throw assert yield".split()),
    "c": set("if for while switch return sizeof do else case default goto typedef defined".split()),
    "cpp": set("if for while switch return sizeof do else case default goto typedef catch throw new delete using static_assert decltype alignas noexcept requires".split()),
    "csharp": set("if for foreach while switch catch return new using lock fixed else do throw get set add remove init when base this nameof typeof".split()),
}
_MODIFIERS = {
    "js": r"(?:(?:export|default|declare|abstract|async|const|let|var|override|public|private|protected|static|readonly|get|set)\s+)*",
    "java": r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|strictfp|default|transient|volatile|sealed|non-sealed)\s+)*",
    "csharp": r"(?:(?:public|protected|private|internal|static|sealed|abstract|virtual|override|async|partial|readonly|unsafe|extern|new|ref|file|required)\s+)*",
    "swift": r"(?:(?:@\w+(?:\([^)]*\))?|public|private|fileprivate|internal|open|static|class(?=\s+(?:func|var|subscript))|final|override|mutating|nonmutating|convenience|required|indirect|lazy|weak|nonisolated|isolated|async|prefix|postfix|infix|(?:private|public|internal)\(set\))\s+)*",
    "kotlin": r"(?:(?:@\w+(?:\([^)]*\))?|public|private|protected|internal|open|abstract|final|override|inline|infix|operator|suspend|tailrec|external|data|sealed|enum|annotation|inner|value|const|lateinit|actual|expect|fun(?=\s+interface))\s+)*",
    "rust": r"(?:(?:pub(?:\([^)]*\))?|default|const|async|unsafe|extern(?:\s+\"[^\"]*\"|\s+)?)\s+)*",
    "php": r"(?:(?:public|protected|private|static|final|abstract|readonly)\s+)*",
}
# (pattern behind the modifiers, kind): None as kind is walked through, "span" names members, "skip" is stepped over, "method" needs parameters and a body.
_HEADS = {
    "js": [(r"class\s+(NAME)\b", "class"), (r"(?:interface\s+NAME|type\s+NAME[^=\n]*=)", "skip"), (r"function\s*\*?\s*(NAME)\s*(?=[<(])", "function"), (r"#?(NAME)\s*(?::[^=;\n]*)?=\s*(?=(?:async\s+)?(?:function\b|NAME\s*=>|(?:<[^()\n]*>\s*)?\())", "value"), (r"(NAME)\s*:\s*(?=(?:async\s+)?(?:function\b|NAME\s*=>|\())", "value"), (r"\*?\s*(#?NAME)\s*(?:<[^()\n]*>\s*)?(?=\()", "method")],
    "java": [(r"(?:class|interface|enum|record|@interface)\s+(NAME)\b", "class"), (r"(?:[\w$.\[\]]+\s+)?(NAME)\s*(?=\()", "signature")],
    "c": [(r"(?:typedef\s+)?(?:struct|enum|union)\s+(NAME)\s*(?=\{|$)", "leaf"), (r"(?!return\b|else\b|typedef\b)(?:[A-Za-z_][\w]*[\s*]+)+(NAME)\s*(?=\()", "method")],
    "cpp": [(r"(?:inline\s+)?namespace\b[^;{=]*(?=\{|$)", None), (r"extern\s+", None), (r"(?:enum\s+class|enum\s+struct|class|struct|union|enum)\s+(?:\[\[[^\]]*\]\]\s*)?(NAME)\b(?!\s*[;*&(])", "class"), (r"(?!return\b|else\b|typedef\b|using\b)(?:[A-Za-z_][\w:]*(?:\s+|\s*[*&]+\s*))*((?:NAME::)*(?:~?NAME|operator\s*(?:\(\)|\[\]|[^\s\w(]+|\w+)))\s*(?=\()", "method")],
    "csharp": [(r"namespace\s+[\w.]+", None), (r"(?:class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(NAME)\b", "class"), (r"(?:[\w$.\[\]?,]+\s+)?(?:NAME\.)*(NAME)\s*(?=\()", "method")],
    "swift": [(r"extension\s+([\w.]+)", "span"), (r"(?:class|struct|enum|protocol|actor)\s+(NAME)\b", "class"), (r"func\s+(NAME|[^\s\w(]+)\s*(?=[<(])", "function"), (r"(init|deinit|subscript)\b[?!]?", "function")],
    "kotlin": [(r"companion\s+object\b(?:\s+(NAME))?", "companion"), (r"(?:class|interface|object)\s+(NAME)\b", "class"), (r"fun\s+(?:<[^>]*>\s*)?((?:NAME(?:<[^>]*>)?\??\.)?NAME)\s*(?=[<(])", "fun"), (r"(constructor)\s*(?=\()", "function"), (r"(init)\s*(?=\{)", "function")],
    "go": [(r"type\s+(NAME)(?:\[[^\]]*\])?\s+(?:struct|interface)\b", "class"), (r"func\s*\(\s*(?:NAME\s+)?\*?(?P<of>NAME)(?:\[[^\]]*\])?\s*\)\s*(?P<own>NAME)\s*(?=[\[(])", "function"), (r"func\s+(NAME)\s*(?=[\[(])", "function")],
    "rust": [(r"impl\b\s*(?:[^{;\n]*?\bfor\s+)?&?(?:\w+::)*(NAME)", "span"), (r"mod\s+NAME", None), (r"fn\s+(NAME)\b", "function"), (r"(?:struct|enum|trait|union)\s+(NAME)\b", "class")],
    "php": [(r"(?:class|interface|trait|enum)\s+(NAME)\b", "class"), (r"function\s+&?\s*(NAME)\s*(?=\()", "function")],
}
HEADS = {lang: [(_rx(r"[ \t]*" + _MODIFIERS.get(lang, "") + p), kind) for p, kind in heads] for lang, heads in _HEADS.items()}
#: Between a container and its member.
JOINER = {"swift": ".", "rust": "::", "php": "::"}


def _prepared(masked: str, language: str) -> str:
    if language in ("java", "csharp", "kotlin", "cpp", "rust"):
        masked = _without_angles(masked)
    if language == "java":
        masked = re.sub(r"(?m)^([ \t]*(?:@(?!interface\b)[\w.]+(?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\))?[ \t]*)+)", lambda m: " " * len(m[0]), masked)
    elif language == "csharp":
        masked = re.sub(r"(?m)^([ \t]*(?:\[[^\]\n]*\][ \t]*)+)", lambda m: " " * len(m[0]), masked)
    elif language == "cpp":
        masked = re.sub(r"(?m)^([ \t]*template\b)", lambda m: " " * len(m[0]), masked)
    elif language == "rust":
        masked = re.sub(r"(?m)^([ \t]*#!?\[[^\]\n]*\])", lambda m: " " * len(m[0]), masked)
    return masked


def _accepted(source: Source, kind: str, name: str, at: int) -> bool:
    """Whether a head that calls share is a declaration: its parameters are closed and a body, for Java also a semicolon, follows."""
    code = source.code
    if name in NOT_MEMBERS.get(source.language, ()):
        return False
    if kind == "value":
        start = re.compile(r"\s*(?:async\s+)?(?:<[^()\n]*>\s*)?").match(code, at).end()
        if code[start : start + 1] != "(":
            return True
        if start not in source.partner:
            return True
        return bool(re.compile(r"\s*(?::[^=;{]*?)?=>").match(code, source.partner[start] + 1))
    if at not in source.partner:
        return True
    tail = code[source.partner[at] + 1 :]
    if kind == "signature":
        return bool(re.match(r"\s*(?:\{|throws\b|;)", tail))
    if source.language == "js":
        return bool(re.match(r"\s*(?::[^;={]*(?:\{[^{}]*\}[^;={]*)?)?\{", tail))
    if source.language == "csharp":
        return bool(re.match(r"\s*(?:where\b[^{;]*|:\s*(?:base|this)\s*\([^)]*\)\s*)?(?:\{|=>)", tail))
    return bool(re.match(r"\s*(?:(?:const|noexcept|override|final|volatile|&{1,2}|try|->[^{;=]*|__attribute__\s*\(\(.*?\)\))\s*(?:\([^)]*\))?\s*)*(?::[^;{]*(?:\{[^{}]*\}\s*,?[^;{]*)*)?\{", tail))


def of_braces(text: str, language: str) -> tuple[list[Declaration], Source]:
    source = Source(text, language, _prepared(lexing.masked(text, language), language))
    heads, found, spans, line = HEADS[language], [], [], 1
    while line <= len(source.lines):
        start = source.starts[line - 1]
        step = line + 1
        if not (language in ("c", "cpp") and source.lines[line - 1].lstrip().startswith("#")):
            for rx, kind in heads:
                m = rx.match(source.code, start, start + len(source.lines[line - 1]))
                if m is None:
                    continue
                own = m.groupdict()
                name = f"{own['of']}.{own['own']}" if own.get("of") else (m[1] if m.re.groups else "") or ("Companion" if kind == "companion" else "")
                if kind in ("value", "method", "signature") and not _accepted(source, kind, name, m.end()):
                    continue
                if language == "cpp" and kind is None and m[0].strip() == "extern" and "{" not in source.lines[line - 1]:
                    break
                end, brace, body = source.extent(line, m.end())
                if kind == "fun" and brace is None and re.search(r"=(?!=)", source.code[m.end() : source.starts[line] if line < len(source.starts) else None]):
                    end, body = max(line, source.indented_end(line)), True
                end = max(end, line)
                if kind is None:
                    break
                if kind == "skip":
                    step = end + 1
                    break
                if kind == "span":
                    spans.append((line, end, name))
                    break
                if not body and kind != "signature":
                    step = line + 1 if language == "js" else end + 1
                    break
                shown = "class" if kind in ("class", "leaf", "companion") else "function"
                found.append(Declaration(line, end, name, shown))
                if language == "php" and kind == "class":
                    spans.append((line, end, name))
                if shown == "function" or kind == "leaf":
                    step = line + 1 if language == "js" else end + 1
                break
        line = step
    if language == "rust":
        spans += [(d.start, d.end, d.name) for d in found if d.kind == "class"]
    if language in JOINER:
        found = [qualified(d, spans, JOINER[language]) for d in found]
    return found, source


def qualified(d: Declaration, spans: list[tuple[int, int, str]], joiner: str) -> Declaration:
    """Named for the innermost span around it, functions alone."""
    around = [s for s in spans if s[0] < d.start and d.end <= s[1] and s[2]]
    return d._replace(name=f"{max(around)[2]}{joiner}{d.name}") if d.kind == "function" and around else d


def of_python(text: str) -> tuple[list[tuple[Declaration, int | None]], Source]:
    source = Source(text, "python")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        found = []
        for i, line in enumerate(source.lines, 1):
            if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line):
                found.append((Declaration(i, max(i, source.indented_end(i)), m[2], "class" if m[1] == "class" else "function"), None))
        return found, source
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    nodes = sorted((x for x in ast.walk(tree) if isinstance(x, kinds)), key=lambda x: (x.lineno, x.end_lineno))
    return [(Declaration(x.lineno, x.end_lineno, x.name, "class" if isinstance(x, ast.ClassDef) else "function"), 0 if isinstance(x, ast.ClassDef) else streams.of_python(x)) for x in nodes], source


def of_ruby(text: str) -> tuple[list[Declaration], Source]:
    """Openers and their ``end``; a method of a class is Class#name, one of the class itself Class.name."""
    source, found, open_ = Source(text, "ruby"), [], []
    head = re.compile(r"\s*(class|module|def)\s+(?:<<\s*)?((?:self\.)?[\w:]+[?!=]?|[^\s\w(]+)")
    opener = re.compile(r"(?:^|[=(,]|\breturn\b|;)\s*(?:if|unless|while|until|case|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|(?:^|;)\s*(?:class|module)\b")
    for i, line in enumerate(source.lines, 1):
        m = head.match(line)
        if m and m[1] == "def":
            owner = next((n for k, n, _ in reversed(open_) if k in ("class", "module")), None)
            name = m[2].removeprefix("self.")
            full = f"{owner}{'.' if m[2].startswith('self.') else '#'}{name}" if owner else name
            if re.match(r"\s*def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s", line):
                found.append(Declaration(i, i, full, "function"))
                continue
            open_.append(("def", full, i))
            if re.search(r";\s*end\s*$", line):
                k, n, s = open_.pop()
                found.append(Declaration(s, i, n, "function"))
            continue
        loop = re.match(r"\s*(?:while|until|for)\b", line)
        opens = len(opener.findall(line)) - bool(loop and re.search(r"\bdo\s*$", line))
        ends = len(re.findall(r"(?<![\w.:@$])end\b(?!\s*[:=])", line))
        if m:
            open_.append((m[1], m[2], i))
            opens -= 1
        open_ += [("block", "", i)] * max(0, opens)
        for _ in range(min(ends, len(open_))):
            k, n, s = open_.pop()
            if k != "block":
                found.append(Declaration(s, i, n, "function" if k == "def" else "class"))
    found += [Declaration(s, max(s, source.indented_end(s)), n, "function" if k == "def" else "class") for k, n, s in open_ if k != "block"]
    return sorted(found), source


def of_shell(text: str) -> tuple[list[Declaration], Source]:
    source, found, line = Source(text, "shell"), [], 1
    head = re.compile(r"[ \t]*(?:function\s+([\w:.+-]+)\s*(?:\(\s*\))?|([\w:.+-]+)\s*\(\s*\))\s*")
    while line <= len(source.lines):
        m = head.match(source.code, source.starts[line - 1])
        step = line + 1
        if m and (brace := re.compile(r"\s*([{(])").match(source.code, m.end())) and source.line_of(brace.start(1)) - line <= HEADER:
            close = source.partner.get(brace.start(1))
            end = source.line_of(close) if close else max(line, source.indented_end(line))
            found.append(Declaration(line, end, m[1] or m[2], "function"))
            step = end + 1
        line = step
    return found, source


# Statements of COBOL that stand alone on a line as a paragraph's name does.
COBOL_WORDS = set("EXIT GOBACK STOP CONTINUE EJECT SKIP1 SKIP2 SKIP3 ELSE DECLARATIVES".split())


def of_cobol(text: str) -> tuple[list[Declaration], Source]:
    """Paragraphs in area A of the procedure division; sections and END PROGRAM end them."""
    source = Source(text, "cobol")
    cards = lexing.is_cards(text.split("\n"))
    first, marks = (7 if cards else 0), []
    for i, line in enumerate(source.lines, 1):
        area = line[first : first + 4].strip() if cards else line[:4].strip() and line[:1].strip()
        if not area:
            continue
        word = line.strip().rstrip(".").upper()
        if re.match(r"\s*(?:END\s+(?:PROGRAM|DECLARATIVES)|PROCEDURE\s+DIVISION|[\w-]+\s+SECTION)\b", line, re.I):
            marks.append((i, None))
        elif re.fullmatch(r"\s*[A-Za-z0-9][\w-]*\s*\.\s*", line) and word not in COBOL_WORDS and not word.startswith("END-"):
            marks.append((i, line.strip().rstrip(". ")))
    last = len(source.lines) + (not text.endswith("\n"))
    return [Declaration(i, after - 1, name, "function") for (i, name), after in zip(marks, [m[0] for m in marks[1:]] + [last]) if name], source


def of_fortran(text: str, language: str) -> tuple[list[Declaration], Source]:
    """Program units and derived types, each to its own ``end``; interface blocks are stepped over."""
    source, found, open_ = Source(text, language), [], []
    unit = re.compile(r"\s*(?:(?:pure|elemental|impure|recursive|module|(?:integer|real|logical|complex|character|double\s+precision|type\s*\([^)]*\)|class\s*\([^)]*\))(?:\s*\*\s*\d+|\s*\([^)]*\))?)\s+)*(subroutine|function|program|module|submodule\s*\([^)]*\)|interface|abstract\s+interface)\b\s*(\w*)", re.I)
    kind_of = re.compile(r"\s*type\s*(?:,[^:]*)?(?:::)?\s*(?!is\b|\()(\w+)\s*$", re.I)
    opens = re.compile(r"\s*(?:\w+\s*:\s*)?(?:if\b.*\bthen\s*$|do\b(?!\s+\d)|select\s+(?:case|type|rank)\b|where\s*\(.*\)\s*$|associate\b|block\s*$|forall\s*\(.*\)\s*$|critical\b|enum\b)", re.I)
    ends = re.compile(r"\s*(?:\d+\s+)?end\s*(?:subroutine|function|program|module|submodule|interface|type|if|do|select|where|associate|block|forall|critical|enum)?\b(?!\s*[=(%])", re.I)
    for i, raw in enumerate(source.lines, 1):
        line = re.sub(r"^\s*\d+\s+", "", raw.rstrip())
        if not line.strip():
            continue
        if ends.match(line) and re.match(r"\s*end", line, re.I):
            if open_:
                k, n, s = open_.pop()
                if k not in ("block", "interface") and not any(x[0] == "interface" for x in open_):
                    found.append(Declaration(s, i, n, "class" if k in ("module", "submodule", "type") else "function"))
            continue
        if m := unit.match(line):
            k = "interface" if "interface" in m[1].lower() else m[1].split("(")[0].strip().lower()
            if k == "module" and m[2].lower() in ("procedure", "subroutine", "function"):
                k = "function"
            open_.append((k, m[2], i))
        elif m := kind_of.match(line):
            open_.append(("type", m[1], i))
        elif opens.match(line):
            open_.append(("block", "", i))
    found += [Declaration(s, max(s, source.indented_end(s)), n, "class" if k in ("module", "submodule", "type") else "function") for k, n, s in open_ if k not in ("block", "interface")]
    return sorted(found), source


def measured(path: str, text: str) -> list[dict]:
    """A row for each declaration of a file: start, end, name, kind, lines, digest and tokens of its masked body, and the body itself.

    ``weight`` is the nesting-weighted complexity where a syntax tree gives it. Files of unknown languages have no rows.
    """
    language = lexing.language_of(path)
    if language is None:
        return []
    weights: dict[Declaration, int | None] = {}
    if language == "python":
        pairs, source = of_python(text)
        declared, weights = [d for d, _ in pairs], dict(pairs)
    elif language in HEADS:
        declared, source = of_braces(text, language)
    else:
        declared, source = {"ruby": of_ruby, "shell": of_shell, "cobol": of_cobol}[language](text) if not language.startswith("fortran") else of_fortran(text, language)
    lines, rows = text.split("\n"), []
    for d in sorted(declared, key=lambda x: (x.start, x.end)):
        body = source.lines[d.start - 1 : d.end]
        rows.append({
            "start": d.start, "end": d.end, "name": d.name, "kind": d.kind, "lines": d.end - d.start + 1, "language": "fortran" if language == "fortran_fixed" else language, "weight": weights.get(d),
            "digest": hashlib.sha256("\n".join(" ".join(x.split()) for x in body if x.strip()).encode()).hexdigest(),
            "tokens": streams.tokens("\n".join(lines[d.start - 1 : d.end]), language, body), "body": body,
        })
    return rows
