"""Token streams of declarations, and the nesting-weighted complexity of Python's, which its syntax tree gives."""

from __future__ import annotations

import ast
import re

# Python: by the syntax tree.
_DEEPER_AT_A_PRICE = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)
_DEEPER = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)


def of_python(node: ast.AST) -> int:
    """A point and one more for each level for each decision, one for an else, one for each run of and or of or.

    An ``if`` whose else is nothing but another ``if`` costs one point and does not deepen its body.
    """
    total = sum(isinstance(x, ast.BoolOp) for x in ast.walk(node))
    open_ = [(child, 0) for child in ast.iter_child_nodes(node)]
    while open_:
        at, depth = open_.pop()
        below = depth
        if isinstance(at, ast.If) and len(at.orelse) == 1 and isinstance(at.orelse[0], ast.If):
            total += 1
        elif isinstance(at, _DEEPER_AT_A_PRICE):
            total += 1 + depth + bool(getattr(at, "orelse", None))
            below = depth + 1
        elif isinstance(at, _DEEPER):
            below = depth + 1
        open_ += [(child, below) for child in ast.iter_child_nodes(at)]
    return total


# The words of JavaScript that stay as they are in a token stream.
JS_WORDS = frozenset("async await break case catch class const continue default delete do else export extends finally for function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield".split())


def _named() -> tuple[dict[str, str], object]:
    seen: dict[str, str] = {}
    return seen, lambda word, kept: word if word in kept else seen.setdefault(word, f"V{len(seen)}")


def tokens(text: str, language: str | None, masked_lines: list[str] | None = None) -> list[str]:
    """Tokens of a declaration: names by order of appearance (V0, V1, ...), numbers as L, Python's strings as S, the rest as it is.

    Python's are those of its own tokenizer after dedenting, none if it does not read the text; for other languages
    ``masked_lines`` are taken.
    """
    import io
    import keyword
    import textwrap
    import token
    import tokenize

    _, name = _named()
    if language == "python":
        out = []
        try:
            for t in tokenize.generate_tokens(io.StringIO(textwrap.dedent(text.expandtabs())).readline):
                if t.type == token.NAME:
                    out.append(name(t.string, keyword.kwlist))
                elif t.type in (token.NUMBER, token.STRING, token.OP):
                    out.append({token.NUMBER: "L", token.STRING: "S"}.get(t.type, t.string))
        except (tokenize.TokenError, SyntaxError):
            return []
        return out
    found = re.findall(r"[A-Za-z_$][\w$]*|\d[\d.]*|[^\s\w]", "\n".join(masked_lines or []))
    return ["L" if x[0].isdigit() else name(x, JS_WORDS) if x[0].isalpha() or x[0] in "_$" else x for x in found]


def shingles(stream: list[str], size: int = 6) -> set[tuple[str, ...]]:
    return {tuple(stream[i : i + size]) for i in range(len(stream) - size + 1)}


