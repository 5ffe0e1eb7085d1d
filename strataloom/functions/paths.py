"""Predicates and names made of paths, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and names that say "test", name shapes that say "generated", suffixes of modules.
TEST_DIRECTORIES = ["tests", "test", "__tests__", "spec", "specs", "acceptance", "e2e"]
TEST_STEM = r"(_test|\.test|\.spec|_spec)$"
GENERATED_NAMES = [r"\.pb\.(go|cc|h)$", r"_pb2(_grpc)?\.py$", r"\.g\.dart$", r"\.generated\.[a-z]+$", r"(?i)\.designer\.cs$", r"_generated\.go$"]


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression in which ``*`` crosses slashes; a bracket that is never closed is literal."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c, "\\" + c if c in r".^$+{}()|[]\\" else c)
        i += 1
    return out


def exclusion_regex(patterns: list[str]) -> str | None:
    """One regular expression for all patterns, to be found in ``/`` + path; None without patterns.

    ``dir/`` and ``**/dir/`` mean any directory of that name or any rooted prefix, never the file itself; a glob means
    the whole path or the file name; a plain name means any component as well.
    """
    parts = []
    for pattern in (p.replace("\\", "/") for p in patterns):
        if pattern.endswith("/"):
            name = pattern[3 if pattern.startswith("**/") else 0 : -1]
            parts.append(f"^/{glob_regex(name)}/")
            if "/" not in name:
                parts.append(f"/{glob_regex(name).replace('.*', '[^/]*')}/")
            continue
        parts.append(f"^/{glob_regex(pattern)}$")
        if "/" not in pattern:
            parts.append(f"/{glob_regex(pattern).replace('.*', '[^/]*')}$")
        if not set("*?[]") & set(pattern):
            parts.append(f"/{glob_regex(pattern)}(?:/|$)")
    return "(?s)(?:" + "|".join(parts) + ")" if parts else None


def is_excluded(path: Column, patterns: list[str]) -> Column:
    regex = exclusion_regex(patterns)
    return F.lit(False) if regex is None else F.concat(F.lit("/"), slashed(path)).rlike(regex)


def is_test_path(path: Column) -> Column:
    """A directory named for tests, or a file named as one; null paths give null."""
    parts, name = F.split(F.lower(slashed(path)), "/"), F.lower(base_name(path))
    directories = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(directories, F.array(*map(F.lit, TEST_DIRECTORIES))) | name.rlike(r"^test[_.]") | name.endswith(".pf") | stem(name).rlike(TEST_STEM)


def subject_stem(path: Column, module_suffixes: tuple[str, ...] = ("_mod",)) -> Column:
    """The name that a test file covers, or a file's own: ``a/test_churn.py`` and ``churn_mod.f90`` are both ``churn``."""
    own = stem(F.lower(base_name(path)))
    bare = F.when(own.rlike(TEST_STEM), F.regexp_replace(own, TEST_STEM, "")).otherwise(F.regexp_replace(own, r"^test[_.]", ""))
    return F.regexp_replace(bare, f"(?<=.)({'|'.join(module_suffixes)})$", "")


def provenance(path: Column, vendored: list[str] = (), generated: list[str] = (), assets: list[str] = (), banner: Column | None = None) -> Column:
    """vendored, generated, asset, test or first-party: the first of these rules that holds."""
    own = slashed(path)
    under = lambda dirs: reduce(lambda x, d: x | (own == d.rstrip("/")) | own.startswith(d.rstrip("/") + "/"), dirs, F.lit(False))
    named = reduce(lambda x, r: x | base_name(path).rlike(r), GENERATED_NAMES, F.lit(False))
    said = F.lit(False) if banner is None else F.coalesce(banner, F.lit(False))
    return F.when(under(vendored), "vendored").when(under(generated), "generated").when(under(assets), "asset").when(named | said, "generated").when(is_test_path(path), "test").otherwise("first-party")
