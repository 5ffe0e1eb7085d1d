"""Decision points and nesting-weighted complexity of declarations, from their masked lines.

Each line becomes events (levels closed before it, decisions that cost more the deeper they stand, decisions that cost
one, levels opened behind it). Depth is a running sum of the events of a declaration, lifted wherever it would fall
below zero by its own running minimum; the complexity is the sum of what the events cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Decision points by language, on text whose comments and literals are blanked; "" stands for all others.
BRANCHES = {
    "": r"\b(if|elif|for|foreach|while|except|case|catch)\b|&&|\|\||\?\?|\?(?![.?:])(?=[^?]*:)",
    "python": r"\b(?:if|elif|for|while|except|and|or)\b|\bcase\b(?!\s+_\s*(?::|if\b))",
    "swift": r"\b(if|for|while|case|catch|guard)\b|&&|\|\||\?\?|\?(?![.?:])(?=[^?]*:)",
    "kotlin": r"\b(if|for|while|catch)\b|&&|\|\||\?:",
    "go": r"\b(if|for|case)\b|&&|\|\|",
    "rust": r"\b(if|for|while)\b|&&|\|\||\?|(?<!_\s)(?<!_)=>|(?<!\bif )(?<!\bwhile )\blet\b[^;]*\belse\b",
    "php": r"\b(elseif|if|for|foreach|while|match|case|catch|and|or|xor)\b|&&|\|\||\?\?|\?:|\?(?![.?:\w])",
    "ruby": r"\b(if|elsif|unless|while|until|for|when|rescue)\b|&&|\|\||\band\b|\bor\b|(?<![\w&.])\?(?![.?])",
    "fortran": r"(?i)\b(?:if|do|case|where|elsewhere|forall)\b|\.and\.|\.or\.",
    "cobol": r"(?i)\b(?:IF|ELSE|WHEN|UNTIL|VARYING|TIMES|AND|OR)\b",
}
# What is taken out of a line before its decision points are counted.
NO_BRANCHES = {
    "fortran": r"(?i)\bend\s*(?:if|do|where|forall|select|associate|block|critical|team|function|subroutine|module|program|type|interface)\b|\bselect\s+(?:case|type)\b|\bcase\s+default\b",
    "cobol": r"(?i)\bEND-[A-Z]+\b|\bWHEN\s+OTHER\b",
}
# The arrows of Kotlin that are no arm of a when.
NO_ARMS = r"\{[^}]*?->|\)\s*->|\belse\s*->"
# Words that cost a point and one more for each level of braces.
CONTROL = {
    "": r"\b(?:if|for|foreach|while|catch|switch|case|elif|except)\b",
    "swift": r"\b(?:if|for|while|catch|switch|case|guard|repeat)\b",
    "kotlin": r"\b(?:if|for|foreach|while|catch|switch|case|when|elif|except)\b",
}
# The shell's words that count where a command begins, what a command begins behind, and the patterns of a case's arm.
SHELL = {
    "decisions": ["if", "elif", "while", "until", "for", "select"],
    "opens": ["if", "while", "until", "for", "select", "case"],
    "closes": ["fi", "done", "esac"],
    "once": ["&&", "||", "elif", "else"],
    "before": r"[;&|({!`]",
    "prefixes": "then|do|else|time",
    "arm": r"""(?:"[^"]*"|'[^']*'|[^\s()|;&<>"']++)+""",
}
# By line, what closes a level, what costs one whatever the depth, what costs its depth, what joins conditions, what opens a level.
LINES = {
    "fortran": {
        "closes": r"(?i)^\s*end\s*(?:if|do|where|forall|select|associate|block|critical|team)\b",
        "once": r"(?i)^\s*(?:else|elsewhere|case)\b",
        "deep": r"(?i)\b(?:if|do|where|forall)\b|\bselect\s+(?:case|type)\b",
        "joins": r"(?i)\.and\.|\.or\.",
        "opens": r"(?i)^\s*(?:\w+\s*:\s*)?(?:if\b.*\bthen\s*$|do\b(?!\s+\d)|select\s+(?:case|type)\b|where\s*\(.*\)\s*$|associate\b|block\s*$|forall\s*\(.*\)\s*$|critical\b|team\b)",
    },
    "cobol": {
        "closes": r"(?i)\bEND-(?:IF|EVALUATE|PERFORM|SEARCH|READ|STRING)\b",
        "once": r"(?i)^\s*ELSE\b|\bWHEN\b",
        "deep": r"(?i)\b(?:IF|EVALUATE|UNTIL|VARYING|TIMES|SEARCH)\b",
        "joins": r"(?i)\b(?:AND|OR)\b",
        "opens": r"(?i)\bIF\b|\bEVALUATE\b|\bPERFORM\b(?=[^.]*\b(?:UNTIL|VARYING|TIMES)\b)|\bSEARCH\b",
    },
}


def _rx(pattern: str) -> Column:
    return F.lit("(?U)" + pattern)  # letters beyond ASCII belong to words


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, _rx(pattern))


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, _rx(pattern), F.lit(" "))


def _by_language(language: Column, table: dict, of) -> Column:
    """A value for each language of a table, that of "" for the others."""
    out = None
    for name in table:
        if name:
            out = F.when(language == name, of(name)) if out is None else out.when(language == name, of(name))
    return out.otherwise(of("")) if "" in table else out


def shell_words(line: Column) -> Column:
    """The counting words and signs of a masked shell line in their order: a word counts where a command begins.

    Beginnings are marked with a line break first: the line's own, those behind a separator, then those behind each of
    the words that a command may follow.
    """
    before, command = SHELL["before"], rf"(?=\s*[^\s{SHELL['before'][1:]})"
    marked = F.regexp_replace(line, _rx(rf"(^|{before}){command}"), F.lit("$1\n"))
    marked = F.regexp_replace(marked, _rx(rf"(\n\s*|\G)({SHELL['prefixes']})\s+{command}"), F.lit("$1$2\n"))
    words = "|".join(dict.fromkeys(SHELL["decisions"] + SHELL["opens"] + SHELL["closes"] + [x for x in SHELL["once"] if x.isalpha()]))
    found = F.regexp_extract_all(marked, _rx(rf"\n\s*(?:{words})(?![^\s{before[1:]})|&&|\|\|"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))


def branch_points(line: Column, language: Column) -> Column:
    """Decision points of a masked line, null for a null line."""
    arm = SHELL["arm"]
    plain = _by_language(language, BRANCHES, lambda name: _count(_without(line, NO_BRANCHES[name]) if name in NO_BRANCHES else line, BRANCHES[name]))
    arms = _count(F.regexp_replace(line, _rx(NO_ARMS), F.lit("")), "->")
    shell = F.size(F.filter(shell_words(line), lambda w: w.isin(*SHELL["decisions"], "&&", "||")))
    case = line.rlike(rf"(?U)^\s*\(?\s*{arm}(?:\s*\|\s*{arm})*\s*\)") & ~line.rlike(r"^\s*\(?\s*\*(?:\s*\|\s*\*)*\s*\)")
    return F.when(language == "shell", shell + case.cast("int")).when(language == "kotlin", plain + arms).otherwise(plain)


def _event(closed, deep, once, opened, stops=None) -> Column:
    zero = F.lit(0)
    return F.struct(closed.cast("int").alias("closed"), deep.cast("int").alias("deep"), once.cast("int").alias("once"), opened.cast("int").alias("opened"), (stops if stops is not None else zero).cast("int").alias("stops"))


def line_events(line: Column, language: Column) -> Column:
    """The events of a masked line in their order: (closed, deep, once, opened, stops); ``stops`` ends all levels behind it."""
    # Braces count at the beginning of their line, closing ones in front of it at once.
    front = F.ltrim(line).startswith("}").cast("int")
    words = _by_language(language, CONTROL, lambda name: _count(line, CONTROL[name]))
    once = line.rlike(r"(?U)\belse\b").cast("int") + F.regexp_count(line, F.lit(r"&&")) + F.regexp_count(line, F.lit(r"\|\|"))
    braces = F.array(_event(-front, words, once, F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}")) + front))
    zero, one = F.lit(0), F.lit(1)
    is_in = lambda w, kind: w.isin(*SHELL[kind]).cast("int")
    shell = F.transform(shell_words(line), lambda w: _event(-is_in(w, "closes"), is_in(w, "opens"), is_in(w, "once"), is_in(w, "opens")))
    f, text = LINES["fortran"], F.rtrim(line)
    body, joins = _without(text, f["closes"].replace("^\\s*", "\\b")), _count(text, f["joins"])
    fortran = F.when(text.rlike(f["closes"]), _event(-one, zero, zero, zero)).when(text.rlike(f["once"]), _event(zero, zero, 1 + joins, zero)).otherwise(_event(zero, _count(body, f["deep"]), _count(body, f["joins"]), text.rlike(f["opens"])))
    c = LINES["cobol"]
    rest = _without(text, c["closes"])
    arm = rest.rlike("(?U)" + c["once"])
    cobol = _event(-_count(text, c["closes"]), F.when(arm, 0).otherwise(_count(rest, c["deep"])), F.when(arm, 1).otherwise(0) + _count(rest, c["joins"]), _count(rest, c["opens"]), text.endswith("."))
    return F.when(language == "shell", shell).when(language == "fortran", F.array(fortran)).when(language == "cobol", F.array(cobol)).otherwise(braces)


def measured(declared: DataFrame) -> DataFrame:
    """``declared`` (language, weight, body and whatever else) with cyclomatic and cognitive instead of language, weight and body.

    ``weight`` stands for the nesting-weighted complexity where it is known already. Lines travel as numbers alone, in one shuffle by
    declaration, whose lines are one window; other columns travel once a declaration.
    """
    others = [c for c in declared.columns if c not in ("language", "body")]
    head, line, language = F.col("no") == 0, F.col("line"), F.col("language")
    rows = declared.withColumn("_id", F.monotonically_increasing_id()).select("_id", "language", *others, F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "body")).alias("no", "line"))
    rows = rows.select("_id", *[F.when(head, F.col(c)).alias(c) for c in others], "no", branch_points(line, language).alias("points"), language.isin("shell", *LINES).alias("leveled"), F.posexplode_outer(F.when(line.isNotNull(), line_events(line, language))).alias("at", "e"))
    n = lambda name: F.coalesce(F.col(f"e.{name}"), F.lit(0)).alias(f"_{name}")
    rows = rows.select("_id", *others, "no", F.coalesce("at", F.lit(0)).alias("at"), "points", "leveled", *[n(x) for x in ("closed", "deep", "once", "opened", "stops")])
    order = Window.partitionBy("_id").orderBy("no", "at")
    rows = rows.withColumn("_sentence", F.sum("_stops").over(order) - F.col("_stops"))
    within = Window.partitionBy("_id", "_sentence").orderBy("no", "at")
    rows = rows.withColumn("_sum", F.sum(F.col("_closed") + F.col("_opened")).over(within) - F.col("_opened"))
    rows = rows.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(within)))
    # Braces count from the first line that opens one.
    opening = F.first(F.when(F.col("_opened") > 0, F.col("_depth")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = F.greatest(F.lit(0), F.col("_depth") - F.when(F.col("leveled"), 0).otherwise(F.coalesce(opening, F.lit(0))))
    rows = rows.withColumn("_cost", F.col("_deep") * (1 + level) + F.col("_once"))
    points = F.sum(F.when(F.col("at") == 0, F.coalesce("points", F.lit(0))))
    out = rows.groupBy("_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in others], (1 + points).cast("int").alias("cyclomatic"), F.sum("_cost").cast("int").alias("_cost"))
    return out.withColumn("cognitive", F.coalesce("weight", "_cost")).drop("_id", "_cost", "weight")
