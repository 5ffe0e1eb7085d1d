"""What a project does beside its code: tests paired with what they cover, signals of practice, foreign directories, states of its history."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers, paths

# Patterns of signals in configurations and in what runs on every change.
SIGNALS = [
    ("lint", r"(?i)\b(ruff|flake8|pylint|eslint|golangci|clippy|checkstyle|rubocop|shellcheck|ktlint|swiftlint)\b"),
    ("types", r"(?i)\b(mypy|pyright|tsc|flow)\b"),
    ("tests", r"(?i)\b(pytest|unittest|jest|vitest|go test|cargo test|mvn|gradle|rspec|phpunit)\b"),
    ("duplication", r"(?i)\b(jscpd|cpd|duplication)\b"),
    ("coverage-gate", r"(?i)--cov-fail-under[= ]\s*\d+|fail_under\s*[:=]\s*\d+|--fail-under[= ]\s*\d+|minimum_coverage\s*[:=]\s*\d+|coverageThreshold"),
    ("complexity-gate", r"(?i)max-complexity\s*[:=]\s*\d+|\bxenon\b|max_complexity|cognitive-complexity"),
]
RUNNERS = r"(^|/)(\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.yml|\.circleci/config\.yml|azure-pipelines\.yml|Jenkinsfile|\.travis\.yml)$"


def signals(configurations: DataFrame, table: list[tuple[str, str]] = SIGNALS) -> DataFrame:
    """(signal, path, runs): for each signal the shallowest file that shows it, and whether something that runs on every change does.

    ``configurations``: (path, text). One scan for all patterns; the shallowest is a grouped minimum.
    """
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in table]), lambda x: x.isNotNull())
    found = configurations.select("path", F.explode(hits).alias("signal"))
    runs = F.col("path").rlike(RUNNERS)
    depth = F.struct(F.size(F.split("path", "/")), F.col("path"))
    return found.groupBy("signal").agg(F.min_by("path", depth).alias("path"), F.bool_or(runs).alias("runs"))


def practice_level(found: DataFrame, configurations: DataFrame) -> DataFrame:
    """(level): 1 to 5 by lint, tests, types and gates; without anything that runs on every change, 2 at most."""
    runs = configurations.agg(F.coalesce(F.bool_or(F.col("path").rlike(RUNNERS)), F.lit(False)).alias("_ci"))
    has = lambda s: F.coalesce(F.bool_or(F.col("signal") == s), F.lit(False))
    row = found.agg(has("lint").alias("l"), has("tests").alias("t"), has("types").alias("y"), has("coverage-gate").alias("c"), has("complexity-gate").alias("x"), has("duplication").alias("d")).join(F.broadcast(runs))
    level = F.lit(1) + (F.col("l") | F.col("t")).cast("int") + (F.col("l") & F.col("t")).cast("int") + (F.col("l") & F.col("t") & (F.col("y") | F.col("c"))).cast("int") + (F.col("l") & F.col("t") & F.col("c") & (F.col("x") | F.col("d"))).cast("int")
    return row.select(F.when(F.col("_ci"), level).otherwise(F.least(level, F.lit(2))).alias("level"))


def paired(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, paired): whether a test covers each production file, by the name it bears or by what it imports.

    ``files``: (path); ``imports``: (path, name) of what files import. A file is found by its stem.
    """
    split = files.select("path", paths.is_test_path(F.col("path")).alias("test"), paths.subject_stem(F.col("path")).alias("stem"))
    tests = split.filter("test")
    stems = tests.select("stem").union(imports.join(tests.select("path"), "path", "left_semi").select(F.lower(F.element_at(F.split("name", r"[./]"), -1)).alias("stem"))).filter("stem != ''").distinct()
    return split.filter("not test").join(stems.withColumn("_hit", F.lit(True)), "stem", "left").select("path", F.coalesce("_hit", F.lit(False)).alias("paired"))


def unpaired_failures(files: DataFrame, declared: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, label, kind) of what fails and no test covers: declarations, and files that have none that fails. ``files`` and ``declared``: with path and status."""
    alone = pairs.filter(~F.col("paired")).select("path")
    own = declared.filter("status = 'fail'").join(alone, "path", "left_semi").select("path", F.col("name").alias("label"), F.lit("declaration").alias("kind"))
    rest = files.filter("status = 'fail'").join(alone, "path", "left_semi").join(own.select("path"), "path", "left_anti").select("path", F.col("path").alias("label"), F.lit("file").alias("kind"))
    return own.union(rest)


def foreign_directories(manifests: DataFrame) -> DataFrame:
    """(directory, evidence) that a project's own scripts make or fetch; of several reasons the first counts: removed, submodule, synced.

    ``manifests``: (path, text) of package manifests and of .gitmodules.
    """
    scripts = manifests.filter(F.col("path").endswith("package.json")).select(F.explode(F.from_json(F.get_json_object("text", "$.scripts"), "map<string, string>")).alias("name", "command"))
    plain = lambda d: F.regexp_replace(d, r"^\./|/+$", "")
    removed = scripts.select(F.explode(F.split(F.regexp_extract("command", r"\b(?:rm\s+-rf|rimraf)\s+([^&|;]+)", 1), r"\s+")).alias("d")).select(plain("d").alias("directory"), F.lit(0).alias("rank"), F.lit("removed").alias("evidence"))
    modules = manifests.filter(F.col("path").endswith(".gitmodules")).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*path\s*=\s*(\S+)\s*$"), 1)).alias("d")).select(plain("d"), F.lit(1), F.lit("submodule"))
    synced = scripts.filter(F.col("name").rlike(r"^sync[-:]")).select(F.regexp_extract("name", r"^sync[-:](.+)$", 1).alias("d")).select(plain("d"), F.lit(2), F.lit("synced"))
    every = removed.union(modules).union(synced).filter("directory != '' and not directory like '-%'")
    return every.groupBy("directory").agg(F.min_by("evidence", "rank").alias("evidence"))


def history_state(commits: Column, non_merges: Column, touching: Column, shallow: Column) -> Column:
    """Why a history says nothing, if it does: null commits are no repository. Never a zero."""
    return F.when(commits.isNull(), "no repository").when(shallow, "shallow").when(commits == 0, "nothing committed").when(non_merges == 0, "merges only").when(touching == 0, "no scanned file touched").otherwise("measured")


def evidence_state(value: Column, reason: Column) -> Column:
    """(state, value, reason): measured, unknown (with a reason) or not applicable (no population)."""
    state = F.when(value.isNotNull(), "measured").when(reason == "not applicable", "not_applicable").otherwise("unknown")
    return F.struct(state.alias("state"), value.alias("value"), F.when(value.isNull(), reason).alias("reason"))


def skipped_tests(lines: DataFrame) -> DataFrame:
    """(path, line, marker) of tests that are skipped or disabled, in test files alone."""
    rows = lines.filter(paths.is_test_path(F.col("path"))).withColumn("marker", markers.suppression(F.col("text")))
    return rows.filter(F.col("marker").isin("skipped test", "disabled test", "ignored test")).select("path", F.col("line_no").alias("line"), "marker")


def asked(changed: DataFrame, globs: list[str]) -> DataFrame:
    """The changed paths that an operator's ask names."""
    pattern = "|".join(f"(?:{paths.glob_regex(g)})" for g in globs)
    return changed.filter(F.col("path").rlike(f"^(?:{pattern})$")) if globs else changed.limit(0)


def admitted(pattern: str, budget: float = 0.005) -> bool:
    """Whether a configured rule compiles and decides short probes within its budget; one that backtracks without end must not reach the executors."""
    import re
    import time

    try:
        rule = re.compile(pattern, re.IGNORECASE)
    except re.error:
        return False
    for probe in ("a" * 20 + "!", "a1" * 12 + "!", " " * 24 + "x"):
        began = time.perf_counter()
        rule.search(probe)
        if time.perf_counter() - began > budget:
            return False
    return True


#: Probes of rules: runs that a pattern with nested repetition tries in every way before it gives up.
PROBES = ("a" * 20 + "!", "a1" * 12 + "!", " " * 24 + "x")


def refused(spark: SparkSession, pattern: str, budget: float = 0.005, tries: int = 3) -> str | None:
    """Why a rule must not reach the executors, or None: it does not compile, or takes more than its budget of seconds for a short probe.

    The engine that will run the rule is asked, Spark's own in the driver's JVM; the best of a few tries counts, less what
    a trivial rule takes there, so that a slow call of the driver is not taken for a slow rule.
    """
    engine = spark._jvm.java.util.regex.Pattern

    def seconds(rule, probe: str) -> float:
        best = float("inf")
        for _ in range(tries):
            matcher = rule.matcher(probe)
            began = time.perf_counter()
            matcher.find()
            best = min(best, time.perf_counter() - began)
            if best <= budget / 10:
                break
        return best

    try:
        rule = engine.compile(pattern)
    except Exception as e:
        return "does not compile: " + str(getattr(e, "java_exception", e)).split("\n")[0]
    plain = engine.compile("x")
    if any(seconds(rule, p) - seconds(plain, p) > budget for p in PROBES):
        return f"takes more than {budget * 1000:g} ms for a short line"
    return None


def admitted_rules(spark: SparkSession, rules: list[tuple], budget: float = 0.005) -> tuple[list[tuple], DataFrame]:
    """The rules (name, pattern, ...) that may run, and (rule, reason) of the others."""
    reasons = [(r, refused(spark, r[1], budget)) for r in rules]
    out = [(r[0], why) for r, why in reasons if why is not None]
    return [r for r, why in reasons if why is None], spark.createDataFrame(out, "rule string, reason string")


def new_oracles(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, weakened): test files whose count of assertions fell or whose skips rose between two states (path, asserts, skips)."""
    both = before.alias("x").join(after.alias("y"), "path")
    weaker = (F.col("y.asserts") < F.col("x.asserts")) | (F.col("y.skips") > F.col("x.skips"))
    return both.select("path", weaker.alias("weakened")).filter("weakened")
