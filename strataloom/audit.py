"""A whole audit of a tree of sources: tables of findings, one summary row, its scorecard, and a page that shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexing, markers, paths
from .operators import bands, code, incremental, practice, scorecard, text, workorder
from .session import staged
from .sources.files import source_files

# Limits of files, rules with the suffixes they look at, groups of libraries that serve one concern, and documents.
FILE_LIMITS = (400, 800)
RULES = [
    ("debt-marker", r"(?i)\b(TODO|FIXME|HACK)\b", None),
    ("absence-as-zero", r"(?i)(?:return|=)\s*[\w.\[\]\"']+\.get\([^)]+,\s*0\s*\)\s*$", (".py",)),
    ("vacuous-assertion", r"(?i)assert\s+(True|1)\s*(?:,|$)|assert\s+(\w+)\s*==\s*\2\b", (".py",)),
    ("silent-truncation", r"(?i)return\s+[\w.\[\]()]+\[:\s*\d{2,}\s*\]\s*$", (".py",)),
]
SUFFIXES = tuple(sorted({s for own in lexing.SUFFIXES.values() for s in own}))


def _ends(path: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.lower(path).endswith(s)
    return out


def risk_findings(lines: DataFrame, rules: list[tuple[str, str, tuple[str, ...] | None]] = RULES) -> DataFrame:
    """(rule, path, line, text) of the lines that match a rule for their suffix; one scan for all rules, texts up to 180 characters."""
    hits = [F.when(F.col("text").rlike(p) & (F.lit(True) if ends is None else _ends(F.col("path"), ends)), F.lit(name)) for name, p, ends in rules]
    found = F.filter(F.array(*hits) if hits else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return lines.select(F.explode(found).alias("rule"), "path", F.col("line_no").alias("line"), F.substring(F.trim("text"), 1, 180).alias("text"))


def audit(spark: SparkSession, root: str, exclude: list[str] = (), clone_lines: int = 8, history: DataFrame | None = None, gates: DataFrame | None = None, unpaired: bool | None = None, store: str | None = None, rules: list[tuple[str, str, tuple[str, ...] | None]] = RULES) -> dict[str, DataFrame]:
    """files, declarations, clones, similar, unused, risks, idioms, hotspots, work, summary and card of the sources under ``root``.

    Files are read and parsed once; sources and declarations are staged. ``history``: a row with
    files_changed, hotspots, coupled_pairs, settled_files and single_author_files; ``gates``: (gate, passed), a row a gate that was run, null where it could
    not be judged; ``unpaired``: whether a hotspot has no test. What is not given was not looked at: it is unknown and priced, never a clean reading.
    With a ``store``, only files that it does not hold are parsed (``incremental``). ``rules`` that do not compile, or backtrack beyond their
    budget, do not run; table refused_rules names them.
    """
    read = source_files(spark, root, list(SUFFIXES), list(exclude))
    # Texts are read from the tree once; all tables come from the staged copy.
    sources = staged(read.select("path", F.col("content").alias("text"), "valid"), "sources")
    lines = sources.select("path", F.posexplode(text.split_lines(F.col("text"))).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")
    test = paths.is_test_path(F.col("path"))
    files = sources.select("path", "valid", F.size(text.split_lines(F.col("text"))).alias("lines"), test.alias("is_test")).withColumn("status", bands.status(F.col("lines"), *FILE_LIMITS))
    declared = incremental.declarations(sources, store) if store else staged(code.declarations(sources), "declarations")
    graded = declared.withColumn("status", code.status()).withColumn("is_test", test)
    admitted, refused_rules = practice.admitted_rules(spark, rules)
    windows = text.clone_windows(lines, clone_lines)
    clones = text.clone_groups(windows, clone_lines)
    similar, unused, risks = code.similar_bodies(declared), code.unused_declarations(declared, sources), risk_findings(lines, admitted)
    uses = lines.filter(~test).select("path", F.explode(markers.imported(F.col("text"), F.lower("path").endswith(".py"))).alias("package"))
    idioms = text.divergent(markers.competing(uses), "concern", "package", "path")
    summary = _summary(spark, root, files, graded, clones, similar, unused, risks, idioms, history, gates, unpaired)
    card = scorecard.scorecard(summary)
    hotspots = code.function_hotspots(declared)
    work = _work(windows, graded, files, similar, unused, risks, idioms, card, clone_lines)
    return {"files": files, "declarations": graded.drop("tokens"), "clones": clones, "similar": similar, "unused": unused, "risks": risks, "refused_rules": refused_rules, "idioms": idioms, "hotspots": hotspots, "work": work, "summary": summary, "card": card}


def _work(windows, graded, files, similar, unused, risks, idioms, card, clone_lines) -> DataFrame:
    """The work order of the tree: items of all kinds that an audit finds, with what clearing them is worth."""
    places = windows.join(windows.groupBy("block").agg(F.min(F.struct("path", "line_no")).alias("first")), "block")
    # A block's places are an array of a report; the item's own is the first.
    blocks = places.groupBy("block", "first").agg(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.col("line_no").cast("string")))).alias("locations"))
    blocks = blocks.select(F.col("first.path").alias("path"), F.col("first.line_no").alias("line"), F.lit(clone_lines).alias("lines"), "locations")
    failing = F.col("status") == "fail"
    items = workorder.together(
        workorder.of_declarations(graded.filter(failing)), workorder.of_files(files.filter(failing)), workorder.of_clones(blocks), workorder.of_similar(similar),
        workorder.of_unused(unused), workorder.of_risks(risks), workorder.of_idioms(idioms),
    )
    return workorder.work_order(items.withColumn("tree", F.lit(1)), card.withColumn("tree", F.lit(1)), ["tree"]).drop("tree")


def _summary(spark, root, files, graded, clones, similar, unused, risks, idioms, history, gates, unpaired) -> DataFrame:
    """One row of counts; each table is summed by itself and the single rows are put side by side."""
    count = lambda frame, name: frame.agg(F.count("*").alias(name))
    of_files = files.agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "fail").alias("file_failures"), F.count_if(F.col("status") == "warn").alias("file_warnings"),
        F.avg(bands.band(F.col("lines"), *FILE_LIMITS)).alias("file_band_pressure"), F.count_if("is_test").alias("test_files"), F.count_if(~F.col("valid")).alias("broken_files"),
    )
    worst = F.when(F.col("kind") == "class", bands.band(F.col("lines"), 200, 300)).otherwise(F.greatest(bands.band(F.col("lines"), 50, 80), bands.band(F.col("cyclomatic"), 10, 15), bands.band(F.col("cognitive"), 15, 25)))
    of_declared = graded.agg(
        F.count("*").alias("declarations"), F.count_if(~F.col("is_test")).alias("production_declarations"), F.count_if(F.col("status") == "fail").alias("declaration_failures"),
        F.count_if(F.col("status") == "warn").alias("declaration_warnings"), F.avg(F.when(~F.col("is_test"), worst)).alias("declaration_band_pressure"),
    )
    parts = [of_files, of_declared, count(clones, "duplicate_blocks"), count(similar, "near_duplicates"), count(unused, "dead_declarations"), count(risks, "risk_findings")]
    row = parts[0]
    for part in parts[1:]:
        row = row.join(F.broadcast(part))  # single rows
    unknown = ["files_changed", "hotspots", "coupled_pairs", "settled_files", "single_author_files"]
    row = row.join(F.broadcast(history.select(*unknown))) if history is not None else row.select("*", *[F.lit(None).cast("long").alias(c) for c in unknown])
    names = spark.read.format("binaryFile").load(root).select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("n")) if _holds_files(spark, root) else spark.createDataFrame([], "n string")
    papers = names.agg(F.coalesce(F.bool_or(F.col("n").startswith("readme")), F.lit(False)).alias("has_readme"), F.coalesce(F.bool_or(F.col("n").startswith("changelog")), F.lit(False)).alias("has_changelog"))
    row = row.join(F.broadcast(papers)).withColumn("has_docs", F.lit(_exists(spark, root.rstrip("/") + "/docs")))
    row = row.join(F.broadcast(idioms.agg(F.countDistinct("concern").alias("divergent_concerns"))))
    failed = gates.agg(F.when(F.count("*") > 0, F.when(F.bool_or(F.col("passed").isNull()), None).otherwise(F.count_if(~F.col("passed")))).cast("long").alias("gate_failures")) if gates is not None else spark.createDataFrame([(None,)], "gate_failures long")
    return row.join(F.broadcast(failed)).select("*", F.lit(None).cast("double").alias("coverage_percent"), F.lit(unpaired).cast("boolean").alias("unpaired_hotspot"))


def _path(spark, root):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark, root: str) -> bool:
    path, system = _path(spark, root)
    return system.exists(path)


def _holds_files(spark, root: str) -> bool:
    path, system = _path(spark, root)
    return any(x.isFile() for x in system.listStatus(path))


def markdown(tables: dict[str, DataFrame], most: int = 10) -> str:
    """A page with the card and the first rows of the lists; lists are cut before they come to the driver."""
    card = tables["card"].first()
    page = [f"# Grade {card['grade']}", "", f"Score {card['overall']} (between {card['low']} and {card['high']}).", "", "| Category | Score |", "|-|-|"]
    page += [f"| {c[2:]} | {card[c]} |" for c in tables["card"].columns if c.startswith("c_")]
    if card["blockers"]:
        page += ["", "Above the ceilings of A: " + ", ".join(card["blockers"]) + "."]
    lists = {"Hotspots": (tables["hotspots"], ["path", "name", "lines", "cyclomatic", "cognitive", "status"], [F.desc("cyclomatic"), F.col("path")]), "Unused": (tables["unused"], ["path", "name", "lines"], [F.desc("lines"), F.col("path")]), "Risks": (tables["risks"], ["rule", "path", "line", "text"], [F.col("rule"), F.col("path"), F.col("line")])}
    for title, (frame, columns, order) in lists.items():
        rows = frame.select(*columns).orderBy(*order).limit(most).collect()
        page += ["", f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
        page += ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in columns) + " |" for r in rows]
    return "\n".join(page) + "\n"
