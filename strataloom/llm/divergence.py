"""Source divergence audit: how far the sources of a language differ in their terms, and by which."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged, unstaged
from .words import byte_table

#: Counts that a task gathers before it hands them on; rows of group sums that are sent to every task.
GATHER, MOST_GROUPS = 400_000, 200_000


def _share(count: str, total: str) -> str:
    """1 + floor(10**9 * count / total) in 64 bits for totals below 9 * 10**15: by three digits at a time."""
    first, second = f"({count}) * 1000L % {total}", f"(({count}) * 1000L % {total}) * 1000L % {total}"
    return f"1L + (({count}) * 1000L div {total}) * 1000000L + (({first}) * 1000L div {total}) * 1000L + (({second}) * 1000L div {total})"


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term in each group, and documents of the group that hold it."""
    table = byte_table(digits=False)
    schema = "lang string, source string, term string, n long, df long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on(got: dict) -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, holders) in got.items():
                if counts:
                    terms = list(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array(counts.values(), pa.int64()), pa.array([holders[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "df"])

        got: dict = defaultdict(lambda: (Counter(), Counter()))
        seen = 0
        for batch in batches:
            langs, sources, texts = batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary())
            for i in range(batch.num_rows):
                own = Counter(texts[i].as_py().translate(table).split())
                counts, holders = got[langs[i], sources[i]]
                before = len(counts)
                counts.update(own)
                holders.update(own.keys())
                seen += len(counts) - before
                if seen > GATHER:
                    yield from handed_on(got)
                    got.clear()
                    seen = 0
        yield from handed_on(got)

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*plain).mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def divergence(docs: DataFrame, least: int = 30, most: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language with the sum of the differences of their shares over all kept terms.
    Part ``term``: the ``most`` terms by which a source lies furthest above its language. A language keeps the terms that at
    least ``least`` of its documents hold; shares are smoothed by 5 counts a term and are whole numbers of 10**-9. Null
    language, source and text read as ''. Groups without terms have pairs, a language of one source has none; equal values
    rank by the bytes of the item; repeated rows count each; an empty table gives no rows.

    Each kept term is one row with an array over the sources of its language; differences of all pairs are made inside
    it, a source at a time, and summed before the shuffle. Arrays are as long as a language has sources, of which the result
    holds all pairs anyway.
    """
    counts = term_counts(docs, lang_col, source_col, text_col)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("held")).filter(F.col("df") >= least)
    kept = staged(kept.select("lang", "term", "n", F.map_from_entries("held").alias("held")), "terms")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    sums = kept.select("lang", F.explode("held").alias("source", "c")).groupBy("lang", "source").agg(F.sum("c").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("whole"))
    own = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))).alias("s"))
    langs = staged(own.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.coalesce("whole", F.lit(0).cast("long")).alias("whole"), F.col("s.source").alias("sources"), F.col("s.total").alias("totals")), "langs")
    few = langs.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0] <= MOST_GROUPS
    wide = kept.join(F.broadcast(langs) if few else langs, "lang")
    wide = wide.withColumn("c", F.expr("transform(sources, s -> coalesce(held[s], 0L))"))
    wide = wide.withColumn("p", F.expr(f"zip_with(c, totals, (x, t) -> {_share('x + 5', '(t + 5 * v)')})"))

    each = wide.select("lang", "p", F.posexplode("p").alias("i", "x"))
    gaps = each.select("lang", "i", F.posexplode(F.expr("transform(slice(p, i + 2, size(p)), y -> abs(y - x))")).alias("d", "f")).groupBy("lang", "i", (F.col("i") + F.col("d") + 1).alias("j")).agg(F.sum("f").alias("f"))
    side = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source")).repartition("lang", "a")
    side = side.select("lang", "source", "a", F.posexplode("sources").alias("b", "item")).filter("a != b").withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")})
    pairs = side.join(gaps, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))

    above = wide.withColumn("q", F.expr(_share("n + 5", "(whole + 5 * v)"))).select("lang", "term", "q", F.explode(F.arrays_zip("sources", "c", "p")).alias("e"))
    above = above.filter("e.c > 0 and e.p > q").select("lang", F.col("e.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("e.p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    out = ranked(pairs).unionByName(ranked(above).filter(F.col("rank") <= most))  # each task keeps its own ``most`` of a group before they meet
    out = staged(out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "divergence")
    unstaged(kept)
    unstaged(langs)
    return out
