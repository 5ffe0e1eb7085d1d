"""Benchmark decontamination: windows of benchmark words found in documents, and their removal. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged, unstaged
from .words import BETWEEN_WORDS, word_array

#: Up to so many windows, and bytes of their texts, go to every task as one hash table.
MOST_WINDOWS, MOST_BYTES = 1_000_000, 100_000_000
#: Classes in all the different sets of classes that documents hold, up to which the digests of these sets go to every task (some 50 bytes a class).
MOST_CLASSES = 1_000_000


def _hashed(words: Column, at: Column, length: int) -> Column:
    """A hash of ``length`` words from position ``at`` (0-based) on, null where they pass the end."""
    return F.when(at + length <= F.size(words), F.xxhash64(*[F.get(words, at + j) for j in range(length)]))


def windows_of(benchmark: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(h, length, window, class), one row a distinct window of the items, and (class, item).

    An item of fewer than ``size`` words, but not none, is one window. Windows of the same items are one class, so that
    documents carry one class for a whole passage. Rows of one item id add their windows; items without id find passages, but have no row in the second frame.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("w")).distinct()
    h = F.coalesce(*[F.when(F.size("w") == n, _hashed(F.col("w"), F.lit(0), n)) for n in range(1, size + 1)])
    rows = staged(cut.select("item", F.size("w").alias("length"), h.alias("h"), F.array_join("w", " ").alias("window")), "windows")
    # Who holds a window is told by count, sum and exclusive or of hashes: nothing is gathered.
    held = F.concat_ws("/", F.count("item"), F.sum(F.xxhash64("item").cast("decimal(20,0)")), F.expr("bit_xor(xxhash64('x', item))"))
    windows = rows.groupBy("window", "h", "length").agg(F.md5(held).alias("class"))
    windows = staged(windows.select("h", "length", "window", "class"), "leaks")
    of = staged(rows.filter("item is not null").join(windows.select("window", "class"), "window").select("class", "item").distinct(), "classes")
    unstaged(rows)
    return windows, of


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): rows of one id and one text share a key and all that follows from them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("key"), text.alias("text"))


def _key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.lit("\0"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, key, copies, n_words, hit, classes): one row for each distinct document with the positions of its hit words and the classes of the windows found.

    Every window of every document is looked up by its hash, and words decide. The windows go to every task if they are few;
    beyond that the hashes of documents meet them by a shuffle, and what meets is held against the words in a second pass.
    """
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    lengths = sorted((r[0] for r in windows.select("length").distinct().collect()), reverse=True) or [1]  # at most the size of a window
    words = _keyed(docs, id_col, text_col).select("doc_id", "key", word_array(F.col("text")).alias("w"))
    at = words.select("doc_id", "key", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("at", "word"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    if len(lengths) == 1:
        probes = at.withColumn("p", _hashed(F.col("w"), F.col("at"), lengths[0])).withColumn("head", first)
    else:
        each = F.array(*[F.struct(_hashed(F.col("w"), F.col("at"), n).alias("p"), (first & F.lit(k == 0)).alias("head")) for k, n in enumerate(lengths)])
        probes = at.select("doc_id", "key", "w", "n_words", "at", F.explode(each).alias("e")).select("doc_id", "key", "w", "n_words", "at", "e.*")
    same = F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ") == F.col("window")
    if n <= most_windows and size <= most_bytes:
        met = probes.join(F.broadcast(windows), (F.col("p") == F.col("h")) & same, "left")
        rows = met.filter(F.col("class").isNotNull() | F.col("head"))
    else:
        near = probes.filter("p is not null").select("key", "at", "p").join(windows, F.col("p") == F.col("h")).select("key", "at", "length", "window", "class").distinct()
        sure = words.select("key", "w").dropDuplicates(["key"]).join(near, "key").filter(same).select("key", "at", "length", "class")
        found = sure.unionByName(words.select("key").distinct().withColumns({"at": F.lit(None).cast("int"), "length": F.lit(None).cast("int"), "class": F.lit(None).cast("string")}))
        rows = found.join(words.groupBy("doc_id", "key", F.size("w").alias("n_words")).agg(F.count("*").alias("many")), "key").withColumn("head", F.col("class").isNull())
    span = F.when(F.col("class").isNotNull(), F.struct("at", "length"))
    many = F.col("many") if "many" in rows.columns else F.lit(1)
    got = rows.groupBy("doc_id", "key", "n_words").agg(F.sum(F.when(F.col("head"), many).otherwise(0)).alias("copies"), F.collect_set(span).alias("spans"), F.collect_set("class").alias("classes"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    return got.select("doc_id", "key", "copies", "n_words", covered.alias("hit"), F.array_sort("classes").alias("classes"))


def leak_digest(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **bounds: int) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row a document.

    A word is hit if it stands in any window of ``size`` words of an item. Null and empty texts have no words and are clean;
    repeated rows come out as often as they come in, each with the same result; rows of one id with other texts count apart.
    An empty benchmark leaves all clean, an empty table gives no rows. Other columns, whatever their names, stay out of the way.
    Documents with the same set of classes share one list of items.
    """
    windows, of = windows_of(benchmark, size, item_col, item_text_col)
    found = staged(hits(docs, windows, id_col, text_col, **bounds), "hits")
    lists = found.filter(F.size("classes") > 0).select("classes").distinct()
    items = lists.select("classes", F.explode("classes").alias("class")).join(of, "class").groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = items.select("classes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    named = staged(named, "lists")
    # Clean documents have no list to look up. Those of one common passage share a list, a hot key: lists go to every task while they are few.
    few = named.agg(F.coalesce(F.sum(F.size("classes") + 4), F.lit(0))).first()[0] <= MOST_CLASSES
    leaked = found.filter(F.size("classes") > 0).join(F.broadcast(named) if few else named, "classes", "left")
    clean = found.filter(F.size("classes") == 0).withColumns({"n_items": F.lit(None).cast("long"), "items_sha256": F.lit(None).cast("string")})
    n_hit = F.size("hit").cast("long")
    rows = leaked.unionByName(clean).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    )
    out = staged(rows.drop("_copy"), "leaked")
    for x in (windows, of, found, named):
        unstaged(x)
    return out


def _runs(hit: Column) -> Column:
    """[start, stop) of each run of following positions in a sorted array."""
    starts = F.filter(hit, lambda p, i: (i == 0) | (F.get(hit, i - 1) != p - 1))
    stops = F.transform(F.filter(hit, lambda p, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != p + 1)), lambda p: p + 1)
    return F.arrays_zip(starts.alias("start"), stops.alias("stop"))


def leaked_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, **columns) -> DataFrame:
    """(doc_id, start, stop, n_words): the runs of hit words of each document, in words from 0 on, ``stop`` exclusive. Repeated rows give their runs once."""
    windows, _ = windows_of(benchmark, size)
    found = hits(docs, windows, **columns)
    return found.select("doc_id", F.explode(_runs(F.col("hit"))).alias("r"), F.col("n_words").cast("long").alias("n_words")).select("doc_id", "r.start", "r.stop", "n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """``docs`` with the hit words cut out of their texts, each with what separates it from the word before.

    Documents of which more than ``most_share`` of the words are hit go altogether (0.0: all with a hit). All columns
    stay; texts without a hit, null ones included, stay as they are.
    """
    windows, _ = windows_of(benchmark, size)
    found = hits(docs, windows, id_col, text_col, **bounds).filter(F.size("hit") > 0).select(F.col("key").alias("_leak_key"), _runs(F.col("hit")).alias("_leak_runs"), (F.size("hit") / F.col("n_words")).alias("_leak_share"))
    pieces = F.regexp_extract_all(text_col, F.lit(f"{BETWEEN_WORDS[:-1]}*{BETWEEN_WORDS.replace('[', '[^', 1)}"), F.lit(0))
    runs = F.col("_leak_runs")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice("_leak_pieces", _start(runs, k), _stop(runs, k) - _start(runs, k) + 1)))
    tail = F.substring(F.col(text_col), F.length(F.array_join("_leak_pieces", "")) + 1, F.length(text_col))
    cut = docs.withColumn("_leak_key", _key(id_col, text_col)).join(found, "_leak_key", "left").filter(F.coalesce("_leak_share", F.lit(0.0)) <= most_share)
    cut = cut.withColumn("_leak_pieces", F.when(runs.isNotNull(), pieces))
    return cut.withColumn(text_col, F.when(runs.isNotNull(), F.concat(F.array_join(kept, ""), tail)).otherwise(F.col(text_col))).select(*docs.columns)


def _start(runs: Column, k: Column) -> Column:
    """The first piece (1-based) behind run k - 1."""
    return F.coalesce(F.get(runs, k - 1)["stop"], F.lit(0)) + 1


def _stop(runs: Column, k: Column) -> Column:
    """The last piece (1-based) before run k."""
    return F.coalesce(F.get(runs, k)["start"], F.size("_leak_pieces"))
