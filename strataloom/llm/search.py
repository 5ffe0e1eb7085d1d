"""Ranked lexical search: each item's best documents, by postings in the order of their impacts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged, unstaged
from .words import byte_table

#: Terms of items that one pass over the documents takes; postings that a task holds at once.
BLOCK_TERMS, SHARD = 1_000_000, 1_500_000


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, n): the terms of each item with their repeats; rows of one item id add up."""
    table, kind = byte_table(digits=True), items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_bytes(batch["text"])):
                if counts := Counter(text.translate(table).split()):
                    ids = batch["item_id"].take(pa.array([i] * len(counts)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["item_id", "term", "n"])

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, term string, n long")
    return rows.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms of each document, and which of the vocabulary it holds how often."""
    table = byte_table(digits=True)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            step = max(1, min(batch.num_rows, (4 << 20) * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sizes, terms, tfs = [], [], []
                for text in _bytes(part["text"]):
                    found = text.translate(table).split()
                    counts = Counter(map(number, found))
                    counts.pop(None, None)
                    sizes.append(len(found))
                    terms.append(list(counts.keys()))
                    tfs.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """The postings of some documents: for each term, groups of one exact impact, highest first."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.own_doc, self.own_term, self.own_impact, self.n_docs = doc, term, impact, n_docs  # by document, to complete scores
        self.begins = np.searchsorted(doc, np.arange(n_docs + 1))
        order = np.lexsort((-impact, term))
        self.doc, self.falling = doc[order], -impact[order]
        self.heads = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.weight = np.zeros(n_terms, np.int64)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) among which the ``k`` best are, ties at the end included; all of them above 0, if fewer.

        Levels of impact are taken from the highest on. ``rest`` bounds what any document can still gain, so none below
        the k-th sum by more than that can rise to it; levels end once to complete the others is the lesser work.
        """
        at, end, sums = self.heads[terms].copy(), self.heads[terms + 1], np.zeros(self.n_docs, np.int64)
        open_ = at < end
        heads = np.where(open_, -times * self.falling[np.where(open_, at, 0)], 0) if len(self.falling) else np.zeros(len(terms), np.int64)
        while heads.any():
            level = -(-int(heads.max()) // 2)
            for j in np.flatnonzero(heads >= level):
                stop = at[j] + int(np.searchsorted(self.falling[at[j] : end[j]], level // -times[j], "right"))  # down to impacts of level / times, rounded up; groups stay whole
                sums[self.doc[at[j] : stop]] -= times[j] * self.falling[at[j] : stop]
                at[j] = stop
                heads[j] = -times[j] * self.falling[stop] if stop < end[j] else 0
            rest = int(heads.sum())
            if rest and k < self.n_docs:
                kth = int(np.partition(sums, self.n_docs - k)[self.n_docs - k])
                if kth > rest:
                    left = np.flatnonzero(sums >= kth - rest)
                    if int((self.begins[left + 1] - self.begins[left]).sum()) * 2 < int((end - at).sum()):
                        return left, self._complete(left, terms, times)
        floor = int(np.partition(sums, self.n_docs - k)[self.n_docs - k]) if k < self.n_docs else 0
        left = np.flatnonzero(sums >= max(1, floor))
        return left, sums[left]

    def _complete(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        self.weight[terms] = times
        sizes = self.begins[docs + 1] - self.begins[docs]
        own = np.repeat(self.begins[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        gains = self.weight[self.own_term[own]] * self.own_impact[own]
        self.weight[terms] = 0
        return np.add.reduceat(gains, np.cumsum(sizes) - sizes)  # a document with a sum has postings


def _shard_best(shard: Shard, ids: pa.Array, queries: list, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    known = np.asarray(ids.is_valid())
    number = np.asarray(ids.fill_null(0))
    for q, (terms, times) in enumerate(queries):
        docs, scores = shard.best(terms, times, k)
        top = np.lexsort((number[docs], ~known[docs], -scores))[:k]
        if len(top):
            yield q, docs[top], scores[top]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, equal scores by ascending id, null ids last.

    Counts (documents with a term, terms, documents a term is in) are those of all documents. Items go in blocks of some
    ``block_terms`` different terms each; a block costs a pass over the documents. Documents are searched in shards of
    some ``shard`` postings, score at a time, and the shards' best meet in one ranking. Rows of one item id are one item;
    items without a term, or all of whose terms are in no document, have no rows; null texts have no terms; rows that repeat an id are ranked each by its own text;
    an empty table gives no rows. Ids of documents are long.
    """
    spark, ids = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    asked = staged(item_terms(items, item_col, item_text_col), "asked")
    n_blocks = max(1, -(-asked.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    out = None
    for b in range(n_blocks):
        queries: dict = {}
        numbers: dict[bytes, int] = {}
        for r in asked.filter(block == b).toLocalIterator():  # a block's terms: bounded by ``block_terms``, give or take an item
            queries.setdefault(r["item_id"], []).append((numbers.setdefault(r["term"].encode(), len(numbers)), r["n"]))
        if not queries:
            continue
        held = staged(postings(docs, numbers, id_col, text_col), "postings")
        n, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(numbers), np.int64)
        for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
            weights[term] = int(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))))
        best = _block(spark, held, list(queries.items()), weights, n, total, k, shard, ids)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        part = staged(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        unstaged(held)
        out = part if out is None else out.unionByName(part)
    unstaged(asked)
    return out if out is not None else spark.createDataFrame([], f"item_id {ids}, rank int, doc_id long, score long")


def _block(spark, held: DataFrame, queries: list, weights: np.ndarray, n: int, total: int, k: int, shard: int, ids: str) -> DataFrame:
    own = spark.sparkContext.broadcast(([q for q, _ in queries], [(np.array([t for t, _ in x]), np.array([c for _, c in x], np.int64)) for _, x in queries], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, weight = own.value

        def ranked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            doc_ids, sizes = t["doc_id"].combine_chunks(), np.asarray(t["n"])
            lists, term, tf = t["terms"].combine_chunks(), None, None
            term, tf = np.asarray(lists.flatten()), np.asarray(t["tfs"].combine_chunks().flatten())
            doc = np.repeat(np.arange(len(sizes)), np.asarray(lists.value_lengths()))
            norm = 75 + (25 * sizes * n) // max(1, total)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc]))
            some = impact > 0
            index = Shard(doc[some].astype(np.int32), term[some], impact[some], len(sizes), len(weight))
            found = list(_shard_best(index, doc_ids, asked, k))
            if found:
                lengths = [len(d) for _, d, _ in found]
                which = np.repeat([q for q, *_ in found], lengths)
                at = pa.array(np.concatenate([d for _, d, _ in found]))
                yield pa.RecordBatch.from_arrays([pa.array(names, kind).take(pa.array(which)), doc_ids.take(at), pa.array(np.concatenate([s for *_, s in found]))], names=["item_id", "doc_id", "score"])

        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += len(batch["terms"].flatten())
            if size >= shard:
                yield from ranked(parts)
                parts, size = [], 0
        if parts:
            yield from ranked(parts)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(f"item_id {ids}")["item_id"].dataType)
    return held.mapInArrow(run, f"item_id {ids}, doc_id long, score long")
