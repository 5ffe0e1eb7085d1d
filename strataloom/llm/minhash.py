"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets decide."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import kept_in_worker, per_batch, whole_texts
from .linking import link_buckets

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: MinHash samples of one permutation, the least of each bin: many bins for sets of up to ``SMALL`` shingles, of which
#: then hardly any is lost, and fewer for pairs with a larger set. An odd sketch folds each into this many 64-bit words.
BINS, WORDS, SMALL = (1 << 16, 1 << 12), 32, 2000
#: Pairs of one text that are verified in one place at most, on average.
SHARE = 32
#: Sets of so many shingles at most travel whole with their sketches.
WHOLE = 256


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > 300_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: dict, words: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z lowered; of the whole sequence, if it is shorter; none without words."""
    tokens = text.encode().lower().split()  # bytes know no other case than A-Z and no other space than \x20 and \x09-\x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    span = min(words, len(tokens))
    x = np.full(len(tokens) - span + 1, span, np.uint64)
    for k in range(span):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(tokens) - span + 1 + k])
    return np.unique(x)


def _functions() -> tuple:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32), rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(own: np.ndarray, functions: tuple) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Band keys of a set, its odd sketches, and how many samples each holds.

    The bands take ``SAMPLES`` independent MinHash values. Each of the two sketches, one behind the other, takes one
    permutation's least value in each of its bins, as many as have any, and each of these samples flips one bit: equal
    samples of two sets cancel out.
    """
    a, b, r = functions
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (x[None, i : i + 4096] * a[:, None] + b[:, None]).min(1))
    bands = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = _mix((bands * r).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = np.sort(_mix(own))  # by bin, which the highest bits name, then by value
    odd, filled = [], []
    for count in BINS:
        bins = z >> np.uint64(65 - count.bit_length())
        samples = z[np.concatenate([[True], bins[1:] != bins[:-1]])]
        places = _mix(samples) % np.uint64(64 * WORDS)
        odd.append(np.packbits((np.bincount(places.astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64))
        filled.append(len(samples))
    return keys.view(np.int64), np.concatenate(odd), filled


def features(docs: DataFrame, words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, f0, f1, keys array<long>, odd array<long>, filled array<int>, whole array<long>): size, 128-bit identity, band keys and odd sketches of each text's set, and the set itself if it is small, else null."""

    def work(cols: dict) -> dict:
        known, functions = kept_in_worker(("word hashes",), _WordHashes), kept_in_worker(("minhash functions",), _functions)
        out = {k: [] for k in ("n", "f0", "f1", "keys", "odd", "filled", "whole")}
        for text in cols["text"]:
            own = shingles(text, known, words)
            keys, odd, filled = signature(own, functions) if len(own) else (np.zeros(0, np.int64), np.zeros(2 * WORDS, np.int64), [0, 0])
            f = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
            for k, v in zip(out, (len(own), int(f[0]), int(f[1]), keys, odd, filled, own.view(np.int64) if len(own) <= WHOLE else None)):
                out[k].append(v)
        return {"doc_id": cols["doc_id"]} | out

    return per_batch(whole_texts(docs, id_col, text_col), work, "doc_id long, n long, f0 long, f1 long, keys array<long>, odd array<long>, filled array<int>, whole array<long>")


def may_reach(a, b, least: float, errors: float = 5.5):
    """Whether two sets (structs of odd, filled, n) may be at a similarity of ``least``, by sizes and by the odd bits of their sketches' XOR.

    d odd bits of B stand for -B / 2 * log(1 - 2 d / B) samples that only one side has; what is left of both is equal.
    At a similarity of ``least`` so many bins would have a sample of either set, and ``least`` of them equal ones; what the
    sets' samples are beyond these differs, which is two samples of a bin where both sets fill it. The
    sketches of the finer bins speak for pairs of small sets. A pair may fall short by one sample and ``errors``
    standard errors: of the odd bits, of the choice of samples, and of the number of bins that have any.
    """
    bits, union = float(64 * WORDS), (a["n"] + b["n"]) / F.lit(1 + least)
    fine = F.greatest(a["n"], b["n"]) <= SMALL
    first, at = F.when(fine, 1).otherwise(WORDS + 1), F.when(fine, 1).otherwise(2)
    bins = F.when(fine, float(BINS[0])).otherwise(float(BINS[1]))
    # One short expression for either level: unrolled it would be more code than a method may have.
    odd = F.aggregate(F.zip_with(F.slice(a["odd"], first, F.lit(WORDS)), F.slice(b["odd"], first, F.lit(WORDS)), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    held = F.element_at(a["filled"], at) + F.element_at(b["filled"], at)
    empty = F.exp(-union / bins)
    either = (1 - empty) * bins
    only = F.greatest(held - either * (2 * least), F.lit(0.0))
    by_bits = (F.exp(4 * only / bits) - 1) * (bits / 4) - only
    by_choice = either * (least * (1 - least)) * (1 - either / union)
    by_bins = empty * (1 - (1 + union / bins) * empty) * bins
    sizes = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * F.lit(least) - 1e-6
    # So many samples may differ, and so many bits then are odd at most.
    differ = held - 2 * (either * least - 1 - F.sqrt(by_bits / 4 + by_choice + by_bins * least**2) * errors)
    return F.when(~sizes, False).otherwise(odd <= (1 - F.exp(differ * (-2 / bits))) * (bits / 2) + 1e-9)


def may_link(a, b, least: float):
    """Whether two small sets, which travel whole, reach ``least``; for others what ``may_reach`` says."""
    reach = F.size(F.array_intersect(a["whole"], b["whole"])) * F.lit(1 + least) >= (a["n"] + b["n"]) * F.lit(least) - 1e-6
    sizes = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * F.lit(least) - 1e-6
    return F.when(~sizes, False).when(a["whole"].isNull() | b["whole"].isNull(), may_reach(a, b, least)).otherwise(reach)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: documents are linked where 100 * intersection >= percent * union.

    Texts of equal sets are one node, the smallest id of them. The 160 MinHash samples of a node make 32 bands of 5 (a
    pair at 0.8 shares no band with probability 3e-6); nodes that share a band are compared as ``link_buckets`` says.
    A pair goes on if its sets, where both are small enough to travel whole, reach ``percent``, else if the odd sketches say that it may (``may_reach``); it is linked if its full
    sets say so. Texts without words have no shingles and stay alone. Rows of one id count as one
    document in links: if their texts differ, any of them links it, and each row's component is that of its own text's
    class; rows without an id are linked with nothing (component null) and kept.
    """
    table = staged(features(docs, words, id_col, text_col), "features")
    nodes = table.filter("n > 0 and doc_id is not null").groupBy("f0", "f1").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd"), F.first("filled").alias("filled"), F.first("whole").alias("whole"))
    nodes = staged(nodes, "nodes")
    buckets = nodes.select(F.explode("keys").alias("key"), "node", F.col("n").cast("int").alias("m"))

    def verify(near: DataFrame) -> DataFrame:
        """Pairs are dealt to bins of about 256, by that end which is in most pairs (``SHARE`` of its pairs stay together); a bin gets each text once."""
        near = staged(near, "pairs")
        bins = 1 + near.count() // 256
        degree = near.select(F.col("a").alias("n")).union(near.select("b")).groupBy("n").agg(F.count("*").alias("d"))
        both = near.join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
        first = F.col("da") >= F.col("db")
        hub, other, d = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a"), ("da", "db")))
        dealt = staged(both.select(F.pmod(F.xxhash64(hub, F.pmod(F.xxhash64(other), F.ceil(d / SHARE))), F.lit(bins)).alias("bin"), "a", "b"), "pairs")
        wanted = dealt.select(F.col("bin").alias("at"), F.col("a").alias("doc_id")).union(dealt.select("bin", "b")).distinct()
        texts = whole_texts(docs, id_col, text_col).join(wanted, "doc_id").select("at", "doc_id", "text")

        def check(pairs: pa.Table, texts: pa.Table) -> pa.Table:
            known, sets = kept_in_worker(("word hashes",), _WordHashes), {}
            for node, text in zip(texts["doc_id"].to_pylist(), texts["text"]):
                sets.setdefault(node, []).append(shingles(text.as_py(), known, words))

            def linked(x: np.ndarray, y: np.ndarray) -> bool:
                same = len(np.intersect1d(x, y, assume_unique=True))
                return same > 0 and 100 * same >= percent * (len(x) + len(y) - same)

            found = [(a, b) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()) if any(linked(x, y) for x in sets.get(a, ()) for y in sets.get(b, ()))]
            return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

        return dealt.groupBy("bin").cogroup(texts.groupBy("at")).applyInArrow(check, "a long, b long")

    traits = nodes.groupBy("node").agg(F.first(F.struct("odd", "filled", "n", "whole")).alias("s"))
    
    def close(x, y):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    comps = link_buckets(buckets, traits, close, lambda x, y: may_link(x, y, percent / 100), verify, sift=True)
    classes = nodes.join(comps, "node", "left").select("f0", "f1", F.coalesce("component", "node").alias("own"))
    out = table.select("doc_id", "n", "f0", "f1").join(classes, ["f0", "f1"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("own"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
