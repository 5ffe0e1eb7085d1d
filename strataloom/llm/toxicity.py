"""Toxicity by multiple-instance learning: sentence scores, joined by a noisy-or, are trained from document labels."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged, unstaged
from .common import per_batch, whole_texts

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings of four and six letters, which inflected and compound forms share."""
    return word, word[:4] + "*", word[:6] + "*"


class Model:
    """P(document) = 1 - (1 - leak) * product over sentences of (1 - logistic(bias + sum of the weights of its distinct words' features))."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float) -> None:
        self.weights, self.bias, self.leak = weights, bias, leak
        self.known: dict[str, float] = {}
        self.quiet = float(np.logaddexp(0, bias))  # -log(1 - p) of a sentence without a known word

    def score(self, text: str) -> tuple[float, int, int, float]:
        """Score of the text; begin, end and score of its worst sentence (-1, -1, 0 if there is none)."""
        known, lower = self.known, text.lower()
        if len(known) > 200_000:
            known.clear()
        own = lower if len(lower) == len(text) else "".join(c.lower()[0] for c in text)
        total, top, where = -np.log1p(-self.leak), -np.inf, (-1, -1)
        for m in SENTENCE.finditer(own):
            s = 0.0
            for w in set(WORD.findall(m[0])):
                v = known.get(w)
                if v is None:
                    v = known[w] = sum(self.weights.get(x, 0.0) for x in features(w))
                s += v
            if s == 0.0:
                total += self.quiet
            else:
                total += np.logaddexp(0.0, self.bias + s)
            if s > top:
                top, where = s, m.span()
        return float(-np.expm1(-total)), *where, float(1 / (1 + np.exp(-self.bias - top))) if where[0] >= 0 else 0.0


def counted(docs: DataFrame) -> DataFrame:
    """(feature, n0, n1): in how many documents of label 0 and 1 each feature stands. ``docs``: (text, y)."""

    def work(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
                for x in {f for w in set(WORD.findall(text.lower())) for f in features(w)}:
                    seen.setdefault(x, [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(seen), pa.string()), "n0": pa.array([n[0] for n in seen.values()], pa.int64()), "n1": pa.array([n[1] for n in seen.values()], pa.int64())})

    return docs.mapInArrow(work, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def chosen(counts: DataFrame, n: dict[int, int], most: int) -> list[str]:
    """The ``most`` features whose odds between the labels stand furthest from chance, in order of their names."""
    total = [n[0] + 1.0, n[1] + 1.0]
    share = (F.col("n0") + F.col("n1") + 1) / F.lit(sum(total))
    z = F.abs(F.col("n1") - F.lit(total[1]) * share) / F.sqrt(F.lit(total[1] * total[0] / sum(total)) * share * (1 - share) + 1e-9)
    best = counts.filter("n0 + n1 >= 4").select("feature", z.alias("z")).filter("z >= 4").orderBy(F.desc("z"), "feature").limit(most)
    return sorted(r["feature"] for r in best.collect())


def coded(docs: DataFrame, names: list[str]) -> DataFrame:
    """(y, w, sizes, times, columns): of each document its distinct sentences as lists of chosen features, and how often each list occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(names)  # as many as were chosen at most

    def work(batches):
        column = {x: i for i, x in enumerate(shared.value)}
        for batch in batches:
            sizes, times, columns = [], [], []
            for text in batch["text"].to_pylist():
                bag: dict[tuple, int] = {}
                for m in SENTENCE.finditer(text.lower()):
                    own = tuple(sorted(column[f] for x in set(WORD.findall(m[0])) for f in features(x) if f in column))
                    bag[own] = bag.get(own, 0) + 1
                own = sorted(bag)
                sizes.append([len(x) for x in own])
                times.append([bag[x] for x in own])
                columns.append([c for x in own for c in x])
            yield pa.RecordBatch.from_arrays([batch["y"], batch["w"], *(pa.array(x, pa.list_(pa.int32())) for x in (sizes, times, columns))], ["y", "w", "sizes", "times", "columns"])

    return docs.mapInArrow(work, "y int, w double, sizes array<int>, times array<int>, columns array<int>")


def slope(batch: pa.RecordBatch, theta: np.ndarray) -> np.ndarray:
    """The gradient of the noisy-or's likelihood over a batch of ``coded`` rows; the last two of ``theta`` are bias and leak."""
    flat = lambda name: batch[name].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, times, columns = flat("sizes"), flat("times"), flat("columns")
    y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
    of_doc = np.repeat(np.arange(len(y)), pa.compute.list_value_length(batch["sizes"]).to_numpy(zero_copy_only=False))
    of_row = np.repeat(np.arange(len(sizes)), sizes)
    zs = theta[-2] + np.bincount(of_row, theta[columns], minlength=len(sizes))
    q = np.exp(-np.bincount(of_doc, times * np.logaddexp(0, zs), minlength=len(y)) - np.logaddexp(0, theta[-1]))
    pull = np.where(y == 1, q / np.maximum(1 - q, 1e-6), -1.0) * w  # d likelihood / d (sum of -log(1-p))
    gs = pull[of_doc] * times / (1 + np.exp(-zs))
    return np.concatenate([np.bincount(columns, gs[of_row], minlength=len(theta) - 2), [gs.sum(), (pull / (1 + np.exp(-theta[-1]))).sum()]])


def fit(rows: DataFrame, names: list[str], size: float, rounds: int = 60) -> Model:
    """Trains by gradient on the likelihood of the noisy-or; each round is one pass over ``rows`` (as ``coded`` gives them) that returns one vector a task."""
    theta = np.zeros(len(names) + 2)
    theta[-2:] = -5.0, -3.0
    m = [np.zeros(len(theta)) for _ in range(2)]
    for step in range(1, rounds + 1):

        def work(batches, theta=theta):
            total = np.zeros(len(theta))
            for batch in batches:
                total += slope(batch, theta)
            yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

        parts = rows.mapInArrow(work, "g binary").collect()  # a vector of a bounded length from each task
        # Rounded, as the order of the parts may differ.
        grad = np.round(sum((np.frombuffer(r["g"]) for r in parts), np.zeros(len(theta))), 7)
        grad[:-2] -= 0.3 * theta[:-2]
        grad /= size
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        rate = 0.4 * (1 - 0.8 * (step - 1) / rounds)
        theta = theta + rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        theta[-2] = min(-3.0, theta[-2])
    return Model({x: float(v) for x, v in zip(names, theta) if abs(v) > 1e-3}, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """True where crc32 of the id as text falls into the fold that training never sees; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 5000, most: int = 4000, rounds: int = 60, parts: int = 8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most ``toxic`` documents of label 1 and ``clean`` of label 0, those of the smallest id hashes outside the held-out fold.

    Texts stay on the executors: features are counted there, ``most`` of them at most come to the driver, and so does one
    gradient from each of ``parts`` tasks in each of ``rounds`` passes over the coded sentences.

    The classes are weighted back to their shares among all labelled rows. Null labels are left out; of several labels
    for an id the largest holds. Without labels the model scores every document near 0.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").filter(~held_out())
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(11), "doc_id")
    picked = own.filter("y = 1").orderBy(order, "doc_id").limit(toxic).union(own.filter("y = 0").orderBy(order, "doc_id").limit(clean))
    # At most toxic + clean rows of two numbers: a bound that is known beforehand.
    texts = staged(whole_texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("y", "text"), "labelled")
    n = {v: 0 for v in (0, 1)} | {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    names = chosen(counted(texts), n, most)
    share = {v: counts.get(v, 0) / max(1, n[v]) for v in n}
    mean = sum(n[v] * share[v] for v in n) / max(1, sum(n.values())) or 1.0
    rows = staged(coded(texts.withColumn("w", F.when(F.col("y") == 1, share[1] / mean).otherwise(share[0] / mean)).repartition(parts), names), "sentences")
    model = fit(rows, names, sum(n.values()) or 1.0, rounds)
    unstaged(texts)
    unstaged(rows)
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_start, worst_end, worst_score) for every whole text.

    ``worst_*``: the sentence with the highest score, in code points (-1 where a text has none). Null and empty texts
    get the leak alone; equal texts get equal scores; every row gives a row. The score sees nothing but the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))  # a bounded number of features

    def work(cols: dict) -> dict:
        own = Model(*shared.value)
        got = [own.score(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "score": [g[0] for g in got], "predicted": [int(g[0] >= threshold) for g in got], "worst_start": [g[1] for g in got], "worst_end": [g[2] for g in got], "worst_score": [g[3] for g in got]}

    out = per_batch(whole_texts(docs, id_col, text_col), work, "doc_id long, score double, predicted int, worst_start long, worst_end long, worst_score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "worst_start", "worst_end", "worst_score")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns and their values stay as they are.

    Null texts score as empty ones and stay; repeated rows stay or go together; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))  # a bounded number of features

    def keep(batches):
        own = Model(*shared.value)
        for batch in batches:
            flags = [own.score(t or "")[0] < threshold for t in batch[text_col].to_pylist()]
            yield batch.filter(pa.array(flags))

    return docs.mapInArrow(keep, docs.schema)
