"""Leaks, search and divergence against brute force on small fixtures with every odd case."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import divergence, leaks, search, words

WORD, LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = {c: c + 32 for c in range(65, 91)}
#: Columns whose names the operators use themselves.
EXTRA = ["key", "w", "n", "term", "class", "at", "lang2", "score", "rank", "_leak_key2"]


def cut(text, pattern=WORD):
    return re.findall(pattern, (text or "").translate(UPPER))


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    out = spark.createDataFrame(rows, schema)
    for name in EXTRA:
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    vocabulary = ["the", "Of", "Ñandú", "straße", "x1", "Éa", "42", "𝒜b"] + ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 6)))) for _ in range(120)]
    some = lambda n: [vocabulary[int(min(len(vocabulary) - 1, rng.exponential(14)))] for _ in range(n)]
    items = [(i, " ".join(some(int(rng.integers(10, 30))))) for i in range(12)]
    items += [(20, "only four words here"), (20, "another Text of the SAME item, long enough to be cut into more than one window"), (21, None), (22, "  .,;"), (None, " ".join(some(14))), (23, items[0][1]), (24, "solo")]
    docs = [(i, " ".join(some(int(rng.integers(0, 60)))), ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4]) for i in range(150)]
    for i in range(40):
        text = items[i % 12][1]
        docs.append((200 + i, f"{' '.join(some(8))}, {text.upper() if i % 2 else text}!\n{' '.join(some(9))} ", "en", "hot"))
    docs += [(300, None, None, None), (301, "", "fr", "empty"), (302, " \t.", "fr", "Empty"), (303, "... only FOUR words, here! and solo (" + items[14 + 4][1] + ")", "en", "a"), (None, items[3][1], "en", "a"), (None, items[3][1], "en", "a"), (5, "the same id, other text " + items[2][1], "en", "a"), (304, "the of straße the " * 9000 + items[1][1], "en", "b")]
    docs += [docs[160]] * 3
    return docs, items


def brute_leaks(docs, items, size=10):
    held = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            held.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths, out = {len(x) for x in held}, []
    for doc_id, text, *_ in docs:
        w, hit, own = cut(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := held.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    own |= found
        names = sorted(str(x) for x in own if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("bounds", [{}, {"most_windows": 0}])
def test_leaks_equal_brute_force(spark, corpus, bounds, monkeypatch):
    docs, items = corpus
    if bounds:
        monkeypatch.setattr(leaks, "MOST_CLASSES", 0)
    got = leaks.leak_digest(frame(spark, docs), frame(spark, items, "item_id long, text string"), **bounds)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_leaks(docs, items)))


def test_leaks_of_empty_tables(spark, corpus):
    docs, items = corpus
    none, nothing = frame(spark, [], "item_id long, text string"), frame(spark, [])
    assert not any(r["contaminated"] for r in leaks.leak_digest(frame(spark, docs), none).collect())
    assert leaks.leak_digest(nothing, frame(spark, items, "item_id long, text string")).count() == 0


def test_removal_leaves_the_other_words_as_they_are(spark, corpus):
    docs, items = corpus
    held = frame(spark, items, "item_id long, text string")
    got = leaks.without_leaks(frame(spark, docs), held)
    assert got.columns == frame(spark, docs).columns and got.count() == len(docs)
    rows = {(r["doc_id"], r["lang"], r["source"], len(cut(r["text"]))): r["text"] for r in got.collect()}
    hits = {(d[0], d[2], d[3], n - h): (d[1], h) for d, (_, n, h, *_) in zip(docs, brute_leaks(docs, items))}
    assert rows.keys() == hits.keys()
    for k, (text, hit) in hits.items():
        assert hit or rows[k] == text  # a null stays null
    small = frame(spark, [(1, "Well: " + items[0][1] + "; said\n")], "doc_id long, text string")
    assert leaks.without_leaks(small, held).first()["text"] == "Well; said\n"
    assert leaks.without_leaks(small, held, most_share=0.5).count() == 0
    assert [tuple(r)[1:3] for r in leaks.leaked_spans(small, held).collect()] == [(1, 1 + len(cut(items[0][1])))]


def brute_search(docs, items, k=20):
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(cut(text))
    own = [(d[0], Counter(cut(d[1]))) for d in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total, df = len(own), sum(x[2] for x in own), Counter(t for _, c, _ in own for t in c)
    out = []
    for item, terms in asked.items():
        scored = []
        for doc_id, c, size in own:
            m = 75 + 25 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else doc_id, -s) for r, (s, null, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("how", [{}, {"k": 3}, {"k": 1000}, {"shard": 300}, {"block_terms": 40, "shard": 2000}])
def test_search_equals_brute_force(spark, corpus, how):
    docs, items = corpus
    got = search.search(frame(spark, docs), frame(spark, items, "item_id long, text string"), **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == brute_search(docs, items, how.get("k", 20))


def test_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    assert search.search(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    assert search.search(frame(spark, docs), frame(spark, [], "item_id long, text string")).count() == 0


def test_levels_end_early_and_lose_nothing():
    rng, completed = np.random.default_rng(3), 0

    class Watched(search.Shard):
        def _complete(self, *a):
            nonlocal completed
            completed += 1
            return super()._complete(*a)

    n_docs, n_terms = 4000, 60
    for turn in range(20):
        holds = rng.random((n_docs, n_terms)) < np.linspace(0.4, 0.002, n_terms)
        doc, term = np.nonzero(holds)
        impact = (np.linspace(1, 40, n_terms)[term] * 100).astype(np.int64) * rng.integers(20, 30 if turn % 2 else 22, len(doc))
        shard, asked, times = Watched(doc.astype(np.int32), term, impact, n_docs, n_terms), rng.choice(n_terms, 25, replace=False), rng.integers(1, 3, 25)
        scores = np.zeros(n_docs, np.int64)
        weight = np.zeros(n_terms, np.int64)
        weight[asked] = times
        np.add.at(scores, doc, weight[term] * impact)
        docs, got = shard.best(asked, times, 20)
        assert (got == scores[docs]).all()
        assert sorted(got, reverse=True)[:20] == sorted(scores[scores > 0], reverse=True)[:20]
        assert set(np.flatnonzero(scores >= np.sort(scores)[-20])) <= set(docs)  # ties at the end included
    assert completed


def brute_divergence(docs, least, most):
    rows = [(lang or "", source or "", Counter(cut(text, LETTERS))) for _, text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for r in own for t in r[2])
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        sums = {s: sum((r[2] for r in own if r[1] == s), Counter()) for s in {r[1] for r in own}}
        p, q = {s: share(c) for s, c in sums.items()}, share(sum((r[2] for r in own), Counter()))
        for s in sums:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sums if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if sums[s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, i.decode(), -v, r) for part, found in (("pair", pairs), ("term", sorted(terms)[:most])) for r, (v, i) in enumerate(sorted(found), 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("how", [{}, {"least": 3, "most": 7}, {"least": 10**6}])
def test_divergence_equals_brute_force(spark, corpus, how, monkeypatch):
    docs, _ = corpus
    got = divergence.divergence(frame(spark, docs).drop("lang2"), **how)
    assert sorted(map(str, map(tuple, got.collect()))) == brute_divergence(docs, how.get("least", 30), how.get("most", 50))


def test_divergence_without_broadcast_and_of_nothing(spark, corpus, monkeypatch):
    docs, _ = corpus
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    got = divergence.divergence(frame(spark, docs), least=5)
    assert sorted(map(str, map(tuple, got.collect()))) == brute_divergence(docs, 5, 50)
    assert divergence.divergence(frame(spark, [])).count() == 0


def test_shares_are_exact_beyond_what_a_product_holds(spark):
    rows = [(9 * 10**12 + 7, 8_999_999_999_999_999), (3, 7), (8_999_999_999_999_998, 8_999_999_999_999_999), (5, 8 * 10**15)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", F.expr(divergence._share("c", "t"))).collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(c, t, 1 + 10**9 * c // t) for c, t in rows]


def test_words_are_those_of_the_pattern(spark):
    texts = ["", None, "A-b_C1", "İI ẞß", "ÀÉ Zz\x7f\x80\u0085", "1a2B", "𝒜Z z", "{|}~@[`"]
    got = [list(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words.word_array(F.col("t"))).collect()]
    assert got == [cut(t) for t in texts]
    for digits, pattern in ((True, WORD), (False, LETTERS)):
        assert [[x.decode() for x in (t or "").encode().translate(words.byte_table(digits)).split()] for t in texts] == [cut(t, pattern) for t in texts]
