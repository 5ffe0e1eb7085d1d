"""Seatings against an enumeration of all of them, pairs against direct counts, and what the scores say about texts."""

import zlib

import numpy as np

from strataloom.llm import lm


def enumerated(c, a, d, base):
    """Probabilities of 1 to c tables by walking through every way to seat c customers of one dish one after the other."""
    weight = np.zeros(c + 1)

    def walk(sizes, w):
        if sum(sizes) == c:
            weight[len(sizes)] += w
            return
        for i, n in enumerate(sizes):
            walk([*sizes[:i], n + 1, *sizes[i + 1 :]], w * (n - d))
        walk([*sizes, 1], w * (a + d * len(sizes)) * base)

    walk([], 1.0)
    return weight[1:] / weight.sum()


def test_seats_are_drawn_as_an_enumeration_has_them():
    n = 20_000
    for c, a, d, base in ((2, 1.0, 0.5, 0.2), (4, 3.0, 0.75, 0.4), (6, 0.5, 0.3, 0.05)):
        t = lm.seat(np.full(n, c), np.full(n, base), np.full(n, a), d, (np.arange(n) + 0.5) / n)
        assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - enumerated(c, a, d, base)).max() < 2 / n + 1e-3


def test_draws_are_uniform_and_depend_on_keys_alone():
    x = lm.draws(np.arange(50_000), 3)
    assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.01 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.02
    assert (lm.draws(np.arange(100)[::-1], 3)[::-1] == lm.draws(np.arange(100), 3)).all() and (lm.draws(np.arange(9), 3) != lm.draws(np.arange(9), 4)).any()


def test_pairs_are_counted_and_tables_stay_in_bounds():
    rng = np.random.default_rng(1)
    u, w, c = rng.integers(0, 20, 500).astype(np.uint64), rng.integers(0, 30, 500), rng.integers(0, 9, 500)
    x = np.arange(30).astype(np.uint64) * np.uint64(1000)
    pairs = lm.Pairs(u, w, x, c, 4, 6, 3)
    want: dict = {}
    for a, b, n in zip(u.tolist(), w.tolist(), c.tolist()):
        want[a, b] = want.get((a, b), 0) + n
    names = [(a, b) for a, b in zip(pairs.contexts[pairs.u].tolist(), pairs.w.tolist())]
    assert dict(zip(names, pairs.count.tolist())) == want and [names[i] for i in pairs.place] == list(zip(u.tolist(), w.tolist()))
    assert (pairs.tables <= pairs.count).all() and (pairs.tables >= np.minimum(pairs.count, 1)).all()
    turned = lm.Pairs(u[::-1], 29 - w[::-1], x[::-1], c[::-1], 4, 6, 3)  # other places, the same words
    tables = dict(zip(zip(turned.contexts[turned.u].tolist(), (29 - turned.w).tolist()), turned.tables.tolist()))
    assert tables == dict(zip(names, pairs.tables.tolist()))


def texts():
    rng = np.random.default_rng(2)
    follow = {i: rng.permutation(60)[:3] for i in range(60)}  # after each word one of three

    def walk(n):
        at, out = int(rng.integers(0, 60)), []
        for _ in range(n):
            out.append(f"w{at}")
            at = int(rng.choice(follow[at]))
        return out

    return [walk(80) for _ in range(150)]


def test_the_order_of_words_counts(spark):
    own = texts()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(t)) for i, t in enumerate(own)]
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    extra = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(out)]
    rows += [(e, " ".join(rng.permutation(own[i]))) for e, i in zip(extra, out)]
    frame = spark.createDataFrame([*rows, rows[0], (7, None), (None, "")], "doc_id long, text string")
    scored = lm.score_texts(frame, block_bytes=20_000, part_bytes=30_000).collect()
    assert len(scored) == len(rows) + 3
    got = {r["doc_id"]: r for r in scored if r["doc_id"] != 7}
    for e, i in zip(extra, out):
        assert got[i]["held_out"] and got[i]["score"] > got[e]["score"] + 10  # the same words in the order of the language
        assert abs(got[i]["base_score"] - got[e]["base_score"]) < 1e-9
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)
    one = {(r["doc_id"], r["score"]) for r in scored if r["doc_id"] == rows[0][0]}
    assert len(one) == 1  # equal rows


def test_probabilities_add_up(spark):
    """Behind the beginning, all words of training, the end and one unseen word together have probability 1."""
    rows = [(i, t) for i, t in enumerate(["a b a", "b a", "a c a b", "c"] * 5) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:8]
    probes = list(zip(held, ["", "a", "b", "c", "zz", "a a", "b a", "zz a"]))
    got = {t: 10 ** r["score"] for r in lm.score_texts(spark.createDataFrame(rows + probes, "doc_id long, text string")).collect() for i, t in probes if r["doc_id"] == i}
    # P(w at the beginning) = P(w and end) / P(end behind w); the end behind w stands in "w w'" only through other pairs, so bounds do.
    assert 0 < got["zz"] < got["a"] < 1 and got["zz a"] < got["b a"]
    assert got[""] + got["a"] + got["b"] + got["c"] + got["zz"] < 1
