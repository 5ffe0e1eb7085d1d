"""Language-model scores by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps."""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released, staged, unstaged
from .common import trimmed, whole_texts

# The letters that have a symbol of their own, besides digits, full stop, comma, other ASCII, other characters, start and end.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñíóáúàâîôûëï"
OWN = LETTERS + ".,"
START, END, DIGIT, ASCII, OTHER = 0, 1, 2, 3, 4
ALPHABET = 5 + len(OWN)
#: Characters of context. A state of the restaurants takes ALPHABET ** (ORDER + 1) numbers, 0.6 MB, and goes to every executor; a context of k characters shares the restaurant of its last k - 1 as parent.
ORDER = 2
DISCOUNT, STRENGTH = (0.3, 0.5, 0.6), (1.0, 1.0, 1.0)
WORD_STRENGTH = 100.0
#: Of the restaurants of words behind a word.
PAIR_DISCOUNT, PAIR_STRENGTH = 0.75, 1.0
#: Customers of a dish up to which seatings are counted exactly.
EXACT = 512
#: What stands before the first word of a text; no word holds a line break.
BEGIN = b"\n"


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point below 0x180, and log10 of a character's share within each symbol."""
    symbol = np.full(0x180, OTHER, np.int64)
    symbol[:128] = ASCII
    symbol[ord("\n")] = END
    for c in "0123456789":
        symbol[ord(c)] = DIGIT
    for i, c in enumerate(OWN):
        symbol[ord(c)] = 5 + i
    inside = np.zeros(ALPHABET)
    inside[DIGIT], inside[ASCII], inside[OTHER] = -1.0, -np.log10(128), -np.log10(0x110000)
    return symbol, inside


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, each closed by END; the number of its context of ``ORDER`` symbols; each word's first place; within-symbol logs.

    The empty word stands for the end of a text.
    """
    symbol, inside = _classes()
    points = np.frombuffer((b"\n".join(words) + b"\n").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    s = np.where(points < 0x180, symbol[np.minimum(points, 0x17F)], OTHER)
    ends = np.flatnonzero(s == END)
    first = np.concatenate([[0], ends[:-1] + 1])
    at = np.arange(len(s)) - np.repeat(first, np.diff(np.concatenate([first, [len(s)]])))
    context = np.zeros(len(s), np.int64)
    for back in range(ORDER, 0, -1):
        earlier = np.concatenate([np.zeros(back, np.int64), s[:-back]])[: len(s)]
        context = context * ALPHABET + np.where(at >= back, earlier, START)
    return s, context, first, inside[s]


@lru_cache(maxsize=8)
def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of up to ``EXACT`` customers at their tables, which count seatings."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[0, 0] = 0.0
    tables = np.arange(EXACT + 1)
    for n in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            joined = table[n] + np.log(np.maximum(n - discount * tables, 0.0))
        opened = np.concatenate([[-np.inf], table[n, :-1]])
        table[n + 1] = np.logaddexp(np.where(np.isnan(joined), -np.inf, joined), opened)
    return table


def seat(counts: np.ndarray, base: np.ndarray, strength: np.ndarray, discount: float, draw: np.ndarray) -> np.ndarray:
    """Tables at which ``counts`` customers of each dish sit, all of them removed and seated anew given the rest of the restaurant.

    With a = the restaurant's strength plus discount times the tables of its other dishes, t tables have the weight
    S(c, t) * a (a + d) ... (a + (t - 1) d) * base**t, S the generalised Stirling number; ``draw``, uniform in 0 to 1, picks
    one, so the same draws seat alike wherever this runs. Beyond ``EXACT`` customers the tables of the first ``EXACT`` grow by
    the power of the discount, as tables of a Pitman-Yor restaurant do.
    """
    counts = counts.astype(np.int64)
    tables = np.minimum(counts, 1)
    table = _log_stirling(discount)
    few = np.minimum(counts, EXACT)
    order = np.argsort(few, kind="stable")
    ends = np.flatnonzero(np.diff(np.concatenate([few[order], [-1]])) != 0) + 1
    start = 0
    for end in ends.tolist():
        own = order[start:end]
        c, start = int(few[own[0]]), end
        if c < 2:
            continue
        steps = np.arange(c)
        for at in range(0, len(own), max(1, 400_000 // c)):
            part = own[at : at + max(1, 400_000 // c)]
            weight = table[c, 1 : c + 1] + np.cumsum(np.log(strength[part][:, None] + discount * steps), 1) + np.log(np.maximum(base[part], 1e-300))[:, None] * (steps + 1)
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            tables[part] = 1 + (weight < draw[part][:, None] * weight[:, -1:]).sum(1)
    many = counts > EXACT
    tables[many] = np.maximum(tables[many], np.rint(tables[many] * (counts[many] / EXACT) ** discount)).astype(np.int64)
    return np.minimum(tables, counts)


def draws(keys: np.ndarray, turn: int) -> np.ndarray:
    """Uniform numbers that depend on keys and turn alone."""
    x = keys.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (_mix(x) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Spelling:
    """A state of the restaurants of characters: for each length of context the predictive probabilities, (contexts, symbols)."""

    levels: list[np.ndarray]

    def log10(self, words: list[bytes]) -> np.ndarray:
        s, context, first, inside = spelled(words)
        return np.add.reduceat(np.log10(self.levels[-1][context, s]) + inside, first) if len(words) else np.zeros(0)


def uniform_spelling() -> Spelling:
    table = np.full((ALPHABET**ORDER, ALPHABET), 1 / (ALPHABET - 1), np.float32)
    table[:, START] = 1e-30
    return Spelling([table])


def gibbs(context: np.ndarray, symbol: np.ndarray, count: np.ndarray, sweeps: int, keep: int, seed: int) -> list[Spelling]:
    """Sweeps over the restaurants of characters; the last ``keep`` states.

    A sweep seats the customers of the longest contexts given the predictive probabilities of their parents; each table
    sends a customer to the parent, and so on down to the empty context, whose parent is uniform. Then the predictive
    probabilities are formed from the top. The arrays are at most ALPHABET ** ORDER contexts long, whatever the corpus.
    """
    base0 = np.full(ALPHABET, 1 / (ALPHABET - 1))
    base0[START] = 1e-30
    predictive = [np.tile(base0, (ALPHABET**k, 1)) for k in range(ORDER + 1)]
    tables_of: list[np.ndarray] = [np.zeros(ALPHABET**k) for k in range(ORDER + 1)]
    kept = []
    for sweep in range(sweeps):
        c, s, n = context, symbol, count
        found: list[tuple] = []
        for k in range(ORDER, -1, -1):
            parent = base0[s] if k == 0 else predictive[k - 1][c % ALPHABET ** (k - 1), s]
            t = seat(n, parent, STRENGTH[k] + DISCOUNT[k] * tables_of[k][c], DISCOUNT[k], draws((c * ALPHABET + s).astype(np.int64), seed * 1000 + sweep * 10 + k))
            tables_of[k] = np.bincount(c, t, minlength=ALPHABET**k)
            found.append((k, c, s, n, t))
            if k:
                key = (c % ALPHABET ** (k - 1)) * ALPHABET + s
                u, back = np.unique(key, return_inverse=True)
                c, s, n = u // ALPHABET, u % ALPHABET, np.bincount(back, t).astype(np.int64)
        for k, c, s, n, t in reversed(found):
            total = np.bincount(c, n, minlength=ALPHABET**k)
            up = base0[None, :] if k == 0 else predictive[k - 1][np.arange(ALPHABET**k) % ALPHABET ** (k - 1)]
            p = (STRENGTH[k] + DISCOUNT[k] * tables_of[k])[:, None] * up
            p[c, s] += n - DISCOUNT[k] * t
            predictive[k] = p / (total + STRENGTH[k])[:, None]
        if sweep >= sweeps - keep:
            kept.append(Spelling([predictive[ORDER].astype(np.float32)]))
    return kept


#: What a block sends to a part: words, how many pairs end in each, the first words of these, their counts, the texts of the block that hold them, and which texts are held out.
PACKED = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in ("words", "pairs", "u", "n", "docs", "flags"))])
PACKED_DDL = "kind string, part long, block long, words binary, pairs binary, u binary, n binary, docs binary, flags binary"


class _Numbers(dict):
    """Words by the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches, block_bytes: int):
    """(words, word of each token, length of each text, flags, names) of a partition in blocks of about so many bytes, of under 60,000 texts.

    A text's tokens are its words and a closing end; names are pairs of hashes. Only numbers of words are held, not the texts.
    """

    def begun():
        return _Numbers({BEGIN: 0, b"": 1}), array("I"), [], [], []

    (place, ids, lengths, flags, names), size = begun(), 0
    for batch in batches:
        for text, flag, *name in zip(batch["text"], *(batch[k].to_pylist() for k in ("held_out", "h0", "h1"))):
            raw = text.as_py().encode()
            words = raw.lower().split()  # bytes know no other case than A-Z and no other space than \x20 and \x09-\x0D
            ids.extend(map(place.__getitem__, words))
            ids.append(1)
            lengths.append(len(words) + 1)
            flags.append(flag)
            names.append(name)
            size += len(raw)
            if size >= block_bytes or len(flags) >= 60_000:
                yield list(place), np.array(ids, np.int64), np.array(lengths), np.array(flags, np.uint8), np.array(names, "<i8")
                (place, ids, lengths, flags, names), size = begun(), 0
    if flags:
        yield list(place), np.array(ids, np.int64), np.array(lengths), np.array(flags, np.uint8), np.array(names, "<i8")


def _before(w: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each token; the beginning (0) before the first of a text."""
    u = np.concatenate([[0], w[:-1]])
    u[np.cumsum(lengths)[:-1]] = 0
    return u


def _hash(words: list[bytes]) -> np.ndarray:
    """40 bits of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(24)


def _pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(u * np.uint64(0x9E3779B97F4A7C15) + w)


def _bytes40(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype(np.uint8).tobytes()


def _from40(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


class Pairs:
    """The pairs of neighbouring words of one part of the key space, their counts in training, and how they sit.

    A part is a random share of all dishes, as a hash deals them. So what it holds of a context is, times the
    number of parts, an unbiased guess of the whole, which is all that seating needs of it.
    """

    def __init__(self, u: np.ndarray, w: np.ndarray, x: np.ndarray, count: np.ndarray, parts: int, sweeps: int, keep: int) -> None:
        """``u``: hashes of first words, ``w``: places of second ones among the words whose hashes are ``x``; pairs may repeat."""
        key = w.astype(np.uint64) << np.uint64(40) | u
        order = np.argsort(key)
        key = key[order]
        starts = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        #: For each of the given pairs its place among the distinct ones.
        self.place = np.empty(len(key), np.int64)
        self.place[order] = np.cumsum(starts) - 1
        key = key[starts]
        del order, starts
        self.w = (key >> np.uint64(40)).astype(np.int64)
        #: Distinct first words, and which of them each pair has.
        self.contexts, self.u = np.unique(key & np.uint64((1 << 40) - 1), return_inverse=True)
        self.count = np.bincount(self.place, count, minlength=len(key)).astype(np.int64)
        self.tables = np.minimum(self.count, 1).astype(np.float64)  # a single customer has a table of its own
        again = np.flatnonzero(self.count > 1)
        if not len(again):
            return
        at_u, at_w, c = self.u[again], self.w[again], self.count[again]
        of_context = np.bincount(self.u, self.tables, minlength=len(self.contexts))
        of_dish, every = np.bincount(self.w, self.tables, minlength=len(x)), self.tables.sum()
        keys, t, mean = _pair_keys(self.contexts[at_u], x[at_w]), np.ones(len(again), np.int64), np.zeros(len(again))
        for sweep in range(sweeps):
            # What changes from sweep to sweep are the tables beyond the first ones of these pairs.
            more = t - 1
            in_context = of_context[at_u] + np.bincount(at_u, more, minlength=len(of_context))[at_u] - t
            share = (of_dish[at_w] + np.bincount(at_w, more, minlength=len(of_dish))[at_w]) / (every + more.sum())
            t = seat(c, share, PAIR_STRENGTH + PAIR_DISCOUNT * in_context * parts, PAIR_DISCOUNT, draws(keys, 100 + sweep))
            if sweep >= sweeps - keep:
                mean += t / keep
        self.tables[again] = mean


#: Words of so many bytes at most, which hold the most frequent ones, are spread over ``SPREAD`` places by the word before them.
SHORT, SPREAD = 4, 16


def _dealt(words: list[bytes], x: np.ndarray, u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair of places ``u`` and ``w`` among ``words``: by its second word, and for short ones by the first one, too."""
    short = np.fromiter((len(v) <= SHORT for v in words), bool, len(words))
    return (_mix(x[w] + np.where(short[w], x[u] % np.uint64(SPREAD), np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def _sent(words: list[bytes], x: np.ndarray, u: np.ndarray, w: np.ndarray, parts: int):
    """(part, places of its pairs, payload) for each part: its words once, how many pairs end in each, and the first words of these.

    The pairs come in the order of their second words, and so do the places.
    """
    part = _dealt(words, x, u, w, parts)
    order = np.lexsort((w, part))
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], part[order]]))) if len(order) else np.zeros(0, np.int64)
    for own in np.split(order, cuts[1:]) if len(order) else []:
        ends = w[own]
        first = np.flatnonzero(np.diff(np.concatenate([[-1], ends])))
        yield int(part[own[0]]), own, b"\n".join(words[i] for i in ends[first].tolist()), np.diff(np.concatenate([first, [len(own)]])).astype("<u4").tobytes(), _bytes40(x[u[own]])


def _received(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Distinct words of a part's rows, their hashes, and of all pairs, one block behind the other, the hash of the first word and the place of the second."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["u"]))
    place, u, w = _Numbers(), [], []
    for r in rows:
        own = np.fromiter(map(place.__getitem__, r["words"].split(b"\n")), np.int64)
        w.append(np.repeat(own, np.frombuffer(r["pairs"], "<u4")))
        u.append(_from40(r["u"]))
    words = list(place)
    return words, _hash(words), np.concatenate(u) if u else np.zeros(0, np.uint64), np.concatenate(w) if w else np.zeros(0, np.int64), rows


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2, sweeps: int = 6, keep: int = 3, block_bytes: int = 10 << 20, part_bytes: int = 14 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text.

    Three levels of Pitman-Yor restaurants. Each word has one for what follows it (and the beginning of texts has one); all of these share
    the restaurant of single words as parent, whose customers are their tables; its base spells words, by a hierarchy of restaurants of
    characters whose customers are the tables of words. Counts come from all training texts and grow with the corpus:

    - every block of texts gives its distinct pairs with counts, to tasks by a hash of the second word, and of both where that is
      short, as the frequent ones are; so neither a frequent word nor a frequent context lands in one task;
    - a part of the pairs seats them by Gibbs sweeps: all customers of a dish in a restaurant get up and sit down again given the others (``seat``).
      What a sweep needs of other parts it takes from its own random share. Sums of customers and tables go to the words;
    - the words, and then their spelling, are seated given these tables. Nothing is held whole but the character tables, whose size the alphabet bounds;
    - each part asks for the sums and probabilities of its words, prices every pair, and gives each text of a block the sum over its tokens.

    Tables are averaged over the last ``keep`` sweeps, and so are the probabilities of words. As in the base score, all words that
    training never saw are one type: it has what the spelling leaves to them.

    Training leaves out ids whose crc32 as text modulo ``folds`` is ``fold``; null ids train. Null and empty texts are
    one end. Equal texts score equally; every row gives a row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = whole_texts(docs, id_col, text_col).withColumn("held_out", held).withColumns({"h0": F.xxhash64("text"), "h1": F.xxhash64(F.lit(1), "text")})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, end_hash = max(1, -(-size // part_bytes)), _hash([b""])[0]

    def counted(batches):
        """Pairs and their counts in training."""
        for number, (words, w, lengths, flags, _) in enumerate(_blocks(batches, block_bytes)):
            key = _before(w, lengths) * len(words)
            key += w
            key = key * 2 + np.repeat(flags, lengths)
            key.sort()
            first = np.flatnonzero(np.diff(np.concatenate([[-1], key >> 1])))
            n = np.add.reduceat(1 - (key & 1), first).astype("<u4")
            pair = key[first] >> 1
            del key
            out = {k: [] for k in PACKED.names}
            for part, own, own_words, pairs, before in _sent(words, _hash(words), pair // len(words), pair % len(words), parts):
                for k, v in zip(out, ("b", part, number, own_words, pairs, before, n[own].tobytes(), b"", b"")):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=PACKED)
            del out, first, n, pair, w, words
            trimmed()

    packed = rows.select("text", "held_out", "h0", "h1").mapInArrow(counted, PACKED_DDL)

    def seated(table):
        """The words of a part with their counts and tables as dishes, and its contexts with theirs: one row for each hash, two only where words share it."""
        trimmed()
        words, x, u, w, packed_rows = _received(table)
        part = table["part"][0].as_py()
        count = np.concatenate([np.frombuffer(r["n"], "<u4") for r in packed_rows]).astype(np.int64)
        pairs = Pairs(u, w, x, count, parts, sweeps, keep)
        opened = np.bincount(pairs.u, pairs.tables, minlength=len(pairs.contexts))
        dish = np.bincount(pairs.w, pairs.tables, minlength=len(words))
        own, first = np.unique(x, return_index=True)
        _, at, of = np.intersect1d(own, pairs.contexts, assume_unique=True, return_indices=True)
        here = np.zeros(len(words))
        here[first[at]] = opened[of]
        rest = np.ones(len(pairs.contexts), bool)
        rest[of] = False
        more = int(rest.sum())
        columns = [np.full(len(words) + more, part, np.int32), pa.concat_arrays([pa.array(words, pa.binary()), pa.nulls(more, pa.binary())]), np.concatenate([x, pairs.contexts[rest]]).astype(np.int64), np.concatenate([np.bincount(w, count, minlength=len(words)), np.zeros(more)]), np.concatenate([dish, np.zeros(more)]), np.concatenate([here, opened[rest]])]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["part", "word", "x", "c", "t", "opened"])

    seats = staged(packed.groupBy("part").applyInArrow(seated, "part int, word binary, x long, c double, t double, opened double"), "seats")
    released(spark)
    # Who asks for a word: as many parts at most as there are, a list instead of a row for each.
    contexts = seats.groupBy("x").agg(F.sum("opened").alias("opened"), F.collect_list("part").alias("parts"))
    begin = int(_hash([BEGIN])[0])
    words_ = seats.filter("word is not null").groupBy("word", "x").agg(F.sum("c").cast("long").alias("c"), F.sum("t").alias("dish"))
    asks = staged(contexts, "asks")
    vocabulary = staged(words_.join(asks.select("x", "opened"), "x", "left").select("word", "x", "c", "dish", F.coalesce("opened", F.lit(0.0)).alias("opened")), "words")
    start = asks.filter(F.col("x") == begin).agg(F.coalesce(F.sum("opened"), F.lit(0.0))).first()[0]
    unstaged(seats)
    released(spark)
    once = vocabulary.filter("c > 0").select("word", "x", F.greatest(F.lit(1), F.round("dish")).cast("long").alias("n"))
    n_train, n_distinct, singles, doubles = vocabulary.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.round("dish") <= 1), F.count_if(F.round("dish") == 2)).first()
    n_tables = once.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # customers of the restaurant of single words
    discount = round(min(0.95, max(0.05, singles / max(1, singles + 2 * doubles))), 3)

    def hyper(total: float) -> float:
        """Strength of the restaurant of single words given its number of tables."""
        return WORD_STRENGTH + discount * total

    def tables_of(x: np.ndarray, counts: np.ndarray, base: np.ndarray, total: float, turn: int) -> np.ndarray:
        return seat(counts, base, np.full(len(x), hyper(total)), discount, draws(x, turn))

    states, total = [(uniform_spelling(), 0.5 * n_distinct)], 0.0
    for turn in range(3):  # the seating of words given the spelling, then of the spelling given the words' tables
        given = spark.sparkContext.broadcast((states[-1][0].levels, states[-1][1]))

        def grams(batches, turn=turn, given=given):
            sums: dict[int, int] = {}
            t_sum = 0
            for batch in batches:
                words, counts = batch["word"].to_pylist(), batch["n"].to_numpy(zero_copy_only=False)
                if not words:
                    continue
                base = 10.0 ** np.maximum(Spelling(given.value[0]).log10(words), -300)
                t = tables_of(batch["x"].to_numpy(zero_copy_only=False), counts, base, given.value[1], turn)
                t_sum += int(t.sum())
                s, context, first, _ = spelled(words)
                key = context * ALPHABET + s
                own, back = np.unique(key, return_inverse=True)
                for k, n in zip(own.tolist(), np.bincount(back, np.repeat(t, np.diff(np.concatenate([first, [len(s)]])))).astype(np.int64).tolist()):
                    sums[k] = sums.get(k, 0) + n
            yield pa.RecordBatch.from_pydict({"key": pa.array([-1, *sums], pa.int64()), "n": pa.array([t_sum, *sums.values()], pa.int64())})

        # Grouped keys: as many as the alphabet allows, however large the corpus.
        got = once.mapInArrow(grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
        total = float(next((r["n"] for r in got if r["key"] == -1), 0))
        keys, counts = (np.array([r[k] for r in got if r["key"] >= 0], np.int64) for k in ("key", "n"))
        last = turn == 2
        states = [(x, total) for x in gibbs(keys // ALPHABET, keys % ALPHABET, counts, sweeps if last else 2, keep if last else 1, 8 + turn)]
    final = spark.sparkContext.broadcast([(x.levels, t) for x, t in states])

    def spelled_mass(batches):
        sums = np.zeros(len(final.value))
        for batch in batches:
            words = batch["word"].to_pylist()
            for i, (levels, _) in enumerate(final.value):
                sums[i] += (10.0 ** Spelling(levels).log10(words)).sum() if words else 0.0
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int64()), "m": pa.array(sums)})

    mass = {r["i"]: r["m"] for r in once.select("word").mapInArrow(spelled_mass, "i long, m double").groupBy("i").agg(F.sum("m").alias("m")).collect()}
    unseen = [hyper(t) * max(1e-12, 1 - mass.get(i, 0.0)) / (n_tables + WORD_STRENGTH) for i, (_, t) in enumerate(states)]

    def judged(batches):
        """(x, c, opened, p): what pairs are priced with, p the probability of the word by itself."""
        for batch in batches:
            words, c, dish = batch["word"].to_pylist(), batch["c"].to_numpy(zero_copy_only=False), batch["dish"].to_numpy(zero_copy_only=False)
            if not words:
                continue
            x, n = batch["x"].to_numpy(zero_copy_only=False), np.maximum(1, np.rint(dish)).astype(np.int64)
            p = np.zeros(len(words))
            for i, (levels, t_all) in enumerate(final.value):
                base = 10.0 ** np.maximum(Spelling(levels).log10(words), -300)
                t = tables_of(x, n, base, t_all, 10 + i)
                p += np.where(c > 0, (np.maximum(n - discount * t, 0) + hyper(t_all) * base) / (n_tables + WORD_STRENGTH), unseen[i])
            yield pa.RecordBatch.from_arrays([batch["x"], batch["c"].cast(pa.int32()), batch["opened"].cast(pa.float32()), pa.array(np.maximum(p / len(final.value), 1e-30), pa.float32())], ["x", "c", "opened", "p"])

    def answered(batches):
        """Answers packed by the part that they go to."""
        held, size = [], 0

        def sent():
            x, c, opened, p = (np.concatenate([h[k] for h in held]) for k in range(4))
            to, at = np.concatenate([h[4] for h in held]), np.concatenate([h[5] + n for h, n in zip(held, np.cumsum([0, *(len(h[0]) for h in held)]))])
            order = np.argsort(to, kind="stable")
            ends = np.flatnonzero(np.diff(np.concatenate([to[order], [-1]]))) + 1
            rows = [(int(to[own[0]]), at[own]) for own in np.split(order, ends[:-1])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([to for to, _ in rows], pa.int64()), pa.array([_bytes40(x[own]) for _, own in rows], pa.binary()), *(pa.array([v[own].tobytes() for _, own in rows], pa.binary()) for v in (c, opened, p))], ["to", "x", "c", "opened", "p"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, opened, p = (np.nan_to_num(batch[k].to_numpy(zero_copy_only=False)).astype(t) for k, t in (("c", "<i4"), ("opened", "<f4"), ("p", "<f4")))
            lists = batch["parts"]
            to = lists.flatten().to_numpy(zero_copy_only=False)
            held.append((batch["x"].to_numpy(zero_copy_only=False).astype(np.uint64), c, opened, p, to, np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))))
            size += len(to)
            if size >= 1_000_000:
                yield sent()
                size = 0
        if held:
            yield sent()

    prices = vocabulary.select("word", "x", "c", "dish", "opened").mapInArrow(judged, "x long, c int, opened float, p float").groupBy("x").agg(*[F.max(k).alias(k) for k in ("c", "opened", "p")])
    asked = asks.select("x", "parts").join(prices, "x", "left").select("parts", "x", "c", "opened", "p").mapInArrow(answered, "to long, x binary, c binary, opened binary, p binary")
    n_texts = rows.filter(~F.col("held_out")).count()

    def posted(batches):
        """Of kind b: pairs with the texts of the block that hold them. Of kind t: the names and lengths of these texts."""
        for number, (words, w, lengths, flags, names) in enumerate(_blocks(batches, block_bytes)):
            x = _hash(words)
            block = xxhash.xxh64_intdigest(names.tobytes(), seed=number) >> 1
            out = {k: [] for k in PACKED.names}
            flat = flags.tobytes()
            for k, v in zip(out, ("t", block % parts, block, names.tobytes(), b"", b"", lengths.astype("<u4").tobytes(), b"", b"")):
                out[k].append(v)
            # Pair and text in one number: at most 23 bits a word, as a block has fewer tokens, and 16 for its texts.
            key = _before(w, lengths) * len(words)
            key += w
            key <<= 16
            key |= np.repeat(np.arange(len(lengths)), lengths)
            key.sort()
            texts_of = (key & 0xFFFF).astype("<u2")
            key >>= 16
            first = np.flatnonzero(np.diff(np.concatenate([[-1], key])))
            n = np.diff(np.concatenate([first, [len(key)]]))
            pair = key[first]
            del key
            for part, own, own_words, pairs, before in _sent(words, x, pair // len(words), pair % len(words), parts):
                m = n[own]
                at = np.repeat(first[own] - np.cumsum(m) + m, m) + np.arange(m.sum())
                for k, v in zip(out, ("b", part, block, own_words, pairs, before, m.astype("<u4").tobytes(), texts_of[at].tobytes(), flat)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=PACKED)
            del out, first, n, pair, w, words, texts_of
            trimmed()

    def sold(table, answers):
        """Of each block the sums of its texts over the pairs of this part; names and lengths pass through."""
        trimmed()
        out = {"block": [], "kind": [], "a": [], "b": [], "c": []}
        kinds = table["kind"].to_pylist()
        for i in [i for i, k in enumerate(kinds) if k == "t"]:
            for k, v in zip(out, (table["block"][i].as_py(), "t", table["words"][i].as_py(), table["n"][i].as_py(), b"")):
                out[k].append(v)
        words, x, u, w, blocks = _received(table.filter(pa.array([k == "b" for k in kinds], pa.bool_())))
        if len(u):
            known = np.concatenate([_from40(v) for v in answers["x"].to_pylist()])
            by = np.argsort(known)
            known = known[by]
            c, opened, p = (np.frombuffer(b"".join(answers[k].to_pylist()), t).astype(np.float64)[by] for k, t in (("c", "<i4"), ("opened", "<f4"), ("p", "<f4")))
            # Every training word but the end is followed by one token; the beginning is by each text's first.
            of = np.where(known == end_hash, 0.0, np.where(known == np.uint64(begin), n_texts, c))
            opened = np.where(known == np.uint64(begin), start, opened)
            posts = [(np.frombuffer(r["n"], "<u4").astype(np.int64), np.frombuffer(r["docs"], "<u2").astype(np.int64), np.frombuffer(r["flags"], np.uint8)) for r in blocks]
            sizes = [len(n) for n, _, _ in posts]
            count = np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), 1 - flags[docs].astype(np.int64), minlength=len(n)) for n, docs, flags in posts])
            pairs = Pairs(u, w, x, count, parts, sweeps, keep)
            at_u, at_w = np.searchsorted(known, pairs.contexts)[pairs.u], np.searchsorted(known, x)[pairs.w]
            price = np.log10((np.maximum(pairs.count - PAIR_DISCOUNT * pairs.tables, 0) + (PAIR_STRENGTH + PAIR_DISCOUNT * opened[at_u]) * p[at_w]) / (PAIR_STRENGTH + of[at_u]))
            base = np.log10((c[at_w] + 1) / (n_train + n_distinct + 1))
            end = 0
            for (n, docs, flags), size, r in zip(posts, sizes, blocks):
                own = np.repeat(pairs.place[end : end + size], n)
                end += size
                sums = [np.bincount(docs, v[own], minlength=len(flags)) for v in (price, base, (c[at_w] > 0).astype(np.float64))]
                for k, v in zip(out, (r["block"], "s", *(v.astype("<f8").tobytes() for v in sums))):
                    out[k].append(v)
        return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["kind"], pa.string()), *(pa.array(out[k], pa.binary()) for k in "abc")], names=list(out))

    def summed(table):
        rows = table.to_pylist()
        sums = None
        # In the order of what they hold, so that sums of the same parts come out alike.
        for r in sorted((r for r in rows if r["kind"] == "s"), key=lambda r: (r["a"], r["b"])):
            own = np.array([np.frombuffer(r[k], "<f8") for k in "abc"])
            sums = own if sums is None else sums + own
        t = next(r for r in rows if r["kind"] == "t")
        names, n = np.frombuffer(t["a"], "<i8").reshape(-1, 2), np.frombuffer(t["b"], "<u4").astype(np.int64)
        return pa.table({"h0": names[:, 0].copy(), "h1": names[:, 1].copy(), "n_tokens": n, "n_known": sums[2].astype(np.int64), "base_score": sums[1], "score": sums[0]})

    packed = rows.select("text", "held_out", "h0", "h1").mapInArrow(posted, PACKED_DDL)
    sold_ = packed.groupBy("part").cogroup(asked.groupBy("to")).applyInArrow(sold, "block long, kind string, a binary, b binary, c binary")
    scored = sold_.groupBy("block").applyInArrow(summed, "h0 long, h1 long, n_tokens long, n_known long, base_score double, score double")
    each = scored.groupBy("h0", "h1").agg(*[F.max(k).alias(k) for k in ("n_tokens", "n_known", "base_score", "score")])
    out = rows.select("doc_id", "held_out", "h0", "h1").join(each, ["h0", "h1"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
