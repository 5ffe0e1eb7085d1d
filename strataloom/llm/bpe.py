"""Byte-level BPE: exact encoding, counting by whole-token shortcut, and encoding of long texts by tree concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, per_batch, whole_texts

# Fixed value: the split pattern of byte-level BPE vocabularies, white space spelt as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes from which a piece without a split point is encoded as a tree of halves; leaves are no longer than this.
LEAF = 256
#: Bytes from which a document leaves its task: its pieces are encoded by other tasks and joined again.
SPREAD = 1 << 20
NONE = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """The merges of a ``tokenizers`` file of kind byte-level BPE."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        # The printable stand-ins of bytes: printable Latin-1 stands for itself, the rest follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in model["vocab"].items() if all(c in byte_of for c in s)}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.byte_id = [id_of[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = (model["vocab"][x] for x in (left, right, left + right))
            self.ranks[a << 20 | b] = rank << 20 | c

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece, by applying the lowest merge again and again; long pieces go through ``tree``."""
        if len(piece) > LEAF:
            return self.tree(piece)
        ids, get = [self.byte_id[b] for b in piece], self.ranks.get
        while len(ids) > 1:
            pairs = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
            best = min(pairs)
            if best == NONE:
                break
            out, i, last, new = [], 0, len(pairs), best & 0xFFFFF
            while i < last:
                if pairs[i] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            if i == last:
                out.append(ids[last])
            ids = out
        return ids

    def merge_queue(self, piece: bytes) -> list[int]:
        """The same by a priority queue, in n log n; what ``tree`` is tested against."""
        ids = [self.byte_id[b] for b in piece]
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = r & 0xFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(queue, (x, i))
            if (k := before[i]) >= 0 and (x := get(ids[k] << 20 | ids[i])) is not None:
                heapq.heappush(queue, (x, k))
        return [x for x in ids if x >= 0]

    def tree(self, piece: bytes) -> list[int]:
        """Halves are encoded on their own, down to leaves, then joined level by level."""
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts from their own encodings.

        A window of whole tokens around the join is encoded anew and grows until its first token is the left side's
        and its last token the right side's (or a side is used up). All neighbours in the result then also are
        neighbours in the encoding of some text, and such a sequence is the encoding of the whole text.
        """
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            text = b"".join(map(self.table.__getitem__, left[a:])) + b"".join(map(self.table.__getitem__, right[:b]))
            window = self.merge(text) if len(text) <= LEAF else self.merge_queue(text)
            agree_left = a == 0 or (window and window[0] == left[a])
            agree_right = b == len(right) or (window and window[-1] == right[b - 1])
            if agree_left and agree_right:
                return left[:a] + window + right[b:]
            k *= 2

    def whole_tokens(self) -> frozenset[str]:
        """The vocabulary strings that encode alone as one token; found by encoding each of them."""
        found = set()
        for i, piece in self.bytes_of.items():
            if i in self.special.values():
                continue
            try:
                text = piece.decode()
            except UnicodeDecodeError:
                continue  # never a piece of a text
            if self.merge(piece) == [i]:
                found.add(text)
        return frozenset(found)


def splitters(special: dict[str, int]):
    import regex

    return regex.compile(SPLIT), regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


#: Added to the length of a proven whole token, so that one sum has both counts; no text has so many tokens.
WHOLE = 1 << 40


class Lengths(dict):
    """Tokens by piece: proven whole tokens (marked by ``WHOLE``) from the start, others as they are merged; bounded."""

    def __init__(self, whole: frozenset[str], vocabulary: Vocabulary) -> None:
        super().__init__(dict.fromkeys(whole, 1 + WHOLE))
        self.whole, self.vocabulary = whole, vocabulary

    def __missing__(self, piece: str) -> int:
        n = len(self.vocabulary.merge(piece.encode()))
        if len(self) > 1_000_000:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1 + WHOLE))
        if len(piece) <= 64:
            self[piece] = n
        return n


class Packed(dict):
    """Ids by piece as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.merge(piece.encode()), "<u4").tobytes()
        if len(self) > 1_000_000:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _spec(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:  # on the driver; the executors get its text
        return f.read()


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_whole) of every whole text, without begin, end or added special tokens.

    The driver proves once which vocabulary strings encode alone as one token. A piece of a text that is one of them
    counts 1 at once (``n_whole`` of them); only the others are merged, each distinct one once while it is remembered.
    The strings of special tokens count as the library's default has it: as one token. Null and empty texts have 0
    tokens; repeated rows give repeated rows; null ids are kept.
    """
    spark = docs.sparkSession
    text = _spec(path)
    shared = spark.sparkContext.broadcast((text, Vocabulary(text).whole_tokens()))  # as large as the vocabulary, whatever the data

    def work(cols: dict) -> dict:
        def make():
            vocabulary = Vocabulary(shared.value[0])
            return Lengths(shared.value[1], vocabulary), *splitters(vocabulary.special)

        lengths, split, special = kept_in_worker(("lengths", hash(shared.value[0])), make)
        get, find = lengths.__getitem__, split.findall
        n_tokens, n_whole = [], []
        for t in cols["text"]:
            parts = special.split(t) if special else [t]
            both = sum(map(get, find(parts[0]))) + len(parts) // 2
            for part in parts[2::2]:
                both += sum(map(get, find(part)))
            n_tokens.append(both % WHOLE)
            n_whole.append(both // WHOLE)
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in cols["text"]], "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens], "n_whole": n_whole}

    return per_batch(whole_texts(docs, id_col, text_col), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")


def _encoder(spec: str):
    def make():
        vocabulary = Vocabulary(spec)
        split, special = splitters(vocabulary.special)
        packed = Packed(vocabulary)

        def encode(text: str) -> bytes:
            parts = special.split(text) if special else [text]
            out = [b"".join(map(packed.__getitem__, split.findall(parts[0])))]
            for i in range(1, len(parts), 2):
                out.append(np.array([vocabulary.special[parts[i]]], "<u4").tobytes())
                out.append(b"".join(map(packed.__getitem__, split.findall(parts[i + 1]))))
            return b"".join(out)

        def decode(ids: bytes) -> str:
            return b"".join(map(vocabulary.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

        return vocabulary, split, special, encode, decode

    return kept_in_worker(("encoder", hash(spec)), make)


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids binary): every whole text's token ids as little-endian unsigned 32-bit integers.

    Texts up to ``spread`` bytes are encoded where they are read; a piece without split points is encoded as a tree of
    halves. Longer texts are cut into their pieces, and pieces into blocks; the blocks go to other tasks, are encoded
    in parallel, and neighbours of one piece are joined again exactly (``Vocabulary.join``). Null and empty texts have
    no ids; repeated rows, equal texts and null ids are kept as they come.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(_spec(path))
    rows = whole_texts(docs, id_col, text_col)

    def work(cols: dict) -> dict:
        encode = _encoder(spec.value)[3]
        return {"doc_id": cols["doc_id"], "ids": [encode(t) for t in cols["text"]]}

    short = per_batch(rows.filter(F.octet_length("text") <= spread), work, "doc_id long, ids binary")

    def cut(cols: dict) -> dict:
        """Pieces up to a block's size travel together with their sizes, as a block split anew would lack the text behind it; a longer piece is halved until its blocks are small enough. ``piece`` is the same for blocks to be joined."""
        _, split, special, _, _ = _encoder(spec.value)
        block, out = max(LEAF, spread // 8), {k: [] for k in ("row", "doc_id", "no", "piece", "raw", "sizes")}

        def put(i: int, raw: bytes, piece: int, sizes: list[int] | None = None) -> None:
            for k, v in (("row", cols["row"][i]), ("doc_id", cols["doc_id"][i]), ("no", len(out["no"])), ("piece", piece), ("raw", raw), ("sizes", sizes)):
                out[k].append(v)

        for i, text in enumerate(cols["text"]):
            n = 0
            for part in special.split(text) if special else [text]:
                if special and special.fullmatch(part):
                    put(i, part.encode(), -1)
                    continue
                held: list[bytes] = []
                size = 0
                for x in split.findall(part):
                    raw = x.encode()
                    if len(raw) > block:
                        if held:
                            put(i, b"".join(held), -2, list(map(len, held)))
                            held, size = [], 0
                        n += 1
                        for at in range(0, len(raw), block):
                            put(i, raw[at : at + block], n)
                        continue
                    held.append(raw)
                    size += len(raw)
                    if size >= block:
                        put(i, b"".join(held), -2, list(map(len, held)))
                        held, size = [], 0
                if held:
                    put(i, b"".join(held), -2, list(map(len, held)))
        return out

    def encode_blocks(cols: dict) -> dict:
        vocabulary, ids = _encoder(spec.value)[0], []
        for piece, raw, sizes in zip(cols["piece"], cols["raw"], cols["sizes"]):
            if piece == -1:
                got = [vocabulary.special[raw.decode()]]
            elif piece == -2:
                got = [x for end, n in zip(accumulate(sizes), sizes) for x in vocabulary.merge(raw[end - n : end])]
            else:
                got = vocabulary.tree(raw)
            ids.append(np.array(got, "<u4").tobytes())
        return {k: cols[k] for k in ("row", "doc_id", "no", "piece")} | {"ids": ids}

    def joined(cols: dict) -> dict:
        vocabulary, out = _encoder(spec.value)[0], []
        for blocks in cols["blocks"]:
            runs: list[tuple[int, list[list[int]]]] = []
            for b in blocks:
                ids = np.frombuffer(b["ids"], "<u4").tolist()
                if runs and b["piece"] > 0 and runs[-1][0] == b["piece"]:
                    runs[-1][1].append(ids)
                else:
                    runs.append((b["piece"], [ids]))
            whole: list[int] = []
            for _, level in runs:
                while len(level) > 1:  # neighbours in pairs, level by level
                    level = [vocabulary.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
                whole += level[0]
            out.append(np.array(whole, "<u4").tobytes())
        return {"doc_id": cols["doc_id"], "ids": out}

    long = rows.filter(F.octet_length("text") > spread).withColumn("row", F.monotonically_increasing_id())
    blocks = per_batch(long, cut, "row long, doc_id long, no long, piece long, raw binary, sizes array<int>")
    coded = per_batch(blocks.repartition("row", "no"), encode_blocks, "row long, doc_id long, no long, piece long, ids binary")
    gathered = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("no", "piece", "ids"))).alias("blocks"))
    return short.unionByName(per_batch(gathered.select("doc_id", "blocks"), joined, "doc_id long, ids binary"))


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): ids back to text; special tokens appear as their strings, broken UTF-8 as U+FFFD."""
    spec = encoded.sparkSession.sparkContext.broadcast(_spec(path))

    def work(cols: dict) -> dict:
        decode = _encoder(spec.value)[4]
        return cols | {"text": [decode(x) for x in cols["ids"]]}

    return per_batch(encoded.select("doc_id", "ids"), work, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ``encode_texts`` and ``decode_ids``."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(path))

    def work(cols: dict) -> dict:
        decode, hexed = _encoder(spec.value)[4], lambda b: hashlib.sha256(b).hexdigest()
        return {"doc_id": cols["doc_id"], "n_tokens": [len(x) // 4 for x in cols["ids"]], "ids_sha256": [hexed(x) for x in cols["ids"]], "decoded_sha256": [hexed(decode(x).encode()) for x in cols["ids"]]}

    return per_batch(encode_texts(docs, path, id_col, text_col, spread), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
