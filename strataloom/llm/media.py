"""Media columns as progressive JPEG: scans are accumulated into coefficient arrays and turned into full-resolution RGB."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import kept_in_worker, per_batch, whole_texts

UNIT = 576


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order: along anti-diagonals, in turn up and down."""
    order = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([u * 8 + v for u, v in order])


ZIGZAG = _zigzag()
#: The cosine basis in whole numbers. Sums of products stay below 2**53, so float64 holds them exactly, in any order.
BASIS = np.rint(np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * 4096)


class Huffman:
    """Canonical codes; ``bytes_of``: the value of each byte if every code and its extra bits fill just one byte, else None."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.codes, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[(length, code)] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.bytes_of = None
        if self.codes and all(length + s == 8 for (length, _), s in self.codes.items()):
            self.bytes_of = np.full(256, -(1 << 20), np.int32)
            for (length, c), s in self.codes.items():
                for extra in range(1 << s):
                    self.bytes_of[c << s | extra] = _signed(extra, s)
            good = np.flatnonzero(self.bytes_of > -(1 << 20))
            self.top, self.zero, self._shifted = int(good.max()), bool((self.bytes_of[good] == 0).any()), {}
            if len(good) != self.top + 1:  # canonical codes leave gaps only above
                self.bytes_of = None

    def shifted(self, al: int) -> np.ndarray:
        if al not in self._shifted:
            self._shifted[al] = np.sign(self.bytes_of) * (np.abs(self.bytes_of) << al)
        return self._shifted[al]


def _signed(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


def _table(sizes: list[int]) -> tuple[bytes, bytes]:
    """One code of each length 1, 2, ... for these symbols: a code and its extra bits fill one byte."""
    return bytes([1] * len(sizes) + [0] * (16 - len(sizes))), bytes(sizes)


def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    """Tables that recur from file to file are built once in a worker."""
    known = kept_in_worker(("huffman",), dict)
    if len(known) > 64:
        known.clear()
    if (counts, symbols) not in known:
        known[(counts, symbols)] = Huffman(counts, symbols)
    return known[(counts, symbols)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _byte_codes(table: Huffman, low: int, high: int) -> np.ndarray:
    out = np.zeros(high - low + 1, np.uint8)
    for b, v in enumerate(table.bytes_of.tolist()):
        if low <= v <= high:
            out[v - low] = b
    return out


def _payload_codes() -> tuple:
    """Tables for DC, AC and ended blocks; the code byte of each DC difference; of each byte as an AC value the code byte of its first pass, and its last bit."""
    dc_spec, ac_spec, eob_spec = _table([7, 6, 5, 4, 3, 2, 1, 0]), _table([7, 6, 5, 4, 3, 2, 1]), (bytes([1] + [0] * 15), bytes(1))
    dc_codes, ac_codes = _byte_codes(Huffman(*dc_spec), -127, 127), _byte_codes(Huffman(*ac_spec), -64, 64)
    b = np.arange(256)
    magnitude = np.where(b < 128, b + 2, b - 126)
    return dc_spec, ac_spec, eob_spec, dc_codes, ac_codes[np.where(b < 128, -(magnitude >> 1), magnitude >> 1) + 64], (magnitude & 1).astype(np.uint8)


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose quantised coefficients are the payload's bytes, one each, in zigzag order of its blocks.

    Bytes become DC values from -128 to 127 and AC values of magnitude 2 to 129: no AC value vanishes in the first pass
    of successive approximation. Scans: DC without its last bit, AC of chroma, and of luma in bands 1-5 and 6-63, without theirs, then
    the last bits. The Huffman tables are made so that a code and its extra bits fill a byte, whatever the value.
    """
    n = max(1, -(-len(payload) // 384))
    wide = min(4095, int(np.ceil(np.sqrt(n))))
    high = -(-n // wide)
    if high > 4095:
        raise ValueError("payload too large for a JPEG")
    raw = np.full(wide * high * 384, 255, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = raw.reshape(-1, 6, 64)
    dc = blocks[:, :, 0].astype(np.int32) - 128
    first_dc = dc >> 1
    y = first_dc[:, :4].ravel()
    diff = np.empty_like(first_dc)
    diff[:, :4] = np.diff(y, prepend=0).reshape(-1, 4)
    for c in (4, 5):
        diff[:, c] = np.diff(first_dc[:, c], prepend=0)
    dc_spec, ac_spec, eob_spec, dc_codes, first_of, last_of = kept_in_worker(("payload codes",), _payload_codes)
    planes = [blocks[:, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64), blocks[:, 4], blocks[:, 5]]

    def scan(components: list[int], ss: int, se: int, ah: int, al: int, table: int, data: bytes) -> bytes:
        head = bytes([len(components)]) + b"".join(bytes([c + 1, table]) for c in components) + bytes([ss, se, ah << 4 | al])
        return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")

    def packed(bits: np.ndarray) -> bytes:
        pad = -bits.size % 8
        return np.packbits(np.concatenate([bits.ravel(), np.ones(pad, np.uint8)])).tobytes()

    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    for place, spec in ((0x00, dc_spec), (0x10, ac_spec), (0x11, eob_spec)):
        out.append(_segment(0xC4, bytes([place]) + spec[0] + spec[1]))
    out.append(scan([0, 1, 2], 0, 0, 0, 1, 0x00, dc_codes[diff + 127].tobytes()))
    for c, ss, se in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):
        out.append(scan([c], ss, se, 0, 1, 0x00, first_of[planes[c][:, ss : se + 1]].tobytes()))
    out.append(scan([0, 1, 2], 0, 0, 1, 0, 0x00, packed((dc & 1).astype(np.uint8))))
    for c, plane in enumerate(planes):
        bits = last_of[plane]
        bits[:, 0] = 0  # the code of "end of block", the last bits of all 63 follow
        out.append(scan([c], 1, 63, 1, 0, 0x01, packed(bits)))
    return b"".join(out) + b"\xff\xd9"


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def bit(self) -> int:
        i = self.at
        self.at += 1
        return self.data[i >> 3] >> (7 - (i & 7)) & 1 if i >> 3 < len(self.data) else 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            s = table.codes.get((length, code))
            if s is not None:
                return s
        raise ValueError("no such Huffman code")


class Component:
    def __init__(self, ident: int, h: int, v: int, tq: int) -> None:
        self.ident, self.h, self.v, self.tq = ident, h, v, tq


class Jpeg:
    """A progressive JPEG: ``coefficients[c]`` is (block rows, block columns, 64) in zigzag order, padded to whole MCUs."""

    def __init__(self, data: bytes, serial: bool = False) -> None:
        """``serial``: read every scan bit by bit, also those that could be read byte by byte."""
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.serial, self.comment, self.quant, self.tables, self.restart, self.orders = serial, b"", {}, {}, 0, {}
        at = 2
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB):
                raise ValueError("only progressive Huffman frames are read")
            elif marker == 0xDA:
                at = self._scan(body, data, at)

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8:
            raise ValueError("only 8-bit samples are read")
        self.parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.wide, self.high = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.coefficients = [np.zeros((self.high * c.v, self.wide * c.h, 64), np.int32) for c in self.parts]

    def _scan(self, head: bytes, data: bytes, at: int) -> int:
        end = at
        while True:  # up to a marker that is neither a stuffed byte nor a restart
            end = data.index(b"\xff", end)
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
            else:
                break
        n = head[0]
        chosen = [next(i for i, c in enumerate(self.parts) if c.ident == head[1 + 2 * k]) for k in range(n)]
        tables = [head[2 + 2 * k] for k in range(n)]
        ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        runs, start = [], at
        if self.restart:
            i = at
            while (i := data.find(b"\xff", i, end)) >= 0:
                if data[i + 1] != 0:
                    runs.append(data[start:i])
                    start = i + 2
                i += 2
        runs.append(data[start:end])
        runs = [r.replace(b"\xff\x00", b"\xff") for r in runs]
        if (key := tuple(chosen)) not in self.orders:
            self.orders[key] = self._order(chosen)
        blocks = self.orders[key]
        if self.serial or self.restart or not self._by_bytes(blocks, chosen, tables, ss, se, ah, al, runs[0]):
            self._by_bits(blocks, len(chosen), tables, ss, se, ah, al, runs)
        return end

    def _order(self, chosen: list[int]) -> list[tuple[int, np.ndarray]]:
        """Per component of the scan, the flat places of its blocks in the order of the scan; interleaved ones by MCU."""
        out = []
        for c in chosen:
            part, grid = self.parts[c], np.arange(self.coefficients[c].shape[0] * self.coefficients[c].shape[1]).reshape(self.coefficients[c].shape[:2])
            if len(chosen) == 1:
                rows, cols = -(-(-(-self.height * part.v // self.vmax)) // 8), -(-(-(-self.width * part.h // self.hmax)) // 8)
                out.append((c, grid[:rows, :cols].reshape(-1, 1)))
            else:
                out.append((c, grid.reshape(self.high, part.v, self.wide, part.h).transpose(0, 2, 1, 3).reshape(-1, part.v * part.h)))
        return out

    def _by_bytes(self, blocks, chosen, tables, ss, se, ah, al, data) -> bool:
        """Whole scans at once, where every value takes one byte, or every block the same number of bits. False where that isn't so."""
        raw, width = np.frombuffer(data, np.uint8), sum(p.shape[1] for _, p in blocks)
        n = len(blocks[0][1]) * width
        if ss == 0:
            if ah:
                if raw.size != -(-n // 8):
                    return False
                values = np.unpackbits(raw)[:n].reshape(-1, width).astype(np.int32) << al
            else:
                table = self.tables[tables[0] >> 4]
                if len(set(tables)) > 1 or table.bytes_of is None or raw.size != n or n and raw.max() > table.top:
                    return False
                values = table.bytes_of[raw].reshape(-1, width)
            first = 0
            for c, places in blocks:
                own, flat = values[:, first : first + places.shape[1]], self.coefficients[c].reshape(-1, 64)
                first += places.shape[1]
                if ah:
                    flat[places.ravel(), 0] |= own.ravel()
                else:
                    flat[places.ravel(), 0] = own.ravel().cumsum() << al
            return True
        (c, places), band, table = blocks[0], se - ss + 1, self.tables[0x10 | tables[0] & 15]
        flat = self.coefficients[c].reshape(-1, 64)
        rows = slice(None) if n == len(flat) else places.ravel()
        if not ah:
            if table.bytes_of is None or table.zero or raw.size != n * band or n and raw.max() > table.top:
                return False
            flat[rows, ss : se + 1] = table.shifted(al)[raw].reshape(-1, band)
            return True
        if table.codes.get((1, 0)) != 0 or raw.size != -(-n * (band + 1) // 8):
            return False
        old = flat[rows, ss : se + 1]
        bits = np.unpackbits(raw)[: n * (band + 1)].reshape(n, band + 1)
        if bits[:, 0].any() or not old.all():
            return False
        more = bits[:, 1:].astype(np.int32) << al
        np.negative(more, out=more, where=old < 0)
        flat[rows, ss : se + 1] = old + more
        return True

    def _by_bits(self, blocks, n_parts, tables, ss, se, ah, al, runs) -> None:
        """Any Huffman tables, zero runs, runs of ended blocks and restarts."""
        order = [(k, c, int(p)) for row in range(len(blocks[0][1])) for k, (c, places) in enumerate(blocks) for p in places[row]]
        per = sum(p.shape[1] for _, p in blocks)
        step = self.restart * per if self.restart else len(order)
        for r, data in enumerate(runs):
            source, last, ended = _Bits(data), [0] * n_parts, 0
            for k, c, p in order[r * step : (r + 1) * step]:
                block = self.coefficients[c].reshape(-1, 64)[p]
                if ss == 0:
                    if ah:
                        block[0] |= source.bit() << al
                    else:
                        size = source.symbol(self.tables[tables[k] >> 4])
                        last[k] += _signed(source.bits(size), size)
                        block[0] = last[k] << al
                elif ah:
                    ended = self._refine(source, self.tables[0x10 | tables[k] & 15], block, ss, se, al, ended)
                elif ended:
                    ended -= 1
                else:
                    at = ss
                    while at <= se:
                        s = source.symbol(self.tables[0x10 | tables[k] & 15])
                        zeros, size = s >> 4, s & 15
                        if size:
                            at += zeros
                            v = _signed(source.bits(size), size)
                            block[at] = (abs(v) << al) * (1 if v > 0 else -1)
                            at += 1
                        elif zeros == 15:
                            at += 16
                        else:
                            ended = (1 << zeros) + source.bits(zeros) - 1
                            break

    @staticmethod
    def _refine(source: _Bits, table: Huffman, block: np.ndarray, ss: int, se: int, al: int, ended: int) -> int:
        """One block of a refining scan: last bits of values already there, new values of magnitude 1 between them."""

        def correct(i: int) -> None:
            if source.bit():
                block[i] += (1 << al) if block[i] > 0 else -(1 << al)

        at = ss
        while at <= se and not ended:
            s = source.symbol(table)
            zeros, new = s >> 4, 0
            if s & 15:
                new = (1 << al) if source.bit() else -(1 << al)
            elif zeros < 15:
                ended = (1 << zeros) + source.bits(zeros)
                break
            while at <= se:
                if block[at]:
                    correct(at)
                elif zeros:
                    zeros -= 1
                else:
                    block[at] = new
                    at += 1
                    break
                at += 1
        if ended:
            for i in range(at, se + 1):
                if block[i]:
                    correct(i)
            ended -= 1
        return ended

    def samples(self, c: int, low: int, high: int) -> np.ndarray:
        """Block rows ``low`` to ``high`` of a component as 8-bit samples."""
        part, own = self.parts[c], self.coefficients[c][low:high]
        x = np.zeros(own.shape, np.float64)
        x[:, :, ZIGZAG] = own * self.quant[part.tq]
        x = x.reshape(-1, 8) @ BASIS
        x = x.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS
        x = np.clip(np.floor(x / (1 << 24) + 128.5), 0, 255).astype(np.uint8)
        return x.reshape(own.shape[0], own.shape[1], 8, 8).transpose(0, 3, 1, 2).reshape(own.shape[0] * 8, own.shape[1] * 8)

    def rgb(self) -> np.ndarray:
        """(height, width, 3): chroma is repeated to full resolution. Strips of MCU rows bound the memory besides the result."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        rows = max(1, 2048 // max(1, self.wide))
        for top in range(0, self.high, rows):
            stop = min(self.high, top + rows)
            full = []
            for c, part in enumerate(self.parts):
                s = self.samples(c, top * part.v, stop * part.v)
                full.append(s.repeat(self.vmax // part.v, 0).repeat(self.hmax // part.h, 1).astype(np.int32))
            a, b = top * 8 * self.vmax, min(self.height, stop * 8 * self.vmax)
            y = full[0][: b - a, : self.width]
            if len(full) == 1:
                out[a:b] = y[:, :, None]
                continue
            cb, cr = (p[: b - a, : self.width] - 128 for p in full[1:3])
            out[a:b, :, 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
            out[a:b, :, 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
            out[a:b, :, 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that ``encode_payload`` stored, from the accumulated coefficients; the comment holds their number."""
        n = struct.unpack(">Q", self.comment)[0]
        y, cb, cr = self.coefficients
        v = np.empty((self.high * self.wide, 6, 64), np.int32)
        v[:, :4] = y.reshape(self.high, 2, self.wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
        v[:, 4], v[:, 5] = cb.reshape(-1, 64), cr.reshape(-1, 64)
        out = np.where(v < 0, -v - 2, v + 126).astype(np.uint8)
        out[:, :, 0] = v[:, :, 0] + 128
        return out.tobytes()[:n]


def text_payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as a progressive JPEG. Null and empty texts store one unit of padding; every row gives a row."""

    def work(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in cols["text"]], "media": [encode_payload(text_payload(t)) for t in cols["text"]]}

    return per_batch(whole_texts(docs, id_col, text_col), work, "doc_id long, n_bytes long, media binary")


def to_tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, height, width, rgb binary): full-resolution tensors, height x width x 3 bytes; null media give nulls."""

    def work(cols: dict) -> dict:
        images = [Jpeg(m) if m is not None else None for m in cols["media"]]
        return {"doc_id": cols["doc_id"], "height": [i and i.height for i in images], "width": [i and i.width for i in images], "rgb": [i and i.rgb().tobytes() for i in images]}

    return per_batch(media.selectExpr(f"{id_col} as doc_id", f"{media_col} as media"), work, "doc_id long, height int, width int, rgb binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Digests of what ``to_media`` stored, read back; ``feature``: size, channel sums and CRC-32 of the RGB tensor."""

    def work(cols: dict) -> dict:
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for m in cols["media"]:
            image = Jpeg(m)
            payload, rgb = image.payload(), image.rgb()
            sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
            values = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{image.width}x{image.height}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(rgb):08x}"
            for k, v in zip(out, values):
                out[k].append(v)
        return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]} | out

    return per_batch(to_media(docs), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
