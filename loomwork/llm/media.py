"""Media columns: texts stored losslessly in baseline JPEGs, and what reading them back gives.

A payload byte is the DC coefficient of one 8x8 block (quantiser 8, so the block's
mean is the byte), all AC coefficients are zero, and a restart marker follows each
row of blocks. Restart intervals decode independently of each other, so a Huffman
scan is decoded by numpy for all intervals of a batch of files at once, one symbol
of each interval a step. The reader takes any baseline file with Huffman tables
(one or three components, any AC coefficients, restart markers or none).

Defined results: a null or empty text is one unit of 64 zero bytes; equal texts
give equal values; rows that repeat are stored alike; an empty table gives an
empty result; payloads over 66,584,576 bytes are stored as several files in a row.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
MAX_BLOCKS = 8191  # 65,528 pixels a side
BATCH_BYTES = 2 << 20

# Fixed values of the written files: Huffman code lengths (symbols by length).
DC_LENGTHS = {2: [5], 3: [4, 6, 7], 4: [0, 1, 2, 3], 5: [8]}
AC_LENGTHS = {1: [0x00]}
# Fixed value of the format: zig-zag position 0 is the DC coefficient; markers by name.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE


def _codes(lengths: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code = {}, 0
    for n in range(1, 17):
        for symbol in lengths.get(n, ()):
            out[symbol] = (code, n)
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return _segment(DHT, bytes([kind, *(len(lengths.get(n, ())) for n in range(1, 17))]) + bytes(s for n in range(1, 17) for s in lengths.get(n, ())))


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Bits of a whole block (difference, then end of block) and their number, by difference + 255."""
    codes, value, count = _codes(DC_LENGTHS), [], []
    eob, eob_n = _codes(AC_LENGTHS)[0]
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d > 0 else d + (1 << size) - 1
        value.append((((code << size) | extra) << eob_n) | eob)
        count.append(n + size + eob_n)
    return np.array(value, np.int64), np.array(count, np.int64)


_VALUE, _COUNT = _symbols()  # of a block, 14 bits at most


def _head(blocks_wide: int, rows: int, size: int) -> bytes:
    frame = struct.pack(">BHHB", 8, rows * 8, blocks_wide * 8, 1) + bytes([1, 0x11, 0])
    return b"".join([
        bytes([0xFF, SOI]), _segment(COM, b"payload=%d" % size), _segment(DQT, bytes([0]) + bytes([8] * 64)), _segment(SOF0, frame),
        _table(0x00, DC_LENGTHS), _table(0x10, AC_LENGTHS), _segment(DRI, struct.pack(">H", blocks_wide)), _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _scans(samples: np.ndarray, width: int, row_in_file: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of ``width`` samples, and where each row's begin (restart marker included)."""
    level = samples.astype(np.int64).reshape(-1, width) - 128
    step = np.diff(level, axis=1, prepend=0) + 255
    bits = _COUNT[step]
    within = np.cumsum(bits, axis=1)
    row_bytes = -(-within[:, -1] // 8)
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    at = (row_at[:-1, None] * 8 + within - bits).ravel()
    word = _VALUE[step].ravel() << (32 - (at & 15) - bits.ravel())
    place, total = at >> 4, int(row_at[-1])
    units = np.bincount(place, weights=word >> 16, minlength=total // 2 + 2)
    units[1:] += np.bincount(place, weights=word & 0xFFFF, minlength=total // 2 + 1)[: len(units) - 1]
    out = units.astype(">u2").view(np.uint8)[:total].copy()
    out[row_at[1:] - 1] |= ((1 << (row_bytes * 8 - within[:, -1])) - 1).astype(np.uint8)
    marked = row_in_file > 0
    stuffed = out == 0xFF
    before = np.concatenate([[0], np.cumsum(stuffed)])
    shift = 2 * np.cumsum(marked)
    new = np.zeros(total + int(before[-1]) + 2 * int(marked.sum()), np.uint8)
    new[np.arange(total) + before[:-1] + np.repeat(shift, row_bytes)] = out
    starts = row_at[:-1] + before[row_at[:-1]] + shift - 2 * marked
    new[starts[marked]] = 0xFF
    new[starts[marked] + 1] = 0xD0 + ((row_in_file[marked] - 1) & 7)
    return new, np.append(starts, len(new))


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """One stored form for each payload (uint8, a positive multiple of 64 bytes)."""
    parts = []  # (owner, samples, width)
    for i, p in enumerate(payloads):
        for at in range(0, len(p), 8128 * MAX_BLOCKS):
            part = p[at : at + 8128 * MAX_BLOCKS]
            parts.append((i, part, UNIT * -(-len(part) // (UNIT * MAX_BLOCKS))))
    out = [b""] * len(payloads)
    groups: dict[int, list[int]] = {}
    for k, part in enumerate(parts):
        groups.setdefault(part[2], []).append(k)
    done: dict[int, bytes] = {}
    for width, members in groups.items():
        rows = [-(-len(parts[k][1]) // width) for k in members]
        samples = np.concatenate([np.pad(parts[k][1], (0, r * width - len(parts[k][1]))) for k, r in zip(members, rows, strict=True)])
        data, starts = _scans(samples, width, np.concatenate([np.arange(r) for r in rows]))
        edge = np.concatenate([[0], np.cumsum(rows)])
        for k, a, b, r in zip(members, edge[:-1], edge[1:], rows, strict=True):
            done[k] = _head(width, r, len(parts[k][1])) + data[starts[a] : starts[b]].tobytes() + bytes([0xFF, EOI])
    for k, (i, _, _) in enumerate(parts):
        out[i] += done[k]
    return out


class Header:
    """What the markers of one file say; ``end`` is where the file after it begins."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != bytes([0xFF, SOI]):
            raise ValueError("not a JPEG file")
        self.tables: dict[int, bytes] = {}
        self.quant: dict[int, int] = {}
        self.restart, self.size = 0, None
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            length = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == DQT:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == SOF0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif marker in range(0xC1, 0xD0) and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("only baseline files are read")
            elif marker == DHT:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == DRI:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == COM and body.startswith(b"payload="):
                self.size = int(body[8:])
            elif marker == SOS:
                self.order = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                break
        self.scan = at
        if len(self.components) == 1:
            self.components = [(self.components[0][0], 1, 1, self.components[0][3])]
        wide, high = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.mcus_wide, self.mcus_high = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        by = {c[0]: k for k, c in enumerate(self.components)}
        #: (component, DC table, AC table) of the blocks of a unit, in order.
        self.unit = [(by[c], self.tables[d], self.tables[16 + a]) for c, d, a in self.order for _ in range(self.components[by[c]][1] * self.components[by[c]][2])]


@functools.cache
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code at the head of each 16 bits."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    counts, values, at = table[:16], table[16:], 0
    lengths = {}
    for n in range(1, 17):
        lengths[n] = list(values[at : at + counts[n - 1]])
        at += counts[n - 1]
    for s, (code, n) in _codes(lengths).items():
        a = code << (16 - n)
        length[a : a + (1 << (16 - n))] = n
        symbol[a : a + (1 << (16 - n))] = s
    return length, symbol


_blocks: dict[tuple[bytes, bytes], np.ndarray] = {}


def _block_lookup(dc: bytes, ac: bytes) -> np.ndarray:
    """Whole blocks that end with their DC coefficient, by the next 16 bits: (difference + 2**15) << 8 | bits; 0 where it takes more."""
    (length, size), (ac_length, ac_symbol), heads = _lookup(dc), _lookup(ac), np.arange(1 << 16)
    bits = length + size
    extra = (heads >> np.maximum(16 - bits, 0)) & ((1 << size) - 1)
    value = np.where((size == 0) | (extra >> np.maximum(size - 1, 0) & 1), extra, extra - (1 << size) + 1)
    rest = (heads << np.minimum(bits, 16)) & 0xFFFF
    bits = bits + ac_length[rest]
    whole = (length > 0) & (ac_length[rest] > 0) & (ac_symbol[rest] == 0) & (bits <= 16)
    return np.where(whole, (value + (1 << 15)) << 8 | bits, 0).astype(np.int32)


def _lanes(scan: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without stuffing and restart markers, and where each interval begins."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    keep = np.ones(len(scan), bool)
    keep[ff[after == 0] + 1] = False
    restart = ff[(after & 0xF8) == 0xD0]
    keep[restart] = keep[restart + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    return scan[keep], np.sort(np.concatenate([place[heads], place[restart + 2]]))


def decode(files: list[tuple[Header, np.ndarray]]) -> list[np.ndarray]:
    """DC values of the first component's blocks, in scan order, of files that share their tables and layout of units."""
    unit = files[0][0].unit
    heads = np.concatenate([[0], np.cumsum([len(s) for _, s in files])])
    data, starts = _lanes(np.concatenate([s for _, s in files]), heads[:-1])
    data = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    word = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    need = []
    for h, _ in files:
        total = h.mcus_wide * h.mcus_high
        each = h.restart or total
        need += [each] * (total // each) + ([total % each] if total % each else [])
    need = np.array(need)
    if len(need) != len(starts):
        raise ValueError("restart intervals don't match the frame")
    order = np.argsort(-need, kind="stable")
    bit, need = starts[order].astype(np.int64) * 8, need[order]
    for _, dc, ac in unit:
        if (dc, ac) not in _blocks:
            _blocks[dc, ac] = _block_lookup(dc, ac)

    def peek(at: np.ndarray) -> np.ndarray:
        return (word[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def long_block(at: np.ndarray, dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Difference and next place of blocks with AC coefficients or long codes."""
        length, symbol = _lookup(dc)
        got = peek(at)
        at = at + length[got]
        size = symbol[got]
        extra = peek(at).astype(np.int64) >> (16 - size)
        at = at + size
        value = np.where((extra >> np.maximum(size - 1, 0)) & 1 | (size == 0), extra, extra - (1 << size) + 1)
        length, symbol = _lookup(ac)
        live, seen = np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(live):
            got = peek(at[live])
            code = symbol[got]
            at[live] += length[got] + (code & 15)
            seen[live] += np.where(code == 0xF0, 16, (code >> 4) + 1)
            live = live[(code != 0) & (seen[live] < 63)]
        return value, at

    first = [k for k, u in enumerate(unit) if u[0] == 0]
    out = np.zeros((int(need.max()) * len(first), len(need)), np.int32)
    last = np.zeros((max(u[0] for u in unit) + 1, len(need)), np.int32)
    bit = bit.astype(np.int32) if len(data) < 1 << 27 else bit
    for step in range(int(need.max())):
        n = int(np.searchsorted(-need, -step, side="left"))  # lanes that have a unit left
        at = bit[:n]
        for k, (c, dc, ac) in enumerate(unit):
            got = _blocks[dc, ac][peek(at)]
            value = (got >> 8) - (1 << 15)
            after = at + (got & 0xFF)
            if not got.all():
                odd = np.flatnonzero(got == 0)
                value[odd], after[odd] = long_block(at[odd].astype(np.int64), dc, ac)
            at = after
            last[c, :n] += value
            if c == 0:
                out[step * len(first) + first.index(k), :n] = last[c, :n]
        bit[:n] = at
    out = out.T
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    result, lane = [], 0
    for h, _ in files:
        total = h.mcus_wide * h.mcus_high
        each = h.restart or total
        lanes = -(-total // each)
        rows = out[back[lane : lane + lanes]][:, : each * len(first)].reshape(-1)[: total * len(first)]
        lane += lanes
        result.append(rows)
    return result


def thumbnail(header: Header, dc: np.ndarray) -> np.ndarray:
    """The luminance plane at an eighth of its size, from the DC coefficients alone."""
    _, wide, high, q = header.components[0]
    plane = dc.reshape(header.mcus_high, header.mcus_wide, high, wide).transpose(0, 2, 1, 3).reshape(header.mcus_high * high, header.mcus_wide * wide)
    return np.clip((plane * header.quant[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def read(stored: list[bytes]) -> list[list[tuple[Header, np.ndarray]]]:
    """(header, thumbnail) of each file in each stored form."""
    found: list[list] = [[] for _ in stored]
    groups: dict[tuple, list] = {}
    for i, data in enumerate(stored):
        at = 0
        while at < len(data):
            h = Header(data, at)
            scan = np.frombuffer(data, np.uint8, offset=h.scan)
            end = data.find(bytes([0xFF, EOI]), h.scan)
            at = end + 2
            found[i].append(h)
            groups.setdefault(tuple(h.unit), []).append((i, len(found[i]) - 1, h, scan[: end - h.scan]))
    for members in groups.values():
        for (i, k, h, _), dc in zip(members, decode([(h, s) for _, _, h, s in members]), strict=True):
            found[i][k] = (h, thumbnail(h, dc))
    return found


@functools.cache
def _grid(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``parts`` even parts begin (the same place twice where there are fewer rows), and their lengths."""
    edge = np.linspace(0, size, parts + 1).astype(np.int64)
    return np.minimum(edge[:-1], size - 1), np.maximum(np.diff(edge), 1)


def _shrink(thumb: np.ndarray, rows: int, cols: int) -> np.ndarray:
    (r, high), (c, wide) = _grid(thumb.shape[0], rows), _grid(thumb.shape[1], cols)
    return np.add.reduceat(np.add.reduceat(thumb, r, 0, np.int64), c, 1) / (high[:, None] * wide)


def features(thumb: np.ndarray) -> str:
    """Dimensions in pixels, mean and gradient hashes of the thumbnail."""
    small, wide = _shrink(thumb, 8, 8), _shrink(thumb, 8, 9)
    bits = (small > small.mean(), wide[:, 1:] > wide[:, :-1])
    return f"{thumb.shape[1] * 8}x{thumb.shape[0] * 8}:" + ":".join(np.packbits(b).tobytes().hex() for b in bits)


def stored(docs: DataFrame, text: str = "text", key: str = "doc_id", with_media: bool = True) -> DataFrame:
    """Each text's stored form (``media``, unless left out), what it holds when read back, and its features."""
    kind = dict(docs.select(key).dtypes)[key]
    names = [key, *(["media"] if with_media else []), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textops import slices

        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), BATCH_BYTES):
                sizes = np.diff(offsets)
                media = encode([np.pad(data[a:b], (0, max(UNIT, -(-(b - a) // UNIT) * UNIT) - (b - a))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                rows: list[tuple] = []
                for n, form, files in zip(sizes, media, read(media), strict=True):
                    payload = b"".join(t.reshape(-1)[: h.size].tobytes() for h, t in files)
                    rows.append((int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), "+".join(features(t) for _, t in files)))
                columns = [batch.column(0).slice(i, j - i), *([pa.array(media, pa.binary())] if with_media else [])]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    media = "media binary, " if with_media else ""
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {media}n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
