"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising runs in Arrow batches on the executors. What has to be decided
globally is decided on the histogram of piece lengths, which has at most
``capacity`` rows whatever the input's size: pieces above one third of the
capacity are matched greedily, at most two to a sequence, and the shorter ones
go, longest first, to the fullest sequence that still has room. The plan is a
table of runs ("of length s, the pieces ranked lo..hi go k to a sequence from
sequence q at offset o"), so its size too depends on the capacity alone and it
is safe to broadcast. Pieces get their rank within their length by two-level
counting, so that no length, however common, is ordered in one task.

Defined results: a null text counts as empty, an empty text is the end token
alone; rows that repeat (or share a ``doc_id``) are packed as documents of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CAPACITY = 4096
END_ID = 1
#: Words kept with their ids in each Python worker.
CACHE_WORDS = 600_000

_LATIN = "a-z\xdf-\xf6\xf8-\xff"
#: Texts whose pieces the expression below gives just as the tokenizer's own one does.
_PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\t-\r {_LATIN}0-9]+")
#: White space to str.split() but not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
#: How byte-level vocabularies write the 256 bytes.
_BYTES = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_BYTES |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTES)}


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The tokenizer drops white space, no token spans it, and it lower-cases; pieces
    come back often, so their ids are kept. Texts of ASCII and Latin-1 letters are
    cut here and go piece by piece to the tokenizer's merge model; the words of
    all other texts go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isalpha() and piece.isascii() else "".join(map(_BYTES.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __call__(self, text: str) -> bytes:
        if (text.isascii() or _PLAIN.fullmatch(text)) and not any(s in text for s in self.special):
            parts, seen, make = _PIECE.findall(text.lower()), self.pieces, self._piece
        elif _ODD.search(text):
            return self._whole(text)
        else:
            parts, seen, make = text.split(), self.seen, self._whole
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in set(parts).difference(seen):
            seen[w] = make(w)
        return b"".join(map(seen.__getitem__, parts))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's pieces of at most ``capacity`` tokens."""
    path = tokenizer or default_tokenizer()
    kind = dict(docs.select(key).dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "") + end
                n = len(ids) // 4
                for p in range(-(-n // capacity)):
                    part = ids[p * capacity * 4 : (p + 1) * capacity * 4]
                    rows.append(i)
                    piece.append(p)
                    start.append(p * capacity)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs (length, first rank, last rank, pieces of it in a sequence, first sequence, offset).

    ``counts``: pieces of each length. Large pieces, longest first, each take the
    longest large partner that fits; small ones, longest first, the smallest
    sufficient gap.
    """
    runs: list[Run] = []
    left = {s: n for s, n in counts.items() if n > 0}
    done = dict.fromkeys(left, 0)
    opened = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number) of sequences

    def put(size: int, n: int, each: int, first: int, offset: int) -> None:
        runs.append((size, done[size], done[size] + n - 1, each, first, offset))
        done[size] += n
        left[size] -= n

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((first, number))

    rooms: list[int] = []
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    open_large = sorted(large)
    for size in large:
        while left[size]:
            at = bisect.bisect_right(open_large, min(size, capacity - size)) - 1
            while at >= 0 and not left[open_large[at]]:
                open_large.pop(at)
                at -= 1
            partner = open_large[at] if at >= 0 else 0
            if partner and partner != size:
                n = min(left[size], left[partner])
                put(size, n, 1, opened, 0)
                put(partner, n, 1, opened, size)
            elif partner and left[size] > 1:
                n = left[size] // 2
                put(size, 2 * n, 2, opened, 0)
            else:
                n, partner = left[size], 0
                put(size, n, 1, opened, 0)
            leave(capacity - size - partner, opened, n)
            opened += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                need = -(-left[size] // (capacity // size))
                leave(capacity, opened, need)
                opened += need
                continue
            room = rooms[at]
            first, number = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            each = room // size
            full = min(number, left[size] // each)
            if full:
                put(size, full * each, each, first, capacity - room)
                leave(room - each * size, first, full)
                first, number = first + full, number - full
            rest = left[size]
            if number and rest:
                put(size, rest, rest, first, capacity - room)
                leave(room - rest * size, first, 1)
                first, number = first + 1, number - 1
            leave(room, first, number)
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", bucket_rows: int = 20_000) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies in its sequence."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer, capacity, text, key), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(counts, capacity)
    table = F.broadcast(spark.createDataFrame(runs or [(0, 0, -1, 1, 0, 0)], "run_length long, lo long, hi long, each long, first long, place long"))
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    within = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32")
    ranked = cut.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    j = F.col("rank") - F.col("lo")
    placed = ranked.join(table, (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("lo"), F.col("hi")))
    return placed.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(j / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("place") + (j % F.col("each")) * F.col("length")).alias("offset"),
    )
