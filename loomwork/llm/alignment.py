"""Alignment of two tokenizers over a corpus by segment deduplication.

``space + text`` is cut before runs of spaces or line breaks that follow another character.
No token of either vocabulary holds such a cut (``Pair`` reads that from the vocabularies and
leaves out pairs of bytes that a token does hold), so tokens of a segment are those it has in
the whole text. Texts are dealt into slices of bounded size; a slice lists its distinct
segments once, and its documents as places in that list. Distinct segments of the corpus are
tokenised and aligned once, pair counts follow from them and their numbers, and the scores
are joined back to the slices' lists, from which documents are composed.

Defined results: a null or empty text has no tokens, as has one whose tokens don't give back
its bytes (it holds U+2581, which one vocabulary writes for a space): counts of 0 and an empty
column, and nothing of it counts in the corpus; a segment whose bytes differ makes its whole
document such a text. Rows that repeat, or share a key, count each; keys may be null; an empty
table gives an empty result; special tokens' strings are plain text; texts are read whole;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _BYTES
from .scratch import Scratch

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE = 16 << 20
#: Rows that are dealt to slices together.
BLOB_ROWS = 1 << 18
MARK = "▁"
_SPLIT = b" \n"
#: White space outside ASCII, in UTF-8.
_WIDE = [c.encode() for c in "\u0085                 　"]


def _default_paths() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, the bytes of their tokens, and where texts may be cut."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(byte_level)
        self.one.encode_special_tokens = True
        self.two = SentencePieceProcessor(model_file=pieces)
        back = {c: b for b, c in _BYTES.items()}
        self.bytes_one = [b""] * self.one.get_vocab_size()
        for token, i in self.one.get_vocab().items():
            self.bytes_one[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        sp = self.two
        self.bytes_two = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(sp.id_to_piece(list(range(sp.get_piece_size()))))]
        self.size_one, self.size_two = (np.array([len(b) for b in v], np.int64) for v in (self.bytes_one, self.bytes_two))
        self.blank = sp.piece_to_id(MARK)
        held = {pair for v in (self.bytes_one, self.bytes_two) for b in v for pair in pairwise(b)}
        self.open = np.zeros((256, 256), bool)  # (last byte before, first byte after) of a cut
        for after in _SPLIT:
            if after == 0x20 or (0x20, after) not in held:  # a line break must not join with the space that the pieces' tokenizer adds
                self.open[0x21:, after] = True
        self.open[0x7F, :] = False
        for pair in held:
            self.open[pair] = False

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places of a text at which segments begin, but for its start."""
        places = np.flatnonzero((data == _SPLIT[0]) | (data == _SPLIT[1]))
        places = places[places >= 1]
        places = places[self.open[data[places - 1], data[places]]]
        far = data[places - 1] >= 0x80
        before = [data[np.maximum(places[far] - k, 0)].astype(np.int64) for k in (1, 2, 3)]
        last2, last3 = before[0] | before[1] << 8, before[0] | before[1] << 8 | before[2] << 16
        keep = np.ones(len(places), bool)
        keep[far] = ~(np.isin(last2, [int.from_bytes(w, "big") for w in _WIDE if len(w) == 2]) | np.isin(last3, [int.from_bytes(w, "big") for w in _WIDE if len(w) == 3]))
        return places[keep]

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers; a segment begins with the space that the second one would add, or with a line break."""
        one = [e.ids for e in self.one.encode_batch_fast(segments, add_special_tokens=False)]
        two = self.two.encode([s[1:] if s.startswith(" ") else s for s in segments], num_threads=1)
        for k, (s, t) in enumerate(zip(segments, two, strict=True)):
            if s == " ":
                two[k] = [self.blank]  # of an empty text the second one makes no tokens
            elif not s.startswith(" "):
                two[k] = t[1:] if t[:1] == [self.blank] else []
        return one, two


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def align(pair: Pair, segments: list[str]) -> dict[str, list]:
    """Of each segment: whether its tokens give back its bytes, its counts, its groups as text and its links as packed ids."""
    one, two = pair.tokens(segments)
    raw = [s.encode() for s in segments]
    good = [b"".join(map(pair.bytes_one.__getitem__, a)) == r and b"".join(map(pair.bytes_two.__getitem__, b)) == r for a, b, r in zip(one, two, raw, strict=True)]
    one, two = ([t if g else [] for t, g in zip(v, good, strict=True)] for v in (one, two))
    na, nb = np.array([len(t) for t in one]), np.array([len(t) for t in two])
    a, b = np.array([i for t in one for i in t], np.int64), np.array([i for t in two for i in t], np.int64)
    ea, eb = np.cumsum(pair.size_one[a]), np.cumsum(pair.size_two[b])  # good segments cover the same bytes in both
    sa = ea - pair.size_one[a]
    low, high = np.searchsorted(eb, sa, "right"), np.searchsorted(eb - pair.size_two[b], ea, "left")
    links = high - low
    at = np.repeat(np.arange(len(a)), links)
    there = np.arange(len(at)) - np.repeat(np.cumsum(links) - links, links) + np.repeat(low, links)
    packed = a[at] << 32 | b[there]
    shared = np.isin(ea, eb)
    last_a, last_b = np.flatnonzero(shared), np.searchsorted(eb, ea[shared])
    first_a, first_b = np.concatenate([[0], last_a + 1]).tolist(), np.concatenate([[0], last_b + 1]).tolist()
    ta, tb = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups = [",".join(ta[x:y]) + "|" + ",".join(tb[u:v]) for x, y, u, v in zip(first_a, first_a[1:], first_b, first_b[1:], strict=False)]
    ends = np.cumsum(na)
    done = np.concatenate([[0], np.cumsum(shared)])
    n_groups = done[ends] - done[ends - na]
    total = np.concatenate([[0], np.cumsum(links)])
    n_links = total[ends] - total[ends - na]
    g = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
    return {"good": good, "n_a": na, "n_b": nb, "n_groups": n_groups, "n_links": n_links, "groups": [";".join(groups[x:y]) for x, y in pairwise(g)], "links": (packed, n_links)}


def _planes(places: np.ndarray) -> bytes:
    """Numbers as bytes of one weight after those of another, which compresses well as high ones are zero."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(planes: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def slices(docs: DataFrame, paths: tuple[str, str], key: str, text: str) -> DataFrame:
    """Rows of two kinds: (slice, place, segment, n) of a slice's distinct segments, and (slice, key, spots) of its documents."""
    kind = dict(docs.select(key).dtypes)[key]

    def cut(keys: pa.Array, texts: pa.Array, part: int, number: int) -> pa.RecordBatch:
        whole = [b" " + v.as_buffer().to_pybytes() if v.is_valid and len(v.as_buffer()) else b"" for v in texts]
        stops = np.cumsum([len(w) for w in whole])
        raw = b"".join(whole)
        data = np.frombuffer(raw, np.uint8)
        starts = np.union1d(np.concatenate([[0], stops]), _pair(paths).cuts(data)) if raw else np.zeros(1, np.int64)
        segments = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        place = segments.indices.to_numpy()
        first = np.searchsorted(starts, np.concatenate([[0], stops]))
        spots = [_planes(place[a:b]) for a, b in pairwise(first.tolist())]
        n, m = len(segments.dictionary), len(spots)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + m, (part << 33) + number)), pa.concat_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.nulls(m, pa.int32())]), pa.concat_arrays([segments.dictionary.cast(pa.binary()).cast(pa.string()), pa.nulls(m, pa.string())]),
            pa.concat_arrays([pa.array(np.bincount(place, minlength=n), pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, keys.type), keys]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(spots, pa.binary())]),
        ], ["slice", "place", "segment", "n", "key", "spots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number, part = 0, 0, 0

        def out() -> pa.RecordBatch:
            return cut(pa.concat_arrays([h.column(1) for h in held]), pa.concat_arrays([h.column(2) for h in held]), part, number)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            lengths = np.cumsum(batch.column(3).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(lengths, SLICE - size + (lengths[at - 1] if at else 0), "right"))
                stop = max(stop, at + (not held))
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    size += int(lengths[stop - 1] - (lengths[at - 1] if at else 0))
                if stop < batch.num_rows:
                    yield out()
                    held, size, number = [], 0, number + 1
                at = stop
        if held:
            yield out()

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    return rows.mapInArrow(run, f"slice long, place int, segment string, n long, key {kind}, spots binary")


def aligned(segments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The alignment of each distinct segment; ``segments``: (segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                own = batch.column(0).slice(i, 5000)
                got = align(pair, own.to_pylist())
                packed, n = got["links"]
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own, pa.array(got["good"]), *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(got["groups"], pa.string()), pa.ListArray.from_arrays(ends, packed)], ["segment", "good", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return segments.mapInArrow(run, "segment string, good boolean, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>")


def _without(lists: pa.Table, documents: pa.Table) -> pa.Table:
    """(segment, n): a slice's segments without the documents that hold a bad one."""
    good = np.ones(lists.num_rows, bool)
    good[lists.column("place").to_numpy()] = lists.column("good").to_numpy(zero_copy_only=False)
    total = np.zeros(lists.num_rows, np.int64)
    for s in documents.column("spots"):
        own = _places(s)
        if good[own].all():
            total += np.bincount(own, minlength=len(total))
    n = total[lists.column("place").to_numpy()]
    return pa.table({"segment": lists.column("segment"), "n": pa.array(n)}).filter(pa.array(n > 0))


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, blob): rows of a slice that a task has at hand, as one compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().sort_by("slice")
        where = rows.column("slice").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]]).tolist()
        blobs = []
        for x, y in pairwise(cuts):
            sink = pa.BufferOutputStream()
            own = rows.slice(x, y - x).drop_columns(["slice"])
            with pa.ipc.new_stream(sink, own.schema, options=options) as stream:
                stream.write_table(own)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]]), pa.array(blobs, pa.binary())], ["slice", "blob"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(h.num_rows for h in held) >= BLOB_ROWS:
                yield out(held)
                held = []
    if held:
        yield out(held)


def _composed(blobs: pa.Table, documents: pa.Table) -> pa.Table:
    """(key, counts, groups_sha256) of a slice's documents."""
    found = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs.column("blob")]
    lists = pa.concat_tables(found).combine_chunks() if found else pa.table({c: pa.array([], pa.int64()) for c in ("place", *COUNTS)} | {"good": pa.array([], pa.bool_()), "groups": pa.array([], pa.string())})
    place = lists.column("place").to_numpy()
    order = np.argsort(place)
    good = lists.column("good").to_numpy(zero_copy_only=False)[order]
    values = np.column_stack([lists.column(c).to_numpy()[order] for c in COUNTS]) if lists.num_rows else np.zeros((0, len(COUNTS)), np.int64)
    groups = [s.encode() for s in lists.column("groups").take(pa.array(order)).to_pylist()]
    found, digests = np.zeros((documents.num_rows, len(COUNTS)), np.int64), []
    for i, s in enumerate(documents.column("spots")):
        own = _places(s)
        if len(own) and good[own].all():
            found[i] = values[own].sum(0)
            digests.append(hashlib.sha256(b";".join(map(groups.__getitem__, own.tolist()))).hexdigest())
        else:
            digests.append("")
    return pa.table([documents.column("key"), *(pa.array(found[:, k]) for k in range(len(COUNTS))), pa.array(digests, pa.string())], ["key", *COUNTS, "groups_sha256"])


def documents_and_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, counts, groups_sha256) of each document, and (a, b, count, best) of each linked pair of ids of the corpus."""
    scratch, paths = Scratch(docs.sparkSession, "alignment"), paths or _default_paths()
    kind = dict(docs.select(key).dtypes)[key]
    made = scratch.save(slices(docs, paths, key, text), "slices", "zstd")
    lists, documents = made.where("place is not null").select("slice", "place", "segment", "n"), made.where("place is null").select(F.col("slice").alias("own"), "key", "spots")
    distinct = lists.groupBy("segment").agg(F.sum("n").alias("n"))
    known = scratch.save(aligned(distinct.select("segment"), paths).withColumn("id", F.monotonically_increasing_id()), "aligned", "zstd")
    bad = known.where("not good")
    if bad.isEmpty():
        counts = distinct
    else:  # slices that hold a bad segment count anew
        hit = scratch.save(lists.join(bad.select("segment"), "segment", "left_semi").select("slice").distinct(), "hit")
        own = lists.join(hit, "slice", "left_semi").join(known.select("segment", "good"), "segment")
        anew = own.groupBy("slice").cogroup(documents.join(hit.select(F.col("slice").alias("own")), "own", "left_semi").groupBy("own")).applyInArrow(_without, "segment string, n long")
        counts = lists.join(hit, "slice", "left_anti").select("segment", "n").unionByName(anew).groupBy("segment").agg(F.sum("n").alias("n"))
    held = known.where("good").join(counts, "segment").select("n", F.explode("links").alias("pair"))
    pairs = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = scratch.save(pairs, "pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    rated = pairs.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    spread = known.where("n_links > 0").select("id", F.explode("links").alias("pair"))
    scores = spread.join(rated, "pair").groupBy("id").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    whole = known.drop("links").join(scores, "id", "left").drop("id").fillna(0, ["n_best", "count_sum"])
    whole = scratch.save(whole, "scored", "zstd")
    scratch.drop("aligned")
    back = scratch.save(lists.select("slice", "place", "segment").join(whole, "segment").drop("segment").mapInArrow(_blobs, "slice long, blob binary"), "back")
    scratch.drop("scored")
    found = back.groupBy("slice").cogroup(documents.groupBy("own")).applyInArrow(_composed, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string")
    ids = pairs.join(best, "b").select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("b").cast("int"), "count", (F.col("count") == F.col("most")).alias("best"))
    return found.withColumnRenamed("key", key), ids


def alignment(docs: DataFrame, text: str = "text", key: str = "doc_id", paths: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    return documents_and_pairs(docs, text, key, paths)[0]
