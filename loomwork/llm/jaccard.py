"""N-gram Jaccard join: exact near duplicates by signature trees.

A document's set holds its distinct word shingles. Documents with the same set (by
128 bits of hash) are one node. Two nodes can only be similar if they share a shingle
of their prefixes, taken in an order that puts frequent shingles last (from a sketch
of fixed size), so that passages which many documents share make no large buckets.

Buckets are searched by signature trees: leaves hold token bitmaps of four to eight
bits a token, nodes the OR of theirs, size ranges, the most tokens that share a bit
and component ranges; pairs of nodes are descended together, and left when the
largest possible overlap is too small or both lie in one component. At the leaves the
places of the bucket's shingle bound the overlap too, as a pair is to be found where
its first common shingle is.

Searches come in steps. At first each bucket's nodes are dealt into blocks of bounded
size, and of a block's candidates only a spanning forest (the largest possible overlaps
first) goes to verification, which is linear however large a group of near copies is;
for buckets of several blocks this is done again with other blocks. The last step
emits every candidate pair that still lies in two components, so no link is lost.
What is emitted is verified on the whole sets.

Defined results: a null text, or one without words, has an empty set and links
with nothing; a text of fewer words than a shingle is one shingle; rows that
repeat, or share a key, are documents of their own; the component is the least key that
links reach, a null key counts as the least, so its rows and what they link with have a
null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .links import merged
from .scratch import Scratch

WORDS = 5
#: Similarity of 75 / 100 or more links.
PERCENT = 75
CELLS = 1 << 20
SKETCH_ROWS = 64
#: Partial sketches that are added up in a group at first; their sums meet in a second one.
SKETCH_GROUP = 64
#: Bits of the least bitmap.
BITS = 256
#: Nodes of a bucket that are searched together at most (pairs of blocks: twice as many).
BLOCK = 256
FAN = 8
#: Steps that emit spanning forests: the first on all buckets, later ones on those of several blocks.
FORESTS = 3
#: Bytes of bitmaps that are compared at once.
AT_ONCE = 1 << 25

Candidates = Callable[[pa.Table, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the index of each row's first."""
    begin, end, first = T.words(data, offsets)
    hashes = T.SpanHash(T.LOWER[data])(begin, end)
    found, at = T.windows(hashes, first, k)
    rows = T.row_of(first)[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = []
        for r in short:
            h = np.zeros(1, T.U64)
            for w in hashes[first[r] : first[r + 1]]:
                h = T.mix(h * T.U64(0x9E3779B97F4A7C15) + w)
            whole.append(h)
        found, rows = np.concatenate([found, *whole]), np.concatenate([rows, short])
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    found, rows = found[fresh], rows[fresh]
    return found, np.searchsorted(rows, np.arange(len(offsets)))


def set_ids(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    ids = []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        total = np.concatenate([np.zeros(1, T.U64), np.cumsum(T.mix(found + T.U64(salt)), dtype=T.U64)])
        ids.append(T.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(T.U64)).view(np.int64))
    return ids[0], ids[1]


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles of a set of n of which a similar set must share one."""
    return n - -(-percent * n // 100) + 1


def sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How far shingles are above the usual count, by cell of their hash, as powers of two (a byte a cell, of a fixed number of cells)."""
    width = CELLS // SKETCH_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(1)):
                total += np.bincount((shingle_sets(data, offsets, k)[0] >> T.U64(44)).astype(np.int64), minlength=CELLS)
            part = batch.column(0)[:1].to_pylist()
        if total.any():
            rows = np.minimum(total, np.iinfo(np.int32).max).astype("<i4").reshape(SKETCH_ROWS, width)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part * SKETCH_ROWS, pa.int32()), "row": pa.array(range(SKETCH_ROWS), pa.int32()), "cells": [r.tobytes() for r in rows]})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c in table.column("cells"):
            total += np.frombuffer(c.as_buffer(), "<i4" if len(c.as_buffer()) == 4 * width else "<i8")
        return pa.table({"row": table.column("row")[:1], "cells": pa.array([total.tobytes()], pa.binary())})

    made = docs.select(F.spark_partition_id().alias("part"), text).mapInArrow(count, "part int, row int, cells binary")
    some = made.groupBy("row", F.floor(F.col("part") / SKETCH_GROUP).alias("group")).applyInArrow(add, "row int, cells binary")
    found = np.zeros((SKETCH_ROWS, width), np.int64)
    for r in some.groupBy("row").applyInArrow(add, "row int, cells binary").collect():
        found[r["row"]] = np.frombuffer(r["cells"], "<i8")
    return np.log2(np.maximum(found.ravel() - int(np.median(found)), 1)).astype(np.uint8)


def signatures(found: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Token bitmaps of each set, of four to eight bits a token (the next power of two)."""
    n, owner, out = np.diff(first), T.row_of(first), [b""] * (len(first) - 1)
    bits = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64))
    for size in np.unique(bits):
        for at in range(0, len(rows := np.flatnonzero(bits == size)), step := max(1, AT_ONCE // int(size))):
            some = rows[at : at + step]
            place = np.full(len(n), -1)
            place[some] = np.arange(len(some))
            own = place[owner] >= 0
            marks = np.zeros((len(some), size), bool)
            marks[place[owner[own]], (found[own] & T.U64(size - 1)).astype(np.int64)] = True
            for r, packed in zip(some, np.packbits(marks, axis=1), strict=True):
                out[r] = packed.tobytes()
    return out


def folded(signature: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, a row each, as narrow ones of ``width`` bytes."""
    while signature.shape[1] > width:
        half = signature.shape[1] // 2
        signature = signature[:, :half] | signature[:, half:]
    return signature


def nodes(docs: DataFrame, text: str, key: str, k: int, percent: int) -> DataFrame:
    """(key, told, id, id2, n, least, signature, prefix) of each document; ``id`` and ``id2`` hash its set, ``told`` its text."""
    spark, kind = docs.sparkSession, dict(docs.select(key).dtypes)[key]
    order = spark.sparkContext.broadcast(sketch(docs, text, k))  # CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = order.value
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(2), T.SLICE_BYTES // 2):
                found, first = shingle_sets(data, offsets, k)
                rows, n = T.row_of(first), np.diff(first)
                ranked = np.lexsort((found, weight[(found >> T.U64(44)).astype(np.int64)], rows))
                head = (np.arange(len(found)) - first[rows]) < prefix_size(n, percent)[rows]
                prefix = found[ranked][head]
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows[head], minlength=len(n)))]).astype(np.int32)
                least = np.append(found, T.U64(0))[np.minimum(first[:-1], len(found))]
                one, two = set_ids(found, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(one), pa.array(two), pa.array(n, pa.int64()), pa.array(least.view(np.int64)), pa.array(signatures(found, first), pa.binary()), pa.ListArray.from_arrays(ends, prefix.view(np.int64))],
                    ["key", "told", "id", "id2", "n", "least", "signature", "prefix"],
                )

    return _told(docs, text, key).mapInArrow(run, f"key {kind}, told long, id long, id2 long, n long, least long, signature binary, prefix array<long>")


def _told(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("told"), F.col(text).alias("text"))


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def bound(sig_a: np.ndarray, i: np.ndarray, sig_b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that rows ``i`` of one table of bitmaps and rows ``j`` of the other share."""
    out, step = np.zeros(len(i), np.int64), max(1, AT_ONCE // sig_a.shape[1])
    for at in range(0, len(i), step):
        out[at : at + step] = _POP[sig_a[i[at : at + step]] & sig_b[j[at : at + step]]].sum(-1, dtype=np.int64)
    return out


class Tree:
    """Levels of nodes, leaves first; each holds FAN nodes of the level below."""

    def __init__(self, n: np.ndarray, rest: np.ndarray, component: np.ndarray, signature: np.ndarray):
        spare = n - _POP[signature].sum(1, dtype=np.int64)
        self.levels = [(n, n, component, component, signature, spare, rest)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            pick = (np.minimum, np.maximum, np.minimum, np.maximum, np.bitwise_or, np.maximum, np.maximum)
            self.levels.append(tuple(f.reduceat(v, at, axis=0) for f, v in zip(pick, self.levels[-1], strict=True)))

    def pairs(self, other: Tree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves (here, there) that may be similar, level by level from both roots, and their largest possible overlap."""
        top = max(len(self.levels), len(other.levels))
        i = j = np.zeros(1, np.int64)
        most = i
        for level in range(top - 1, -1, -1):
            a, b = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            if self is other:
                i, j = i[i <= j], j[i <= j]
            # the largest overlap of sizes (x, y) is needed to be percent / (100 + percent) * (x + y)
            fits = (100 * a[1][i] >= percent * b[0][j]) & (100 * b[1][j] >= percent * a[0][i])
            fits &= (100 + percent) * np.minimum(a[6][i], b[6][j]) >= percent * (a[0][i] + b[0][j])
            fits &= ~((a[2][i] == a[3][i]) & (b[2][j] == b[3][j]) & (a[2][i] == b[2][j]))
            i, j = i[fits], j[fits]
            most = np.minimum(bound(a[4], i, b[4], j) + np.minimum(a[5][i], b[5][j]), np.minimum(a[6][i], b[6][j]))
            fits = (100 + percent) * most >= percent * (a[0][i] + b[0][j])
            i, j, most = i[fits], j[fits], most[fits]
            if level:
                down = lambda v, tree: (v[:, None] * FAN + np.arange(FAN)) if level < len(tree.levels) else np.repeat(v[:, None], 1, 1)
                di, dj = down(i, self), down(j, other)
                i, j = np.repeat(di, dj.shape[1], 1).ravel(), np.tile(dj, (1, di.shape[1])).ravel()
                below_a, below_b = self.levels[min(level - 1, len(self.levels) - 1)], other.levels[min(level - 1, len(other.levels) - 1)]
                there = (i < len(below_a[0])) & (j < len(below_b[0]))
                i, j = i[there], j[there]
        own = i < j if self is other else np.ones(len(i), bool)
        return i[own], j[own], most[own]


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Indexes of the pairs of a spanning forest over components, the heaviest pairs first."""
    root = {c: c for c in component.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kept, open_ = [], len(root)
    ca, cb = component[a].tolist(), component[b].tolist()
    for i in np.lexsort((b, a, -weight)).tolist():
        x, y = find(ca[i]), find(cb[i])
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
            open_ -= 1
            if open_ == 1:
                break
    return np.array(kept, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of equal values of a sorted column, across batches, as tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(batch.schema.get_field_index(column))[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) of a group that may be similar, and how near they may be; between its two sides, or within it where it has one."""
    get = lambda c: group.column(c).to_numpy()
    n, rest, component, side, order = get("n"), get("rest"), get("component"), get("side"), get("near")
    raw = [s.as_buffer() for s in group.column("signature")]
    width = np.array([len(s) for s in raw])
    trees: dict[tuple[int, int, int], tuple[Tree, np.ndarray]] = {}

    def tree(at: int, size: int, to: int) -> tuple[Tree, np.ndarray] | None:
        if (at, size, to) not in trees:
            rows = np.flatnonzero((side == at) & (width == size))
            rows = rows[np.lexsort((n[rows], order[rows]))]  # similar ones are neighbours
            if not len(rows):
                return None
            packed = np.frombuffer(b"".join(raw[r] for r in rows), np.uint8).reshape(len(rows), size)
            trees[at, size, to] = Tree(n[rows], rest[rows], component[rows], folded(packed, to)), rows
        return trees[at, size, to]

    found, sides = [], np.unique(side)
    x, y = sides[0], sides[-1]
    for w in np.unique(width):
        # sets that may be similar have bitmaps of one size or of two that follow each other
        for v in (w, 2 * w) if x == y else (w, 2 * w, w // 2):
            to = min(w, v)
            one, two = tree(x, w, to), tree(y, v, to)
            if one and two:
                i, j, most = one[0].pairs(two[0], percent)
                found.append((one[1][i], two[1][j], most))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, most = (np.concatenate(v) for v in zip(*found, strict=True))
    return a, b, most / np.maximum(n[a] + n[b], 1)


def search(members: DataFrame, percent: int, spanning: bool, candidates: Candidates = _candidates) -> DataFrame:
    """Pairs (a, b) of ids in one group, not in one component, that signatures let be similar; or only forests of them.

    ``members``: (g, side, id, n, rest, component, near, signature).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "g"):
            a, b, most = candidates(group, percent)
            if spanning and len(a) > 1:
                kept = forest(a, b, most, group.column("component").to_numpy())
                a, b = a[kept], b[kept]
            if len(a):
                ids = group.column("id").to_numpy()
                a, b = ids[a], ids[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (2, 3))
                both = np.sort(np.concatenate([x, y]))  # each is distinct
                common = int((both[1:] == both[:-1]).sum())
                kept.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def token_sets(ids: DataFrame, known: DataFrame, docs: DataFrame, scratch: Scratch, name: str, text: str, key: str, k: int) -> DataFrame:
    """(id, tokens): the shingle hashes of the nodes in ``ids`` (node), sorted, from their whole texts."""

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(1).to_numpy()
            for i, j, data, offsets in T.slices(batch.column(2)):
                found, first = shingle_sets(data, offsets, k)
                own = np.flatnonzero(set_ids(found, first)[0] == told[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(own)), pa.array([found[first[r] : first[r + 1]].tobytes() for r in own], pa.binary())], ["id", "tokens"])

    needed = ids.join(known, "node").select("node", "id", F.col("rep.key").alias("own"), F.col("rep.told").alias("told"))
    texts = _told(docs, text, key).alias("d").join(needed.alias("w"), F.col("d.key").eqNullSafe(F.col("w.own")) & (F.col("d.told") == F.col("w.told")))
    made = texts.select("w.node", "w.id", "d.text").mapInArrow(tokens_of, "id long, tokens binary")
    return scratch.save(made.groupBy("id").agg(F.first("tokens").alias("tokens")), name)  # rows may repeat


def verify(pairs: DataFrame, known: DataFrame, docs: DataFrame, scratch: Scratch, name: str, text: str, key: str, k: int, percent: int) -> DataFrame:
    """The similar ones of the saved ``pairs``, from the whole texts of their nodes."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = token_sets(ids, known, docs, scratch, f"{name}-sets", text, key, k)
    found = scratch.save(_similar(pairs, sets, percent), name)
    scratch.drop(f"{name}-sets")
    return found


def _open(members: DataFrame, part: DataFrame | None, percent: int, scratch: Scratch, name: str, *done: str) -> DataFrame:
    """Members of the buckets that hold more than one component, each with its component and the bucket's size; saved.

    ``members``: (token, id, n, rest); of the buckets of the same nodes the one of the
    first shingle is left, and buckets of two nodes only where their sizes and places
    let them be similar. ``done``: tables that are dropped once members have their components.
    """
    members = members.select("token", "id", "n", "rest")
    if part is None:
        labelled = members.withColumn("component", F.col("id"))
    else:  # read twice, so labels are written, and joined once
        labelled = members.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = scratch.save(labelled, f"{name}-labels")
        scratch.drop(*done)
    who = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"who{i}") for i in (0, 1)]
    mixed = labelled.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), *who, F.count("*").alias("size"), F.sum("rest").alias("rests"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("rest").alias("r0"))
    two = (100 * F.col("n0") >= percent * F.col("n1")) & ((100 + percent) * F.col("r0") >= percent * (F.col("n0") + F.col("n1")))
    mixed = mixed.where(F.col("c0") != F.col("c1")).where((F.col("size") > 2) | two)
    mixed = mixed.groupBy("who0", "who1", "size").agg(F.max_by("token", "rests").alias("token")).select("token", "size")
    found = scratch.save(labelled.join(mixed, "token").select("token", "size", "id", "n", "rest", "component"), name)
    scratch.drop(f"{name}-labels", *done)
    return found


class Members:
    """Members of the open buckets from step to step: those of one block wait for the last step, larger ones are labelled at each."""

    def __init__(self, scratch: Scratch, percent: int):
        self.scratch, self.percent = scratch, percent

    def first(self, members: DataFrame, part: DataFrame | None, *done: str) -> DataFrame:
        """Those of all buckets."""
        found = _open(members, part, self.percent, self.scratch, "open", *done)
        self.small, self.large = found.where(F.col("size") <= BLOCK), found.where(F.col("size") > BLOCK)
        return found

    def larger(self, part: DataFrame, step: int) -> DataFrame | None:
        """Those of the buckets of several blocks, if there are any."""
        if self.large.isEmpty():
            return None
        self.large = _open(self.large, part, self.percent, self.scratch, f"open-{step}", f"open-{step - 1}")
        return self.large

    def last(self, part: DataFrame) -> DataFrame:
        return _open(self.small.union(self.large), part, self.percent, self.scratch, "open-last", "open", *(f"open-{step}" for step in range(1, FORESTS)))


def _dealt(members: DataFrame, step: int, near: str) -> DataFrame:
    """``members`` by random blocks of their buckets."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(step)), blocks)
    return members.select(F.xxhash64("token", own).alias("g"), F.lit(0).alias("side"), "id", "n", "rest", "component", F.col(near).alias("near"))


def _met(members: DataFrame) -> DataFrame:
    """``members`` by groups in which all pairs of different components meet.

    A bucket of several blocks is dealt into those of its largest component, which need
    not meet each other, and those of its other nodes, which meet all.
    """
    small = members.where(F.col("size") <= BLOCK).select(F.xxhash64("token").alias("g"), F.lit(0).alias("side"), "id", "n", "rest", "component", F.col("component").alias("near"))
    large = members.where(F.col("size") > BLOCK)
    counts = large.groupBy("token", "component").agg(F.count("*").alias("many"))
    main = counts.groupBy("token").agg(F.max(F.struct("many", "component")).alias("main")).select("token", F.col("main.component").alias("main"), F.ceil(F.col("main.many") / BLOCK).cast("int").alias("hb"), F.col("main.many").alias("many"))
    large = large.join(main, "token").withColumn("ob", F.ceil((F.col("size") - F.col("many")) / BLOCK).cast("int")).withColumn("inner", F.col("component") == F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("hb")).otherwise(F.col("ob"))).cast("int")
    large = large.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    me = F.col("own")
    inner = F.transform(upto("ob"), lambda o: spot(0, me, o, F.lit(0)))
    outer = F.concat(F.transform(upto("hb"), lambda h: spot(0, h, me, F.lit(1))), F.transform(upto("ob"), lambda o: spot(1, F.least(me, o), F.greatest(me, o), F.when(me == F.greatest(me, o), 1).otherwise(0))))
    large = large.withColumn("at", F.explode(F.when(F.col("inner"), inner).otherwise(outer)))
    large = large.select(F.xxhash64("token", "at.kind", "at.x", "at.y").alias("g"), F.when((F.col("at.kind") == 1) & (F.col("at.x") == F.col("at.y")), 0).otherwise(F.col("at.side")).alias("side"), "id", "n", "rest", "component", F.col("component").alias("near"))
    return small.union(large)


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(key, id, n) of each document and (id, component) of the nodes that link with others."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    made = scratch.save(nodes(docs, text, key, k, percent).withColumn("row", F.monotonically_increasing_id()), "nodes")
    known = made.where("n > 0").groupBy("id", "id2").agg(F.min(F.struct("key", "told", "row")).alias("rep")).withColumn("node", F.col("rep.row"))
    known = scratch.save(known, "known")
    base = made.select("key", "id", "id2", "n").join(known.select("id", "id2", "node"), ["id", "id2"], "left").select("key", F.col("node").alias("id"), "n")
    base = scratch.save(base, "base")
    own = made.join(known.select(F.col("node").alias("row")), "row")
    own = scratch.save(own.select(F.col("row").alias("id"), "n", "least", "signature", "prefix"), "own")
    scratch.drop("nodes")
    marks = own.select("id", "least", "signature")
    tokens = own.select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "id", "n", (F.col("n") - F.col("pos")).alias("rest"))
    buckets = tokens.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("token")
    shared = scratch.save(tokens.join(buckets, "token"), "shared")
    part, members = None, Members(scratch, percent)
    for step in range(FORESTS + 1):
        last = step == FORESTS
        some = members.first(shared, part, "shared") if step == 0 else members.last(part) if last else members.larger(part, step)
        if some is not None:
            met = (_met(some) if last else _dealt(some, step, "component")).join(marks, "id")
            if step == 0:
                met = met.withColumn("near", F.col("least"))
            pairs = scratch.save(search(met.drop("least"), percent, not last), f"pairs-{step}")
            found = verify(pairs, known, docs, scratch, f"links-{step}", text, key, k, percent)
            scratch.drop(f"pairs-{step}")
            part = merged(part, found, scratch, f"part-{step}")
    return base, part


def labelled(base: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """(key, n_shingles, component_id) of the documents in ``base`` (key, id, n); ``linked``: (id, component)."""
    whole = base.where("n > 0").join(linked, "id", "left").withColumn("class", F.coalesce("component", "id"))
    least = whole.groupBy("class").agg(F.min(F.struct("key")).alias("least"))
    found = whole.join(least, "class").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("least.key").alias("component_id"))
    return found.unionByName(base.where("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id")))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id): the least key that links reach; a document's own where its set is empty."""
    return labelled(*link(docs, text, key, k, percent), key)
