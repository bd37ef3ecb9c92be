"""Near duplicates by SuperMinHash signatures, bands, verification and union-find.

Every distinct shingle of a document walks a pseudorandom permutation of the signature's
places; at step j it offers the rank j plus a random fraction to the place it has reached,
and each place keeps the least offer. Ranks of one shingle are correlated, as it visits each
place once, which lowers the estimate's variance; a document is done after step j once all
its places hold less than j + 1, so long texts take a step or two.

Documents with equal sets (128 bits of hash) are one node. Nodes that agree in a band of
``ROWS`` places are compared, in blocks of bounded size, on whole signatures; where the
agreement is within ``SLACK`` standard deviations of the threshold, a pair may link. Each
step emits only a spanning forest of a block's pairs (union-find, likeliest first), links
are confirmed on whole sets and merged into components; the last step emits every pair that
still lies in two components. A pair at the threshold itself shares no band with probability
(1 - 0.8**4)**32 < 1e-7.

Defined results: a null text, or one without words, has an empty set and links with nothing;
a text of fewer words than a shingle is one shingle; rows that repeat, or share a key, are
documents of their own; the component is the least key that links reach, so of rows with
equal least keys each is kept; a null key counts as the least; an empty table gives an empty
result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from . import textops as T
from .links import merged
from .scratch import Scratch

WORDS = 4
#: Similarity of 80 / 100 or more links.
PERCENT = 80
PLACES = 128
ROWS = 4
#: Standard deviations that a link's estimate may lie under the threshold.
SLACK = 6
#: Bands of the first step, which joins most near copies; later steps only look at buckets that still hold two components.
FIRST = 4
#: Steps that emit spanning forests: the first on some bands, the second on all, later ones on buckets of several blocks.
FORESTS = 3
_FRACTION = 24
#: Shingles whose permutations are held at once.
_AT_ONCE = 1 << 16


def signatures(found: np.ndarray, first: np.ndarray, places: int = PLACES) -> np.ndarray:
    """A SuperMinHash signature for each set: ranks in the high bits, fractions in the low 24; ``first``: the index of each set's first element."""
    rows = len(first) - 1
    out = np.full((rows, places), np.iinfo(np.uint32).max, np.uint32)
    at = 0
    while at < rows:  # sets of about _AT_ONCE elements together; a larger one on its own
        stop = max(at + 1, int(np.searchsorted(first, first[at] + _AT_ONCE, "right")) - 1)
        _offer(out[at:stop], found[first[at] : first[stop]], np.repeat(np.arange(stop - at), np.diff(first[at : stop + 1])), places)
        at = stop
    return out


def _offer(out: np.ndarray, found: np.ndarray, owner: np.ndarray, places: int) -> None:
    flat, left = out.reshape(-1), np.arange(len(found))
    order: np.ndarray | None = None  # each element's permutation, drawn as far as it has been walked
    for step in range(places):
        draw = T.mix(found[left] + T.U64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        to = step + ((draw >> T.U64(32)) * T.U64(places - step) >> T.U64(32)).astype(np.int64)
        spot = to
        if order is not None:
            here = np.arange(len(left))
            spot = order[here, to].astype(np.int64)
            order[here, to] = order[here, step]
        np.minimum.at(flat, owner[left] * places + spot, (T.U64(step << _FRACTION) | (draw & T.U64((1 << _FRACTION) - 1))).astype(np.uint32))
        going = (out.max(1) >> _FRACTION > step)[owner[left]]
        if not going.any():
            return
        if order is None:
            left, to = left[going], to[going]
            order = np.tile(np.arange(places, dtype=np.uint16), (len(left), 1))
            order[np.arange(len(left)), to] = 0
        elif not going.all():
            left, order = left[going], order[going]


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of ``rows`` places, a row for each set."""
    n, places = signature.shape
    parts = signature.reshape(n, places // rows, rows).astype(T.U64)
    out = T.mix(np.arange(places // rows, dtype=T.U64) + T.U64(0x51ED270B))[None, :].repeat(n, 0)
    for k in range(rows):
        out = T.mix(out * T.U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def nodes(docs: DataFrame, text: str, key: str, k: int, places: int, rows: int) -> DataFrame:
    """(key, told, id, id2, n, signature, bands) of each document; ``id`` and ``id2`` hash its set, ``told`` its text; of a place the signature keeps a byte, bands are told by whole places."""
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(2), T.SLICE_BYTES // 2):
                found, first = jaccard.shingle_sets(data, offsets, k)
                one, two = jaccard.set_ids(found, first)
                made = signatures(found, first, places)
                keys = bands(made, rows)
                ends = np.arange(len(made) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(one), pa.array(two), pa.array(np.diff(first), pa.int64()), pa.array([s.tobytes() for s in made.astype(np.uint8)], pa.binary()), pa.ListArray.from_arrays(ends, keys.view(np.int64).ravel())],
                    ["key", "told", "id", "id2", "n", "signature", "bands"],
                )

    return jaccard._told(docs, text, key).mapInArrow(run, f"key {kind}, told long, id long, id2 long, n long, signature binary, bands array<long>")


def _candidates(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) of a group whose signatures may be those of a link, and the agreeing places; between its two sides, or within it where it has one."""
    get = lambda c: group.column(c).to_numpy()
    n, component, side = get("n"), get("component"), get("side")
    made = np.stack([np.frombuffer(s.as_buffer(), np.uint8) for s in group.column("signature")])
    p, places = percent / 100, made.shape[1]
    least = places * p - SLACK * math.sqrt(places * p * (1 - p))
    sides = np.unique(side)
    left, right = np.flatnonzero(side == sides[0]), np.flatnonzero(side == sides[-1])
    a, b, same = [], [], []
    for i in left.tolist():
        others = right[right > i] if len(sides) == 1 else right
        others = others[(component[others] != component[i]) & (100 * n[others] >= percent * n[i]) & (100 * n[i] >= percent * n[others])]
        if len(others):
            agree = (made[others] == made[i]).sum(1)
            near = agree >= least
            a.append(np.full(int(near.sum()), i))
            b.append(others[near])
            same.append(agree[near])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    one, two, agree = np.concatenate(a), np.concatenate(b), np.concatenate(same)
    if "tokens" in group.column_names and len(one):
        held = [np.frombuffer(t.as_buffer(), np.uint32) for t in group.column("tokens")]
        keep = np.zeros(len(one), bool)
        for k, (i, j) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
            both = np.concatenate([held[i], held[j]])
            both.sort(kind="stable")  # merges two sorted runs
            common = int((both[1:] == both[:-1]).sum())
            keep[k] = 100 * common >= percent * (len(both) - common)
        one, two, agree = one[keep], two[keep], agree[keep]
    return one, two, agree


def _low(sets: DataFrame) -> DataFrame:
    """(id, tokens) with 32 bits of each shingle's hash, sorted; equal ones within a set only raise a similarity, which is confirmed afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(np.frombuffer(t.as_buffer(), np.uint64).astype(np.uint32)).tobytes() for t in batch.column(1)], pa.binary())], ["id", "tokens"])

    return sets.mapInArrow(run, "id long, tokens binary")


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT, places: int = PLACES, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(key, id, n) of each document and (id, component) of the nodes that link with others."""
    scratch = Scratch(docs.sparkSession, "superminhash")
    made = scratch.save(nodes(docs, text, key, k, places, rows).withColumn("row", F.monotonically_increasing_id()), "nodes")
    known = made.where("n > 0").groupBy("id", "id2").agg(F.min(F.struct("key", "told", "row")).alias("rep")).withColumn("node", F.col("rep.row"))
    known = scratch.save(known, "known")
    base = made.select("key", "id", "id2", "n").join(known.select("id", "id2", "node"), ["id", "id2"], "left").select("key", F.col("node").alias("id"), "n")
    base = scratch.save(base, "base")
    own = scratch.save(made.join(known.select(F.col("node").alias("row")), "row").select(F.col("row").alias("id"), "n", "signature", "bands"), "own")
    scratch.drop("nodes")
    marks = own.select("id", "signature")
    spread = own.select("id", "n", F.posexplode("bands").alias("band", "token")).withColumn("rest", F.col("n"))
    shared = spread.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("token")
    shared = scratch.save(spread.join(shared, "token"), "shared")
    part, members = None, jaccard.Members(scratch, percent)
    for step in range(FORESTS + 1):
        last = step == FORESTS
        if step == 0:
            some = jaccard._open(shared.where(F.col("band") < FIRST), part, percent, scratch, "open-first")
        else:
            some = members.first(shared, part, "shared") if step == 1 else members.last(part) if last else members.larger(part, step)
        if some is None:
            continue
        held = marks
        if last:  # without a forest all pairs count, so only those whose sets are similar leave the task
            sets = jaccard.token_sets(some.select(F.col("id").alias("node")).distinct(), known, docs, scratch, "sets", text, key, k)
            held = scratch.save(marks.join(_low(sets), "id"), "held")  # a row a node, so that members are joined once
            scratch.drop("sets")
        met = (jaccard._met(some) if last else jaccard._dealt(some, step, "component")).join(held, "id")
        pairs = scratch.save(jaccard.search(met, percent, not last, _candidates), f"pairs-{step}")
        found = jaccard.verify(pairs, known, docs, scratch, f"links-{step}", text, key, k, percent)
        scratch.drop(f"pairs-{step}", *(["open-first"] if step == 0 else ["held", "open-last"] if last else []))
        part = merged(part, found, scratch, f"part-{step}")
    return base, part


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept): the least key that links reach, and whether it is the document's own."""
    base, linked = link(docs, text, key, k, percent, places, rows)
    return jaccard.labelled(base, linked, key).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
