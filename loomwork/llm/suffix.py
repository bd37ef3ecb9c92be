"""Suffix-array dedup: removes bytes of strings of ``width`` bytes that start earlier in the corpus.

Equal strings have equal minimizers (the least hash of their ``GRAM``-byte grams),
so runs of consecutive windows with one minimizer are the unit of work: a run is
sent to the shard of its minimizer, and equal windows always meet there. What is
hot is aggregated first: of runs that are equal only the first goes on, the other
ones lie wholly in repeated strings; a minimizer of a single run repeats nothing.
A minimizer of more than ``HOT`` distinct runs is split: each window holds half of
the bytes around its minimizer on one side at least, so the side and those bytes are
a finer key, again and again until groups are small (at last the key is the window).

The distinct runs left in a shard are concatenated in corpus order and their suffix
array is built by induced sorting: suffixes are classified, the substrings between
leftmost-smaller (LMS) suffixes are named and sorted, by recursion where names
repeat, and the array is induced from them: bucket by bucket with numpy where
symbols are few, place by place where they are many. Common prefixes are permuted
to text order, where only irreducible ones are compared byte by byte. Suffixes that
share ``width`` bytes are neighbours; all but the first of such a group start a
repeated string.

Rows get ids of their own when they are first read, so keys may be null or repeat.
Texts are joined with ids of runs and of covers only; no join carries two of them.

Defined results: a null or empty text has no bytes; texts shorter than ``width``
stay whole; earlier is the lesser key, null first, then the row read first (a row
that repeats, or shares a key, is a document of its own), then the earlier start; an
empty table gives an empty result; other columns are ignored; a long text is
searched in pieces that overlap, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

WIDTH = 100
GRAM = 32
#: Bytes of distinct runs in a shard, about; what decides the number of shards.
SHARD_BYTES = 1 << 20
#: Distinct runs of a minimizer beyond which they are split by finer keys.
HOT = 2048
#: Symbols from which buckets are too small for a numpy call each.
FEW_SYMBOLS = 1024
#: Bits of a gram's place beside its hash, when the least one is sought; pieces are shorter.
_PLACE = 22
PIECE = T.SLICE_BYTES // 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the sorted suffixes of non-negative integers, by induced sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    used = np.bincount(text) > 0
    text = np.append(np.cumsum(used)[text], 0)  # symbols from 1, and a least last one
    return _induced(text, int(used.sum()) + 1)[1:]


def _induced(text: np.ndarray, symbols: int) -> np.ndarray:
    n = len(text)
    if symbols == n:
        out = np.empty(n, np.int64)
        out[text] = np.arange(n)
        return out
    # smaller (S) suffixes: the next different symbol is greater
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = text[change] < text[change + 1]
    small = np.zeros(n, bool)
    if len(change):
        following = np.searchsorted(change, np.arange(n - 1))
        inside = following < len(change)
        small[:-1][inside] = rising[following[inside]]
    small[-1] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    count = np.bincount(text, minlength=symbols)
    tail = np.cumsum(count)
    head = tail - count
    order = _induce(text, small, lms, head, tail)
    sorted_lms = order[_is(lms, n)[order]]
    names, distinct = _names(text, small, lms, sorted_lms)
    if distinct < len(lms):
        reduced = names[lms]
        sorted_lms = lms[_induced(reduced, distinct)]
    return _induce(text, small, sorted_lms, head, tail)


def _is(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def _names(text: np.ndarray, small: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings (by place) in their sorted order; equal ones share a name."""
    end = np.full(len(text), len(text) - 1, np.int64)
    end[lms[:-1]] = lms[1:]
    length = end[order] - order + 1
    same = length[1:] == length[:-1]
    at = np.flatnonzero(same)
    step = 0
    live = at
    while len(live):
        a, b = order[live] + step, order[live + 1] + step
        inside = a <= end[order[live]]
        differ = inside & ((text[np.minimum(a, len(text) - 1)] != text[np.minimum(b, len(text) - 1)]))
        same[live[differ]] = False
        live = live[inside & ~differ]
        step += 1
    same[order[1:] == len(text) - 1] = False
    same[order[:-1] == len(text) - 1] = False
    names = np.zeros(len(text), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names, int(names[order[-1]]) + 1


def _spread(text: np.ndarray, before: np.ndarray, put: np.ndarray, sa: np.ndarray, up: bool) -> None:
    """Puts places in their symbols' buckets in order, from the heads up or from the tails down."""
    symbol = text[before]
    order = np.argsort(symbol.astype(np.uint16), kind="stable")  # a radix sort
    before, symbol = before[order], symbol[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    size = np.diff(np.append(first, len(symbol)))
    own = symbol[first]
    within = np.arange(len(symbol)) - np.repeat(first, size)
    if up:
        sa[np.repeat(put[own], size) + within] = before
        put[own] += size
    else:
        sa[np.repeat(put[own], size) - 1 - within] = before
        put[own] -= size


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The array induced from LMS suffixes in the given order: larger ones upwards, then smaller ones downwards."""
    if len(head) > FEW_SYMBOLS:
        return _induce_each(text, small, lms, head, tail)
    n, sa = len(text), np.full(len(text), -1, np.int64)
    put = tail.copy()
    _spread(text, lms[::-1], put, sa, False)
    put = head.copy()
    for c in range(len(head)):  # buckets upwards; what a bucket gives itself is another round
        done, seeds = head[c], None
        while True:
            now = sa[done : put[c]] if seeds is None else seeds
            if seeds is None and done == put[c]:
                seeds = sa[put[c] : tail[c]]
                seeds = seeds[seeds >= 0]
                now = seeds
                last = True
            else:
                done, last = put[c], False
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(text, before, put, sa, True)
            if last:
                break
    low = put
    put = tail.copy()
    for c in range(len(head) - 1, -1, -1):
        sa[low[c] : tail[c]] = -1  # smaller suffixes come anew
    sa[0] = n - 1
    for c in range(len(head) - 1, -1, -1):
        done = tail[c]
        while True:
            last = done == put[c]
            now = (sa[head[c] : low[c]] if last else sa[put[c] : done])[::-1]
            if not last:
                done = put[c]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _spread(text, before, put, sa, False)
            if last and done == put[c]:
                break
    sa[0] = n - 1
    return sa


def _induce_each(text: np.ndarray, small: np.ndarray, lms: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """``_induce`` place by place, for many symbols."""
    n = len(text)
    own, put = text.tolist(), tail.tolist()
    array = np.full(n, -1, np.int64)
    for i in lms[::-1].tolist():
        put[own[i]] -= 1
        array[put[own[i]]] = i
    sa = array.tolist()
    before = text[:-1]  # the symbol before each place, where it starts a larger suffix (then a smaller one); else -1, as for place -1
    symbol = np.concatenate([[-1], np.where(small[:-1], -1, before), [-1]]).tolist()
    put = head.tolist()
    for i in sa:  # the list grows to the right of where it is read
        if (c := symbol[i]) >= 0:
            sa[put[c]] = i - 1
            put[c] += 1
    array = np.array(sa, np.int64)
    array[small[array]] = -1  # smaller suffixes come anew
    array[0] = n - 1
    sa = array.tolist()
    symbol = np.concatenate([[-1], np.where(small[:-1], before, -1), [-1]]).tolist()
    put = tail.tolist()
    for i in reversed(sa):
        if (c := symbol[i]) >= 0:
            put[c] -= 1
            sa[put[c]] = i - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: of each suffix with the one before it in the array, up to ``most`` where they are irreducible."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    whole = np.ones(n, bool)  # irreducible
    whole[1:] = (phi[1:] <= 0) | (text[:-1] != text[np.maximum(phi[1:] - 1, 0)])
    start = np.flatnonzero(whole)
    length = np.zeros(len(start), np.int64)
    live = np.flatnonzero(phi[start] >= 0)
    step = 0
    padded = np.append(text.astype(np.int64), -1)
    # a run of reducible suffixes needs its start's prefix to be as much longer as the run
    need = most + np.diff(np.append(start, n))
    while len(live):
        a, b = start[live] + step, phi[start[live]] + step
        equal = (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        length[live[~equal]] = step
        live = live[equal]
        step += 1
        over = need[live] <= step
        length[live[over]] = step
        live = live[~over]
    at = np.searchsorted(start, place, side="right") - 1
    return np.maximum(length[at] - (place - start[at]), 0)


def repeats(strings: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each string, in order: True at the starts of ``width``-byte strings that start earlier, there or in a string before."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.zeros(int(sizes.sum()) + len(strings), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    for i, (s, at) in enumerate(zip(strings, starts, strict=True)):
        text[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 1  # 0 ends each string
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, width)
    ends = np.repeat(starts + sizes, sizes + 1)
    room = ends - np.arange(len(text)) >= width  # the string holds the window
    joined = (lcp[sa] >= width) & room[sa]
    joined[1:] &= room[sa[:-1]]
    joined[:1] = False
    group = np.cumsum(~joined)
    least = np.full(group[-1] + 1 if len(group) else 1, len(text), np.int64)
    np.minimum.at(least, group, sa)
    again = np.zeros(len(text), bool)
    again[sa] = least[group] < sa
    again &= room
    return [again[a : a + n] for a, n in zip(starts, sizes, strict=True)]


def runs(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, minimizer, content hash, whether the minimizer comes twice, its place) of each run."""
    empty = np.zeros(0, np.int64)
    n, w = len(data), width - gram + 1
    if n < width:
        return empty, empty, empty, empty.astype(T.U64), empty.astype(T.U64), empty.astype(bool), empty
    span = T.SpanHash(data)
    grams = span.grams(gram)
    low = T.U64((1 << _PLACE) - 1)
    least, size = (grams & ~low) | np.arange(len(grams), dtype=T.U64), 1  # of equal ones the leftmost
    while size * 2 <= w:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[: len(grams) - w + 1], least[w - size : len(grams) - size + 1])
    place = (least & low).astype(np.int64)
    minimizer = grams[place]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    fits = np.arange(len(least)) + width <= offsets[row + 1]
    first = fits.copy()
    first[1:] &= (minimizer[1:] != minimizer[:-1]) | ~fits[:-1] | (row[1:] != row[:-1])
    begin, count = np.flatnonzero(first), np.cumsum(fits)
    windows = np.diff(np.append(count[begin] - 1, count[-1])) if len(begin) else empty
    twice = place[begin] != place[begin + windows - 1]
    return row[begin], begin - offsets[row[begin]], windows, minimizer[begin], span(begin, begin + windows + width - 1), twice, place[begin] - begin


def _pieces(column: pa.Array, width: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, start in a row, bytes, offsets): slices, long texts in pieces that share ``width - 1`` bytes."""
    for i, j, data, offsets in T.slices(column, PIECE):
        if len(data) <= PIECE:
            yield i, j, 0, data, offsets
        else:
            for at in range(0, len(data) - width + 1, PIECE):
                piece = data[at : at + PIECE + width - 1]
                yield i, j, at, piece, np.array([0, len(piece)])


def halves(string: bytes, n: int, at: int, size: int, twice: bool, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first window, windows, place of the larger key in the first, what tells the key) of the parts of a run of ``n`` windows.

    All windows hold the ``size`` bytes at ``at``, and one half of the other bytes
    on one side of them at least; the left side is taken where it does.
    """
    key = string[at : at + size]
    found = [at]
    while twice and (at := string.find(key, at + 1)) >= 0:
        found.append(at)
    half, after = (width - size + 1) // 2, 0
    for o in found:  # the leftmost key of a window counts
        low, high = max(after, o + size - width, 0), min(o, n - 1)
        after = o + 1
        cut = min(high, o - half)
        if low <= cut:
            yield low, cut - low + 1, o - half - low, b"<" + string[o - half : o + size]
        low = max(low, o - half + 1)
        if low <= high:
            yield low, high - low + 1, o - low, b">" + string[o : o + size + half]


def _long(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class _Search:
    """The spans that repeated strings cover, of a table ``rows`` (rid, key, text)."""

    def __init__(self, rows: DataFrame, scratch: Scratch, width: int, gram: int, hot: int):
        self.rows, self.scratch, self.width, self.gram, self.hot = rows, scratch, width, gram, hot
        self.kind = dict(rows.dtypes)["key"]

    def _again(self, runs: DataFrame, firsts: DataFrame) -> DataFrame:
        """The spans of ``runs`` that are equal to an earlier one; ``firsts``: (g, content, first)."""
        met = runs.join(firsts.select("g", "content", "first").hint("shuffle_hash"), ["g", "content"])
        later = (F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start"))
        return met.where(later).select("rid", "start", (F.col("start") + F.col("n") + self.width - 1).alias("stop"))

    def found(self) -> DataFrame:
        """(rid, key, start, n, g, content, twice, at) of all runs whose minimizer ``g`` comes again."""
        width, gram = self.width, self.gram

        def scan(names: list[str]):
            def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i, _, base, data, offsets in _pieces(batch.column(2), width):
                        row, start, n, m, content, twice, at = runs(data, offsets, width, gram)
                        own = pa.array(row + i)
                        made = {"rid": lambda own=own: batch.column(0).take(own), "key": lambda own=own: batch.column(1).take(own), "start": lambda v=start + base: pa.array(v, pa.int64()), "n": lambda v=n: pa.array(v, pa.int32()), "g": lambda v=m: pa.array(v.view(np.int64)), "content": lambda v=content: pa.array(v.view(np.int64)), "twice": lambda v=twice: pa.array(v), "at": lambda v=at: pa.array(v, pa.int32())}
                        yield pa.RecordBatch.from_arrays([made[c]() for c in names], names)

            return find

        # texts are scanned twice, as that is cheaper than to keep every run
        seen = self.rows.mapInArrow(scan(["g", "twice"]), "g long, twice boolean")
        shared = self.scratch.save(seen.groupBy("g").agg(F.count("*").alias("many"), F.max("twice").alias("twice")).where("many > 1 or twice").select("g"), "shared")
        columns = ["rid", "key", "start", "n", "g", "content", "twice", "at"]
        made = self.rows.mapInArrow(scan(columns), f"rid long, key {self.kind}, start long, n int, g long, content long, twice boolean, at int")
        met = self.scratch.save(made.join(shared.hint("shuffle_hash"), "g"), "met")  # one plan at every size; g is unique and evenly dealt
        self.scratch.drop("shared")
        return met

    def strings(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (rid, start, n, g, twice, at) with the bytes of its runs and the documents' keys."""
        width = self.width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column(2).cast(pa.binary())
                lists = batch.column(3)
                flat = lists.flatten()
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                held, data, out = -1, b"", []
                for r, a, k in zip(owner.tolist(), start.tolist(), n.tolist(), strict=True):
                    if r != held:
                        held, data = r, raw[r].as_py()
                    out.append(data[a : a + k + width - 1])
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(flat.field(c) for c in ("start", "n", "g", "twice", "at")), pa.array(out, pa.binary())], ["rid", "key", "start", "n", "g", "twice", "at", "string"])

        lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "g", "twice", "at")).alias("wanted"))
        return self.rows.join(lists.hint("merge"), "rid").select("rid", "key", "text", "wanted").mapInArrow(cut, f"rid long, key {self.kind}, start long, n int, g long, twice boolean, at int, string binary")

    def split(self, hot: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """Strings by finer keys, in groups of bounded size, and the spans that fell out as equal to earlier ones."""
        width, size, level, ready, again = self.width, self.gram, 0, [], []
        hot = self.scratch.save(hot, "hot-0")
        while size < width and not hot.isEmpty():

            def finer(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    rows, out = [], []
                    get = batch.to_pydict()
                    for r, (start, n, twice, at, string) in enumerate(zip(*(get[c] for c in ("start", "n", "twice", "at", "string")), strict=True)):
                        for low, count, place, told in halves(string, n, at, size, twice, width):
                            part = string[low : low + count + width - 1]
                            rows.append(r)
                            out.append((start + low, count, _long(told), _long(part), False, place, part))
                    own, cols = pa.array(rows, pa.int64()), list(zip(*out, strict=True)) or [()] * 7
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["rid", "key", "start", "n", "g", "content", "twice", "at", "string"])

            level, half = level + 1, (width - size + 1) // 2
            parts = self.scratch.save(hot.mapInArrow(finer, f"rid long, key {self.kind}, start long, n int, g long, content long, twice boolean, at int, string binary"), f"parts-{level}")
            self.scratch.drop(f"hot-{level - 1}")
            firsts = self.scratch.save(parts.groupBy("g", "content").agg(F.min(F.struct("key", "rid", "start")).alias("first")), f"firsts-{level}")
            again.append(self.scratch.save(self._again(parts, firsts), f"again-{level}"))
            many = firsts.groupBy("g").agg(F.count("*").alias("many")).where("many > 1")
            left = firsts.join(many.hint("shuffle_hash"), "g").select("g", "content", F.col("first.rid").alias("rid"), F.col("first.start").alias("start"), "many")
            left = self.scratch.save(parts.join(left.hint("merge"), ["g", "content", "rid", "start"]), f"left-{level}")
            self.scratch.drop(f"parts-{level}", f"firsts-{level}")
            columns = ["rid", "key", "start", "n", "g", "twice", "at", "string"]
            ready.append(left.where(F.col("many") <= self.hot).select(columns))
            hot = self.scratch.save(left.where(F.col("many") > self.hot).select(columns), f"hot-{level}")
            size += half
        return ready, again

    def covers(self) -> DataFrame:
        """(rid, start, stop), saved."""
        met = self.found()
        firsts = met.groupBy("g", "content").agg(F.min(F.struct("key", "rid", "start")).alias("first"), F.max("n").alias("n"), F.max("twice").alias("twice"), F.max("at").alias("at"))
        firsts = self.scratch.save(firsts, "firsts")
        covers = [self._again(met, firsts)]
        many = firsts.groupBy("g").agg(F.count("*").alias("many"), F.max("twice").alias("again")).where("many > 1 or again").select("g", "many")
        left = firsts.join(many.hint("shuffle_hash"), "g").select(F.col("first.rid").alias("rid"), F.col("first.start").alias("start"), "n", "g", "twice", "at", "many")
        left = self.scratch.save(left, "left")
        total, most = left.agg(F.sum(F.col("n") + self.width - 1), F.max("many")).first()
        number = max(1, -(-int(total or 0) // SHARD_BYTES))
        strings = self.strings(left.where(F.col("many") <= self.hot))
        if (most or 0) > self.hot:
            ready, again = self.split(self.strings(left.where(F.col("many") > self.hot)))
            covers += again
            for part in ready:
                strings = strings.union(part)
        width = self.width

        def search(table: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending"), ("rid", "ascending"), ("start", "ascending")], null_placement="at_start"))
            rows, low, high = [], [], []
            for r, again in enumerate(repeats([s.as_py() for s in table.column("string")], width)):
                begin, end, _ = T.spans(again, np.array([0, len(again)]))
                base = table.column("start")[r].as_py()
                rows += [r] * len(begin)
                low += [base + int(b) for b in begin]
                high += [base + int(e) + width - 1 for e in end]
            return pa.table({"rid": table.column("rid").take(pa.array(rows, pa.int64())), "start": pa.array(low, pa.int64()), "stop": pa.array(high, pa.int64())})

        shards = strings.select(F.pmod("g", F.lit(number)).alias("shard"), "rid", "key", "start", "string")
        covers.append(shards.groupBy("shard").applyInArrow(search, "rid long, start long, stop long"))
        done = covers[0]
        for more in covers[1:]:
            done = done.union(more)
        done = self.scratch.save(done, "covers")
        self.scratch.drop("met", "firsts", "left")
        return done


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, n_spans) of each document."""
    scratch = Scratch(docs.sparkSession, "suffix")
    kind = dict(docs.select(key).dtypes)[key]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = scratch.save(rows, "rows")  # ids stay what they are from here on
    covers = _Search(rows, scratch, width, gram, hot).covers().groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("covers"))
    joined = rows.join(covers.hint("merge"), "rid", "left").select("key", "text", "covers")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, spans = [], [], [], []
            raw = batch.column(1).cast(pa.binary())
            for r in range(batch.num_rows):
                data = np.frombuffer(raw[r].as_buffer(), np.uint8)
                sizes.append(len(data))
                if not (spots := batch.column(2)[r]).is_valid:
                    kept.append(data.tobytes())
                    gone.append(0)
                    spans.append(0)
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, spots.values.field("start").to_numpy(), 1)
                np.add.at(edge, spots.values.field("stop").to_numpy(), -1)
                cut = np.cumsum(edge[:-1]) > 0
                kept.append(data[~cut].tobytes())
                gone.append(int(cut.sum()))
                spans.append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(v, pa.int64()) for v in (sizes, gone, spans))], [key, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(keep, f"`{key}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256)."""
    return deduplicated(docs, text, key, **options).select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
