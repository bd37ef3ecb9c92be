"""Phrase collocations by suffix-sigma: counts of all short phrases from one sort of truncated suffixes.

Every word starts a suffix of at most ``MAX_N`` words of its piece. Suffixes are counted
within a slice, dealt by language and first word and sorted in reverse lexicographic
order, so that all suffixes with a common prefix follow each other; a stack of one open
prefix for each length then counts every prefix in one pass, whatever its group's size.
First words with more suffixes than a partition's share are dealt by the whole suffix
instead, and their partial counts are added up afterwards.

A suffix is a short binary key: two bytes for each of the 65,534 most frequent words of the
corpus (a table of 1 MB, whatever the input), ten for any other (a mark and a hash of
language and word). The table of words, made first, tells whether two words share a hash;
if so, all is hashed anew with another seed. Scores are exact decimals.

Defined results: a null or empty text has no words; a null language is ``und``, as a language
of that name is; words of a piece of one word only count as words; rows that repeat count
each; an empty table gives an empty result; equal scores are ordered by count and phrase;
texts are read whole, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

MAX_N = 3
MIN_COUNT = 10
TOP = 2000
#: A phrase goes where a longer candidate holds it in at least this part of its places.
INSIDE_PERCENT = 50
#: Words with a code of two bytes: bounds the broadcast table.
CODES = 65_534
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_MARK = T.U64(0xFFFF)
_HIGH = T.U64(1 << 63)


def _words(languages: pa.Array, data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """(start, end, row, number of the piece, hash with the language) of the words of a slice; ``data`` is lower case."""
    begin, end, first = T.spans(~_GAP[data], offsets)
    row = T.row_of(first)
    piece = np.cumsum(_BREAK[data])[begin] if len(begin) else begin
    names = [name.encode() for name in languages.to_pylist()]
    ends = np.cumsum([len(n) for n in names])
    tongue = T.span_hashes(np.frombuffer(b"".join(names), np.uint8), ends - [len(n) for n in names], ends)
    return begin, end, row, piece, T.mix(T.span_hashes(data, begin, end) + T.mix(tongue + T.U64(seed))[row]) | _HIGH


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """(hash, lang, word, f) of every word of every language; ``docs``: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(1)):
                languages, data = batch.column(0).slice(i, j - i), T.LOWER[data]
                begin, end, row, _, hashes = _words(languages, data, offsets, seed)
                some, at, count = np.unique(hashes, return_index=True, return_counts=True)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), languages.take(pa.array(row[at])), pa.array(words, pa.binary()).cast(pa.string()), pa.array(count)], ["hash", "lang", "word", "f"])

    return docs.mapInArrow(run, "hash long, lang string, word string, f long").groupBy("hash", "lang", "word").agg(F.sum("f").alias("f"))


def packed(words: np.ndarray) -> pa.Array:
    """Keys of phrases: ``words`` has a row for each place; 0 where a phrase has ended, codes under 2**16, hashes from 2**63."""
    short, long = (words > 0) & (words < _MARK), words >= _HIGH
    size = short * 2 + long * 10
    ends = np.cumsum(size.sum(0))
    place = ends - size.sum(0)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(len(words)):
        for test, value, at, n in ((short[k], words[k], 0, 2), (long[k], np.broadcast_to(_MARK, words[k].shape), 0, 2), (long[k], words[k], 2, 8)):
            to, value = place[test] + at, value[test]
            for b in range(n):
                out[to + b] = (value >> T.U64(8 * (n - 1 - b))).astype(np.uint8)
        place = place + size[k]
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(keys: pa.Array, n: int = MAX_N) -> np.ndarray:
    """The words that ``packed`` had, a row for each place."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    raw = keys.buffers()[2]
    data = np.concatenate([np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), np.zeros(16, np.uint8)])
    value = lambda at, n: sum(data[at + b].astype(T.U64) << T.U64(8 * (n - 1 - b)) for b in range(n))
    out, at, stop = np.zeros((n, len(keys)), T.U64), offsets[:-1].copy(), offsets[1:]
    for k in range(n):
        here = np.flatnonzero(at < stop)
        word = value(at[here], 2)
        far = word == _MARK
        word[far] = value(at[here[far]] + 2, 8)
        out[k, here] = word
        at[here] += np.where(far, 10, 2)
    return out


def suffixes(docs: DataFrame, hashes: np.ndarray, seed: int, n: int = MAX_N) -> DataFrame:
    """(key, f): the truncated suffixes of each slice; ``hashes``: of the words with codes, the most frequent first."""
    order = np.argsort(hashes)
    table = docs.sparkSession.sparkContext.broadcast((hashes[order], (order + 1).astype(T.U64)))  # CODES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = table.value
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(1), 2 * T.SLICE_BYTES):
                _, _, row, piece, ids = _words(batch.column(0).slice(i, j - i), T.LOWER[data], offsets, seed)
                if not len(ids):
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                    ids = np.where(known[at] == ids, codes[at], ids)
                words = np.zeros((n, len(ids)), T.U64)
                words[0] = ids
                for k in range(1, min(n, len(ids))):
                    own = (row[k:] == row[:-k]) & (piece[k:] == piece[:-k])
                    words[k, :-k] = np.where(own, ids[k:], T.U64(0))
                mixed = words[0]
                for k in range(1, n):
                    mixed = T.mix(mixed) + words[k]
                words = words[:, np.argsort(mixed)]
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (words[:, 1:] != words[:, :-1]).any(0)
                starts = np.flatnonzero(fresh)
                yield pa.RecordBatch.from_arrays([packed(words[:, starts]), pa.array(np.diff(np.append(starts, len(ids))))], ["key", "f"])

    return docs.mapInArrow(run, "key binary, f long")


class Stack:
    """The open prefix of each length with its count so far, over suffixes in reverse lexicographic order."""

    def __init__(self, n: int = MAX_N):
        self.n = n
        self.open: list[tuple[np.ndarray, int] | None] = [None] * n

    def push(self, words: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, count) of the prefixes that these suffixes close; the last of each length stays open."""
        for d in range(1, self.n + 1):
            rows = np.flatnonzero(words[d - 1])
            if not len(rows):
                continue
            own = words[:d, rows]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (own[:, 1:] != own[:, :-1]).any(0)
            starts = np.flatnonzero(fresh)
            total, found = np.add.reduceat(count[rows], starts), np.zeros((self.n, len(starts)), T.U64)
            found[:d] = own[:, starts]
            if (before := self.open[d - 1]) is not None:
                if (before[0] == found[:, 0]).all():
                    total[0] += before[1]
                else:
                    found, total = np.column_stack([before[0], found]), np.concatenate([[before[1]], total])
            self.open[d - 1] = found[:, -1], int(total[-1])
            yield found[:, :-1], total[:-1]

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for last in filter(None, self.open):
            yield last[0][:, None], np.array([last[1]])


def _frequent(words: DataFrame) -> list[Row]:
    """(hash, f) of the most frequent words, at most ``CODES``: those above a count that a histogram of sixteenths of powers of two gives."""
    level = F.floor(F.log2("f") * 16)
    counts = {r["level"]: r["n"] for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 1024 rows at most
    least, total = 0, 0
    for at in sorted(counts, reverse=True):
        total += counts[at]
        if total > CODES:
            least = at + 1
            break
    found = words.where(level >= least).select("hash", "f").collect()
    return sorted(found, key=lambda r: (-r["f"], r["hash"]))


def _columns(n: int) -> list[str]:
    return [f"w{k}" for k in range(1, n + 1)]


def counted(parts: DataFrame, hot: list[int], least: int = MIN_COUNT, n: int = MAX_N) -> DataFrame:
    """(w1.., f) of every phrase with ``least`` occurrences or more; ``hot``: codes of first words that are dealt by whole suffixes."""
    names, codes = _columns(n), np.array(sorted(hot), T.U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(n)

        def rows(found: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            keep = (total >= least) | ((found[n - 1] == 0) & np.isin(found[0], codes))  # of split groups the counts are partial
            return pa.RecordBatch.from_arrays([*(pa.array(w[keep].view(np.int64)) for w in found), pa.array(total[keep], pa.int64())], [*names, "f"])

        for batch in batches:
            for closed in stack.push(unpacked(batch.column(0), n), batch.column(1).to_numpy()):
                yield rows(*closed)
        for closed in stack.close():
            yield rows(*closed)

    head = F.when(F.col("key").startswith(F.lit(b"\xff\xff")), F.substring("key", 1, 10)).otherwise(F.substring("key", 1, 2))
    where = head
    if hot:
        where = F.when(head.isin([int(h).to_bytes(2, "big") for h in hot]), F.col("key")).otherwise(head)
    dealt = parts.repartition(F.xxhash64(where)).sortWithinPartitions(F.desc("key"))
    found = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", f long")
    return found.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda c: c.cast("decimal(19,0)")
    top = (whole(a) * whole(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, whole(left) * whole(right))


def scored(grams: DataFrame) -> DataFrame:
    """(w1, w2, w3, a, l, r, score) of all phrases of two and three words, by the lowest cut; ``grams``: (w1, w2, w3, f)."""
    one = grams.where("w2 = 0").select("w1", "f")
    two = grams.where("w2 <> 0 and w3 = 0").select("w1", "w2", "f")
    single = lambda word, name: one.select(F.col("w1").alias(word), F.col("f").alias(name))
    pair = lambda first, second, name: two.select(F.col("w1").alias(first), F.col("w2").alias(second), F.col("f").alias(name))
    pairs = two.withColumnRenamed("f", "a").withColumn("w3", F.lit(0).cast("long")).join(single("w1", "l"), "w1").join(single("w2", "r"), "w2")
    pairs = pairs.select("w1", "w2", "w3", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    triples = grams.where("w3 <> 0").withColumnRenamed("f", "a").join(pair("w1", "w2", "l2"), ["w1", "w2"]).join(pair("w2", "w3", "r1"), ["w2", "w3"]).join(single("w1", "l1"), "w1").join(single("w3", "r2"), "w3")
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    triples = triples.withColumn("cut", F.least(*cuts)).select("w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "collocations")
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    seed = 0
    while True:
        words = scratch.save(vocabulary(docs, seed), f"words-{seed}")
        if words.groupBy("hash").count().where("count > 1").isEmpty():
            break
        scratch.drop(f"words-{seed}")
        seed += 1
    frequent = _frequent(words)
    share = (words.agg(F.sum("f")).first()[0] or 0) / max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = [k + 1 for k, r in enumerate(frequent) if r["f"] > share]  # no more than there are partitions
    hashes = np.array([r["hash"] for r in frequent], np.int64).view(T.U64)
    grams = scratch.save(counted(suffixes(docs, hashes, seed), hot, least), "grams")
    found = scratch.save(scored(grams), "scored")
    longer = found.where("w3 <> 0")
    holders = longer.select("w1", "w2", "a").union(longer.select("w2", "w3", "a").toDF("w1", "w2", "a")).groupBy("w1", "w2").agg(F.max("a").alias("held")).withColumn("w3", F.lit(0).cast("long"))
    kept = found.join(holders, ["w1", "w2", "w3"], "left").where(F.col("held").isNull() | (100 * F.col("held") < inside_percent * F.col("a"))).drop("held")
    codes = spark.createDataFrame([(r["hash"], k + 1) for k, r in enumerate(frequent)], "hash long, code long")
    named = words.join(F.broadcast(codes), "hash", "left").select(F.coalesce("code", "hash").alias("id"), "lang", "word")
    for k in range(1, MAX_N + 1):
        own = named.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), *(["lang"] if k == 1 else []))
        kept = kept.join(own, f"w{k}", "left")
    phrase = F.concat_ws(" ", "word1", "word2", "word3")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The contract's result for ``documents`` in DuckDB.
ORACLE_SQL = r"""
with pieces as materialized (
  select row_number() over () as doc, coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
spots as materialized (select lang, w, unnest(generate_series(1, len(w))) as i from worded where len(w) > 0),
grams as materialized (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*)::hugeint as f
  from spots, (values (1), (2), (3)) as sizes(k) where i + k - 1 <= len(w) group by all),
known as materialized (select lang || chr(10) || phrase as key, f from grams),
totals as (select lang, sum(f) as n from grams where k = 1 group by lang),
candidates as materialized (select lang, k, phrase, string_split(phrase, ' ') as w, f as a from grams where k > 1 and f >= 10),
halves as materialized (
  select c.lang, c.phrase, c.k, c.a, j.k as cut, c.lang || chr(10) || array_to_string(c.w[1 : j.k], ' ') as head, c.lang || chr(10) || array_to_string(c.w[j.k + 1 :], ' ') as tail
  from candidates c, (values (1), (2)) as j(k) where j.k < c.k),
cuts as materialized (
  select h.lang, h.phrase, h.k, h.a, h.cut, x.f as l, y.f as r, (1000000::hugeint * h.a * h.a) // (x.f * y.f) as score
  from halves h join known x on x.key = h.head join known y on y.key = h.tail),
best as materialized (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
holders as (
  select lang, phrase, max(a) as held from (
    select lang, array_to_string(w[1 : 2], ' ') as phrase, a from candidates where k = 3
    union all select lang, array_to_string(w[2 : 3], ' ') as phrase, a from candidates where k = 3) group by all),
kept as (select b.* from best b left join holders h using (lang, phrase) where h.held is null or 100 * h.held < 50 * b.a),
ranked as (select kept.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
