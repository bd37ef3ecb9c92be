"""Mixing sources to target weights, with DataFrame operations only.

Each source's words lie on an axis, document after document, cut into blocks of a
fixed length, small sources into shorter ones. Targets follow the weights, filled
up like water under each source's cap. Each output shard draws the sources of its slots
multinomially, in proportion to the slots that targets ask for; each source's counts are
then scaled to those slots (by rounding their running sums over the shards), so that
sources come near their targets. A source's slots run
through a keyed pseudorandom permutation of its block indexes (swap-or-not, a
bijection for any number of blocks), once for each pass, so no block comes back
before all others have been taken. Blocks join slots by index.

Positions on the axis come from sums by (source, bucket of rows), so no source,
however large, is ordered in one task. What is ordered as a whole has a row for each
source, or for each shard or bucket of a source: sources are few (up to some 100,000).

Defined results: a null or empty text has no words and is never taken; a null
source is a source of its own, the last one; rows that repeat, or share a key, are
documents of their own, null keys are keys like others; an empty table gives an empty
result; other columns are ignored (``mixed`` passes them on, whatever their names).
Reruns draw alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Words of a block.
BLOCK = 512
#: A source shorter than so many blocks is cut into about so many shorter ones.
LEAST_BLOCKS = 32
SHARD_SLOTS = 4096
ROUNDS = 12
#: Rows of a source that are ordered together, about.
BUCKET_ROWS = 1000
#: Slots that a task draws and permutes, about, and tasks at most.
TASK_SLOTS, TASKS = 16_384, 10_000
#: Cells of the table that finds a drawn source.
GUIDE = 1024
WORD = r"[^\x20\x09-\x0D]+"


def draw(*parts: Column | str) -> Column:
    """A number below 2**52 that looks random, from the parts' text."""
    text = F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def permuted(index: Column, n: Column, *key: Column | str) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0..n-1, the key's own."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(draw("key", *key, r) % n - x, n)
        high = F.greatest(x, other)
        return F.when(draw("bit", *key, r, high) % 2 == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def _numbered(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """(key, source, hash, copy, row) of each document; hash and copy tell rows that share a key apart."""
    named = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return named.withColumn("copy", F.row_number().over(Window.partitionBy("key", "source", "hash").orderBy("hash")))


def targets(sized: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, sid, source_size, target): the share of all words dealt by weight, each source under its cap."""
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    rows = sized.groupBy(source).agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1).cast("double"))
    most = cap * F.col("source_size")
    order = Window.orderBy(most / F.col("w"), "sid")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("most", most.cast("double")).withColumn("level", level)
    rows = rows.withColumn("level", F.max(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))).over(whole))
    return rows.select(source, "sid", "source_size", F.round(F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))), 6).alias("target"))


def _drawn(plan: DataFrame, shards: int, seed: str) -> DataFrame:
    """(shard, sid, count): each shard's SHARD_SLOTS slots, of sources drawn in proportion to their ``slots``."""
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    sums = plan.select("sid", F.sum("slots").over(upto).alias("upto"))
    table = sums.agg(F.sort_array(F.collect_list(F.struct("upto", "sid"))).alias("t")).select(F.lit(0).alias("one"), F.col("t.upto").alias("upto"), F.col("t.sid").alias("sids"), F.element_at("t.upto", -1).alias("all"))
    below = lambda v: lambda c: c <= v
    table = table.withColumn("guide", F.transform(F.sequence(F.lit(0), F.lit(GUIDE)), lambda g: F.size(F.filter("upto", below(F.floor(g * F.col("all") / GUIDE))))))
    tasks = min(TASKS, max(1, -(-shards * SHARD_SLOTS // TASK_SLOTS)))
    slots = plan.sparkSession.range(0, shards, 1, tasks).select(F.col("id").alias("shard")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SHARD_SLOTS - 1))))
    slots = slots.select("shard", F.lit(0).alias("one"), draw(seed, "source", F.col("shard"), F.col("slot")).alias("u")).join(F.broadcast(table), "one")  # a row
    v = F.floor(F.col("u") * (F.col("all") / F.lit(float(1 << 52)))).cast("long")
    slots = slots.withColumn("v", F.least(v, F.col("all") - 1)).withColumn("g", F.least(F.floor(F.col("v") * GUIDE / F.col("all")).cast("int"), F.lit(GUIDE - 1)))
    low, high = F.get("guide", F.col("g")), F.get("guide", F.col("g") + 1)
    at = low + F.size(F.filter(F.slice("upto", low + 1, high - low + 1), below(F.col("v"))))
    return slots.select("shard", F.get("sids", at).alias("sid")).groupBy("shard", "sid").agg(F.count("*").alias("count"))


def _slots(sources: DataFrame, block: int, total: float, seed: str) -> DataFrame:
    """(sid, index, uses): how often each block is taken.

    A source's slots are as many as bring its words nearest to its target, counted
    in passes of its own blocks, as the last one is partly empty.
    """
    shards = max(1, -(-int(total / block) // SHARD_SLOTS))
    plan = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    plan = plan.withColumn("slots", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long")).where("slots > 0").select("sid", "blocks", "slots")
    # every source has a row of no slots in shard 0, so that those that no shard drew get theirs there
    counts = _drawn(plan, shards, seed).unionByName(plan.select(F.lit(0).cast("long").alias("shard"), "sid", F.lit(0).cast("long").alias("count"))).groupBy("sid", "shard").agg(F.sum("count").alias("count"))
    whole, order = Window.partitionBy("sid"), Window.partitionBy("sid").orderBy("shard")
    counts = counts.withColumn("drawn", F.sum("count").over(whole)).withColumn("upto", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(plan), "sid")
    upto = F.when(F.col("drawn") == 0, F.col("slots")).otherwise(F.round(F.col("upto") / F.col("drawn") * F.col("slots")).cast("long"))
    counts = counts.withColumn("upto", upto).withColumn("from", F.coalesce(F.lag("upto").over(order), F.lit(0).cast("long"))).where(F.col("from") < F.col("upto"))
    tasks = min(TASKS, max(1, -(-shards * SHARD_SLOTS // TASK_SLOTS)))
    # a row of at most TASK_SLOTS slots, so that a source of many slots in a shard is spread, too
    cut = counts.withColumn("part", F.explode(F.sequence(F.col("from"), F.col("upto") - 1, F.lit(TASK_SLOTS // 16).cast("long"))))
    cut = cut.select("sid", "blocks", "part", F.least(F.col("upto"), F.col("part") + TASK_SLOTS // 16).alias("upto")).repartition(tasks, "sid", "part")
    slots = cut.withColumn("slot", F.explode(F.sequence(F.col("part"), F.col("upto") - 1)))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    return slots.withColumn("index", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), seed, F.col("sid"), turn)).groupBy("sid", "index").agg(F.count("*").alias("uses"))


def parts(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """(key, source, hash, copy, size, source_size, target, at, words, uses): each document's words by block (from word ``at``, ``words`` of them) and how often the mix takes them."""
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = counted.select("key", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    counted = counted.withColumn("copy", F.row_number().over(Window.partitionBy("key", "source", "hash").orderBy("hash")))
    sized = scratch.save(counted, "sized")
    rows, words = sized.agg(F.count("*"), F.sum("size")).first()
    length = F.least(F.lit(block).cast("long"), F.greatest(F.ceil(F.col("source_size") / LEAST_BLOCKS), F.lit(1).cast("long")))
    sources = scratch.save(targets(sized, "source", weights, share, cap).withColumn("length", length), "sources")
    uses = _slots(sources, block, share * (words or 0), seed)
    by_source = sources.withColumnRenamed("source", "name")
    sized = sized.join(by_source, sized["source"].eqNullSafe(by_source["name"])).drop("name")
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("key", "hash", "copy"), F.lit(max(1, -(-rows // BUCKET_ROWS)))))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sized.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(base, ["sid", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    cut = placed.withColumn("index", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1) / F.col("length")))))
    low, high = F.greatest(F.col("start"), F.col("index") * F.col("length")), F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * F.col("length"))
    cut = cut.withColumn("at", low - F.col("start")).withColumn("words", F.greatest(high - low, F.lit(0)))
    return cut.join(uses, ["sid", "index"], "left").select("key", "source", "hash", "copy", "size", "source_size", "target", "at", "words", F.coalesce("uses", F.lit(0)).alias("uses"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """(key, size, source_size, target, taken) of each document."""
    cut = parts(docs, text, key, source, **options)
    done = cut.groupBy("key", "source", "hash", "copy").agg(*(F.first(c).alias(c) for c in ("size", "source_size", "target")), F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return done.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: a row, with the columns of ``docs``, for each pass that takes words of a document.

    A pass that takes all words gives the text as it is, any other one the taken
    words in order, joined by spaces.
    """
    cut = parts(docs, text, key, source, **options).where("uses > 0 and words > 0")
    piece = F.struct(F.col("at"), F.col("words"), F.col("uses"))
    took = cut.groupBy("key", "source", "hash", "copy").agg(F.sort_array(F.collect_list(piece)).alias("parts"), F.first("size").alias("size"), F.max("uses").alias("most"))
    rows = _numbered(docs, text, key, source).alias("d").join(took.alias("t"), [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("key", "source", "hash", "copy")]).select("row", "parts", "size", "most")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    kept = F.filter("parts", lambda p: p["uses"] >= F.col("pass"))
    whole = F.aggregate(kept, F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")
    words = F.regexp_extract_all(F.col("row")[text], F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform(kept, lambda p: F.slice(words, (p["at"] + 1).cast("int"), p["words"].cast("int")))), " ")
    new = F.when(whole, F.col("row")[text]).otherwise(some)
    return rows.select(*((new if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
