"""Connected components of a link table, as joins and minima."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def ranked(votes: str, who: str) -> Column:
    """A long that orders by ``votes``, equal ones by a hash of ``who``."""
    return F.shiftleft(F.col(votes).cast("long"), 40).bitwiseOR(F.xxhash64(who).bitwiseAND(F.lit((1 << 40) - 1)))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the least id that links reach.

    Each round takes the least label of an id and its neighbours, then the label of that
    label, so that the rounds grow with the logarithm of the longest chain.
    """
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("x")).select("x.a", "x.b").distinct()
    both = scratch.save(both, f"{name}-links")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("label")), f"{name}-0")
    for step in count(1):
        at = labels.select(F.col("a").alias("b"), "label")
        met = both.join(at, "b").groupBy("a").agg(F.min("label").alias("low"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("label"))
        top = labels.select(F.col("a").alias("low"), F.col("label").alias("top"))
        after = met.join(top, "low").select("a", F.least("low", "top").alias("label"), (F.least("low", "top") < F.col("label")).alias("changed"))
        after = scratch.save(after, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = after.select("a", "label")
        if after.where("changed").isEmpty():
            break
    scratch.drop(f"{name}-links")
    return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))


def merged(part: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components (id, component) that ``links`` make of those in ``part``; only those that links join are labelled anew."""
    if part is None:
        return components(links, scratch, name)
    ends = links
    for c in ("a", "b"):
        ends = ends.join(part.select(F.col("id").alias(c), F.col("component").alias("own")), c, "left").withColumn(c, F.coalesce("own", c)).drop("own")
    new = components(ends.where("a <> b").distinct(), scratch, f"{name}-new").select(F.col("id").alias("old"), F.col("component").alias("new"))
    moved = part.join(new, part["component"] == new["old"], "left").select("id", F.coalesce("new", "component").alias("component"))
    fresh = new.join(part.select(F.col("id").alias("old")), "old", "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
    return scratch.save(moved.union(fresh), name)
