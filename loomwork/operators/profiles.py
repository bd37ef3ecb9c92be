"""Profiles of columns, mostly from the value histogram."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import information, prevalence


def column_profile(histogram: DataFrame) -> DataFrame:
    """(column, n, distinct, missing, top_value, top_share): NULL counts as a value for the top one and wins ties."""
    per = histogram.groupBy("column", "value").agg(F.sum("n").alias("n"))
    out = per.groupBy("column").agg(
        F.sum("n").alias("n"), F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("gone"),
        F.max_by("value", F.struct("n", F.col("value").isNull(), -F.col("value"))).alias("top_value"), F.max("n").alias("top"),
    )
    return out.select("column", "n", "distinct", (F.col("gone") / F.col("n")).alias("missing"), "top_value", (F.col("top") / F.col("n")).alias("top_share"))


def constancy(profile: DataFrame) -> DataFrame:
    """``profile`` with status."""
    d, m = F.col("distinct"), F.col("missing")
    status = F.when(d == 0, "all missing").when((d == 1) & (m == 0), "constant").when(d == 1, "one value").when(F.col("top_value").isNotNull() & (F.col("top_share") > 0.99), "near-constant").when(m > 0.5, "mostly missing").otherwise("varied")
    return profile.withColumn("status", status)


def leakage(df: DataFrame, columns: Sequence[str], positive: Column, least: float = 0.5, min_rows: int = 30) -> DataFrame:
    """(column, value, n, rate): values, NULL included, whose rows are positives at ``least`` as a share."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    long = df.select(positive.alias("y"), F.explode(pairs).alias("p")).select("y", "p.*")
    return prevalence(long, ["column", "value"], F.col("y"), min_rows).where(F.col("rate") >= least)


def determination(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (b_by_a, a_by_b): the share of one's entropy that the other explains, where both are known; 0 without entropy."""
    row = information(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    share = lambda h: F.coalesce(F.try_divide(F.col("mutual_information"), F.when(F.col(h) > 0, F.col(h))), F.lit(0.0))
    return row.select(share("entropy_b").alias("b_by_a"), share("entropy_a").alias("a_by_b"))


def best_rule_f1(df: DataFrame, by: str, positive: Column) -> DataFrame:
    """One row (f1): the best F1 of calling the groups with the largest shares of positives positive."""
    groups = df.groupBy(F.col(by).alias("g")).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    down = Window.orderBy(F.desc(F.col("p") / F.col("n")), "g").rowsBetween(Window.unboundedPreceding, 0)  # a row for each code
    sums = groups.select(F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("called"), F.sum("p").over(Window.partitionBy()).alias("all"))
    return sums.agg(F.coalesce(F.max(F.try_divide(2.0 * F.col("tp"), F.col("called") + F.col("all"))), F.lit(0.0)).alias("f1"))


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(r, rows) of each pair of columns over the rows that hold both, in one pass of masked sums; NaN where one is constant."""
    d = len(columns)
    centre = df.agg(*(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)) for c in columns)).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, 4 * d))
        for batch in batches:
            if len(batch):
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - np.array(centre, float)
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                total += np.hstack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), 4 * d)), pa.array(np.tile(np.arange(4 * d), d)), pa.array(total.ravel())], ["i", "j", "v"])

    sums = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((d, 4 * d))
    total[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["v"].to_numpy()
    n, s, q, xy = np.split(total, 4, axis=1)
    with np.errstate(all="ignore"):
        var = q / n - (s / n) ** 2
        r = (xy / n - s * s.T / (n * n)) / np.sqrt(var * var.T)
        r[(n < 2) | (var <= 1e-12 * (1 + q / np.maximum(n, 1))) | (var.T <= 1e-12 * (1 + q.T / np.maximum(n, 1)))] = np.nan
    return np.clip(r, -1, 1), n.astype(np.int64)
