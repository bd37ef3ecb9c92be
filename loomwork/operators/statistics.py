"""Statistics that pipelines fit and profiles report, each from one pre-aggregated pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distributions, matrices
from .distributions import value_histogram  # noqa: F401


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with each column's exact median, 0 where nothing is known."""
    found = distributions.medians(distributions.counted(df, columns))
    return found.agg(*(F.coalesce(F.max(F.when(F.col("column") == c, F.col("median"))), F.lit(0.0)).alias(c) for c in columns))


def modes(histogram: DataFrame) -> DataFrame:
    """(column, mode, n): the most frequent value, of several the least."""
    known = histogram.where("value is not null").groupBy("column", "value").agg(F.sum("n").alias("n"))
    return known.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("mode"), F.max("n").alias("n"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std): population deviations, 1 where there is none."""
    row = df.agg(*(F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns))
    out = row.select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    return out.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def missing_rate_difference(df: DataFrame, columns: Sequence[str], positive: Column, min_rows: int = 500) -> DataFrame:
    """(column, difference): share of positives where missing less that where answered; 0 with few rows on a side."""
    y = positive.cast("double")
    def one(c: str) -> Column:
        gone, there = F.count_if(F.col(c).isNull()), F.count_if(F.col(c).isNotNull())
        diff = F.avg(F.when(F.col(c).isNull(), y)) - F.avg(F.when(F.col(c).isNotNull(), y))
        return F.struct(F.lit(c).alias("column"), F.when((gone >= max(min_rows, 1)) & (there >= max(min_rows, 1)), diff).otherwise(0.0).alias("difference")).alias(c)
    return df.agg(*map(one, columns)).select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def one_hot_categories(histogram: DataFrame, min_rows: int) -> DataFrame:
    """(column, value): frequent values but the most frequent, which is the reference."""
    counts = histogram.where("value is not null").groupBy("column", "value").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(order)).where("r > 1").select("column", "value")


def information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (entropy_a, entropy_b, mutual_information) in bits; NULL is a value."""
    joint = df.groupBy(a, b).agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("t"))
    def bits(counts: DataFrame, name: str) -> DataFrame:
        p = F.col("n") / F.col("t")
        return counts.join(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias(name))
    parts = [bits(joint.groupBy(c).agg(F.sum("n").alias("n")), f"entropy_{x}") for c, x in ((a, "a"), (b, "b"))]
    row = parts[0].join(F.broadcast(parts[1])).join(F.broadcast(bits(joint, "joint")))  # one row each
    return row.select("entropy_a", "entropy_b", (F.col("entropy_a") + F.col("entropy_b") - F.col("joint")).alias("mutual_information"))


def variation_distance(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """One row: half the summed differences of the shares of each value, NULL included."""
    share = lambda df, name: df.groupBy(column).agg(F.count("*").alias("n")).select(F.col(column).alias(f"v_{name}"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    a, b = share(one, "a"), share(two, "b")
    both = a.join(b, F.col("v_a").eqNullSafe(F.col("v_b")), "full")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).alias("distance"))


def prevalence(df: DataFrame, by: Sequence[str], positive: Column, min_rows: int = 1) -> DataFrame:
    """(by, n, rate) of each group of at least ``min_rows`` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(positive.cast("double")).alias("rate")).where(F.col("n") >= min_rows)


def prevalence_scores(train: DataFrame, rows: DataFrame, by: Sequence[str], positive: Column) -> DataFrame:
    """``rows`` with score: the training prevalence of their group, overall where the group is new."""
    known = prevalence(train, by, positive).select(*(F.col(c).alias(f"k_{c}") for c in by), "rate")
    overall = train.agg(F.avg(positive.cast("double")).alias("overall"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    found = rows.join(known, match, "left").join(F.broadcast(overall))  # one row
    return found.select(*rows.columns, F.coalesce("rate", "overall").alias("score"))


def quantiles(df: DataFrame, column: str, levels: Sequence[float], pieces: int = 64) -> list[float]:
    """Exact quantiles of what is known, between values in proportion; none for an empty column.

    Values are counted first; ranks are sought in value ranges of about as many rows,
    so no task orders more than its range of distinct values.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / pieces for i in range(1, pieces)], 1000)).first()[0]
    if not cuts:
        return []
    piece = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("v")))
    values = values.withColumn("piece", piece)
    rows = dict(values.groupBy("piece").agg(F.sum("n")).collect())  # at most ``pieces`` rows
    base, total = {}, 0
    for k in sorted(rows):
        base[k], total = total, total + rows[k]
    at = [q * (total - 1) for q in levels]
    ranks = sorted({int(r) for r in at} | {min(int(r) + 1, total - 1) for r in at})
    upto = F.sum("n").over(Window.partitionBy("piece").orderBy("v"))
    before = F.element_at(F.create_map(*(F.lit(x).cast(t) for k in base for x, t in ((k, "int"), (base[k], "long")))), F.col("piece"))
    ranked = values.withColumn("upto", before + upto).withColumn("from", F.col("upto") - F.col("n"))
    wanted = F.filter(F.array(*(F.lit(r).cast("long") for r in ranks)), lambda r: (r >= F.col("from")) & (r < F.col("upto")))
    found = {r: v for v, r in ranked.select("v", F.explode(wanted).alias("r")).collect()}  # a row for each rank
    return [found[int(r)] + (r - int(r)) * (found[min(int(r) + 1, total - 1)] - found[int(r)]) for r in at]


def prevalence_by_group(df: DataFrame, column: str, positive: Column, bins: int = 10, min_rows: int = 30, most_values: int = 60) -> DataFrame:
    """(low, high, n, rate): by value, or by quantile range where there are more than ``most_values``; NULL is a group of its own.

    A range holds its lower edge; the last one its upper edge too. Edges that are equal make one.
    """
    if df.select(column).where(F.col(column).isNotNull()).distinct().limit(most_values + 1).count() <= most_values:
        low = high = F.col(column).cast("double")
    else:
        edges = sorted(set(quantiles(df, column, [i / bins for i in range(bins + 1)])))
        array, last = F.array(*map(F.lit, edges)), len(edges) - 2
        bin_ = F.greatest(F.lit(0), F.least(F.lit(last), F.size(F.filter(array, lambda e: e <= F.col(column))) - 1))
        low, high = (F.when(F.col(column).isNotNull(), F.get(array, bin_ + k)) for k in (0, 1))
    grouped = df.select(low.alias("low"), high.alias("high"), positive.alias("y"))
    return prevalence(grouped, ["low", "high"], F.col("y"), min_rows)


def adjusted_prevalence(df: DataFrame, by: str, stratum: str, positive: Column) -> DataFrame:
    """(by, n, rate, adjusted): prevalence as if every group had the whole table's strata, of those it has."""
    cells = df.groupBy(by, stratum).agg(F.count("*").alias("n"), F.sum(positive.cast("double")).alias("p"))
    weights = df.groupBy(stratum).agg(F.count("*").alias("w")).withColumnRenamed(stratum, "known")
    cells = cells.join(weights, F.col(stratum).eqNullSafe(F.col("known")))
    return cells.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("p") / F.sum("n")).alias("rate"), (F.sum(F.col("w") * F.col("p") / F.col("n")) / F.sum("w")).alias("adjusted"))


def missing_classes(df: DataFrame, columns: Sequence[str], bounds: Sequence[float] = (0.0, 0.01, 0.1, 0.5, 0.9)) -> DataFrame:
    """(class, columns): how many columns miss a share of their values up to each of ``bounds``, the last class above all."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    long = shares.select(F.explode(F.array(*columns)).alias("share"))
    kind = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("share")))
    return long.groupBy(kind.alias("class")).agg(F.count("*").alias("columns"))


def one_per_group(df: DataFrame, columns: Sequence[str], most: float = 0.9) -> list[str]:
    """Of ``columns``, the most important first, those whose missing rows do not correlate by more than ``most`` with those of one kept before.

    One scan counts, for each pair, the rows that miss both; columns that miss all or no rows are kept.
    """
    near = np.abs(matrices.mask_correlation(*matrices.co_missing(df, columns))) > most
    kept: list[int] = []
    for i in range(len(columns)):
        if not near[i, kept].any():
            kept.append(i)
    return [columns[i] for i in kept]


def shared_keys(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """One row (shared): how many keys come in both tables."""
    return one.select(key).intersect(two.select(key)).agg(F.count("*").alias("shared"))


def discretized(df: DataFrame, column: str, bins: int = 10, most_values: int = 60) -> DataFrame:
    """``df`` with code: the place of the value among the values, or its quantile range where there are more than ``most_values``; NULL stays."""
    known = df.select(F.col(column).cast("double").alias("v")).where("v is not null").distinct().limit(most_values + 1).collect()
    if len(known) <= most_values:
        starts, last = sorted(r.v for r in known), len(known) - 1
    else:
        starts = sorted(set(quantiles(df, column, [i / bins for i in range(bins + 1)])))
        last = max(len(starts) - 2, 0)
    below = F.size(F.filter(F.array(*map(F.lit, starts)).cast("array<double>"), lambda e: e <= F.col(column))) - 1
    return df.withColumn("code", F.when(F.col(column).isNotNull(), F.least(below, F.lit(last))))


def value_ranges(df: DataFrame, column: str, low: float, high: float, levels: Sequence[float] = (0.0, 0.005, 0.5, 0.99, 0.995, 1.0)) -> DataFrame:
    """One row: n known values, quantiles as an array, population skewness, and how many values lie outside ``low`` to ``high``."""
    found = F.array(*map(F.lit, quantiles(df, column, levels))).cast("array<double>")
    v = F.col(column).cast("double")
    return df.agg(F.count(v).alias("n"), F.skewness(v).alias("skewness"), F.count_if(~v.between(low, high)).alias("outside")).withColumn("quantiles", found)
