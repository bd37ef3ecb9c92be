"""Weighting two models: every weight and every left-out fold from the same counts by range of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cuts
from .metrics import fbeta


def weights_by_fold(df: DataFrame, a: str, b: str, positive: Column, fold: str, folds: int, weights: Sequence[float], ranges: int = cuts.RANGES) -> DataFrame:
    """(fold, weight, threshold, f1): the weight of ``a`` and the cut with the largest F1 on the rows of the other folds; fold -1 for all rows.

    Weights of equal F1: the first; cuts of equal F1: the highest. All weights and folds share the
    scans of ``cuts.best_cuts``. Rows without a score are left out.
    """
    names = [f"w{i}" for i in range(len(weights))]
    mixed = [(float(w) * F.col(a) + (1 - float(w)) * F.col(b)).alias(n) for n, w in zip(names, weights, strict=True)]
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(positive.alias("y"), F.col(fold).alias("fold"), *mixed)
    views = [[k for k in range(folds) if k != left] for left in range(-1, folds)]
    found = cuts.best_cuts(rows, names, F.col("y"), F.col("fold"), folds, views, together=True, ranges=ranges)
    best: dict[int, tuple[float, float, float]] = {}
    for (i, view), (f1, at) in found.items():
        best[view] = max(best.get(view, (-1.0, 0.0, 0.0)), (f1, -float(weights[i]), at))
    return df.sparkSession.createDataFrame([(view - 1, -w, at, f1) for view, (f1, w, at) in sorted(best.items())], "fold int, weight double, threshold double, f1 double")


def honest(df: DataFrame, a: str, b: str, positive: Column, known: Column, fold: str, folds: int, weights: Sequence[float]) -> DataFrame:
    """(fold, weight, threshold, f1, f1_rule): F1 on each fold with the weight and the cut chosen on the others; ``f1_rule`` where rows that are ``known`` to be positive count as predicted."""
    chosen = weights_by_fold(df, a, b, positive, fold, folds, weights).where("fold >= 0").select(F.col("fold").alias("own"), "weight", "threshold")
    w = F.col("weight")
    rows = df.withColumns({"__y": positive, "__known": F.coalesce(known, F.lit(False))}).join(F.broadcast(chosen), F.col(fold) == F.col("own"))  # a row for each fold
    hit = F.coalesce(w * F.col(a) + (1 - w) * F.col(b) >= F.col("threshold"), F.lit(False))
    either = hit | F.col("__known")
    y = F.col("__y")
    counts = [F.count_if(c).alias(n) for n, c in (("tp", hit & y), ("fp", hit & ~y), ("fn", ~hit & y), ("rtp", either & y), ("rfp", either & ~y), ("rfn", ~either & y))]
    done = rows.groupBy("own", "weight", "threshold").agg(*counts)
    f1 = lambda *names: fbeta(*map(F.col, names))
    return done.select(F.col("own").alias("fold"), "weight", "threshold", f1("tp", "fp", "fn").alias("f1"), f1("rtp", "rfp", "rfn").alias("f1_rule"))
