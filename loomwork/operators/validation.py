"""Cross-validation, grids and the weighting of two models."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cuts, metrics, sampling

#: Trains on a frame and gives the score column of its model.
Fit = Callable[[DataFrame], Column]


def param_grid(**values: Iterable) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(values, v, strict=True)) for v in itertools.product(*map(list, values.values()))]


def cross_validate(df: DataFrame, label: str, key: str, fit: Fit, k: int = 5, seed: int = 1, default: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(fold, f1, f1_val_best, f1_default, threshold) of each fold, and (key, label, fold, score) of each row by a model that hasn't seen it.

    The threshold comes from the scores of the rows trained on.
    """
    folds = sampling.stratified_folds(df, label, key, k, seed)
    positive, results, held = F.col(label) == 1, [], []
    for fold in range(k):
        train, rest = folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)
        score = fit(train)
        cut = metrics.best_threshold(train.withColumn("score", score), "score", positive).first()
        scored = rest.select(key, label, "fold", score.alias("score"))
        found = metrics.best_threshold(scored, "score", positive).first()
        counts = scored.agg(*(f for at, n in ((cut.threshold if cut else default, "t"), (default, "d")) for f in (F.count_if(positive & (F.col("score") >= at)).alias(f"{n}p"), F.count_if(~positive & (F.col("score") >= at)).alias(f"{n}f"))), F.count_if(positive).alias("p")).first()
        f1 = lambda tp, fp, p: 2.0 * tp / (tp + fp + p) if tp else 0.0
        results.append((fold, f1(counts.tp, counts.tf, counts.p), float(found.fbeta) if found else 0.0, f1(counts.dp, counts.df, counts.p), float(cut.threshold) if cut else default))
        held.append(scored)
    out = held[0]
    for h in held[1:]:
        out = out.unionByName(h)
    return df.sparkSession.createDataFrame(results, "fold int, f1 double, f1_val_best double, f1_default double, threshold double"), out


def grid_search(df: DataFrame, label: str, key: str, grid: Sequence[dict], fit: Callable[..., Column], k: int = 5, seed: int = 1) -> list[dict]:
    """Each setting with the mean and population deviation of F1 over the folds, best first."""
    found = []
    for setting in grid:
        per, _ = cross_validate(df, label, key, lambda train, s=setting: fit(train, **s), k, seed)
        f1 = per.agg(F.avg("f1").alias("f1"), F.stddev_pop("f1").alias("std")).first()
        found.append({**setting, "f1": f1.f1, "std": f1.std})
    return sorted(found, key=lambda r: -r["f1"])


def grid_at_once(df: DataFrame, label: str, key: str, grid: Sequence[dict], fit: Callable[[DataFrame, int, Sequence[dict]], list[list[Column]]], k: int = 5, seed: int = 1, default: float = 0.5) -> list[dict]:
    """``grid_search`` with all folds and settings in the same scans; ``fit(folds, k, grid)`` gives the score column of each fold's model for each setting.

    Rows are not shuffled: folds start at hashes, and cuts on the rows trained on come from counts by range of scores.
    """
    folds = sampling.dealt_folds(df, label, key, k, seed)
    models = [(i, fold, score) for i, own in enumerate(fit(folds, k, grid)) for fold, score in enumerate(own)]
    positive = F.col(label) == 1
    seen = folds.select(positive.alias("y"), *(F.when(F.col("fold") != fold, score).alias(f"m{i}_{fold}") for i, fold, score in models))
    best = cuts.best_cuts(seen, seen.columns[1:], F.col("y"))
    at = [best.get((m, 0), (0.0, default))[1] for m in range(len(models))]
    new = folds.select(positive.alias("y"), "fold", *((score >= cut).alias(f"m{m}") for m, ((_, _, score), cut) in enumerate(zip(models, at, strict=True))))
    own = lambda m: (F.col("fold") == models[m][1])
    counts = new.agg(*(F.count_if(own(m) & c).alias(f"{n}{m}") for m in range(len(models)) for n, c in (("tp", F.col("y") & F.col(f"m{m}")), ("fp", ~F.col("y") & F.col(f"m{m}")), ("p", F.col("y"))))).first()
    f1 = [2.0 * counts[f"tp{m}"] / (counts[f"tp{m}"] + counts[f"fp{m}"] + counts[f"p{m}"]) if counts[f"tp{m}"] else 0.0 for m in range(len(models))]
    found = []
    for i, setting in enumerate(grid):
        own_f1 = [f1[m] for m, (j, _, _) in enumerate(models) if j == i]
        mean = sum(own_f1) / k
        found.append({**setting, "f1": mean, "std": math.sqrt(sum((v - mean) ** 2 for v in own_f1) / k)})
    return sorted(found, key=lambda r: -r["f1"])


def blend(df: DataFrame, a: str, b: str, label: str, steps: int = 20) -> tuple[float, float, float]:
    """(weight of ``a``, threshold, F1) with the largest F1; the first weight of equals."""
    best = (0.0, 0.5, -1.0)
    for i in range(steps + 1):
        w = i / steps
        row = metrics.best_threshold(df.withColumn("__s", w * F.col(a) + (1 - w) * F.col(b)), "__s", F.col(label) == 1).first()
        if row and row.fbeta > best[2]:
            best = (w, float(row.threshold), float(row.fbeta))
    return best


def best_rows(results: DataFrame, by: str, score: str) -> DataFrame:
    """The row of the greatest finite ``score`` of each group; of equal ones the first by all columns."""
    finite = results.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    rest = [c for c in results.columns if c not in (by, score)]
    best = finite.groupBy(by).agg(F.min(F.struct((-F.col(score)).alias("low"), *rest)).alias("b"))
    return best.select(*((-F.col("b.low")).alias(c) if c == score else F.col(by) if c == by else F.col(f"b.{c}") for c in results.columns))


def paired(results: DataFrame, variant: str, fold: str, score: str, reference: str) -> DataFrame:
    """(variant, mean_difference, better): each variant against ``reference`` on the same folds."""
    own = results.where(F.col(variant) == reference).select(F.col(fold).alias("f"), F.col(score).alias("r"))
    both = results.where(F.col(variant) != reference).join(own, F.col(fold) == F.col("f"))
    difference = F.col(score) - F.col("r")
    return both.groupBy(variant).agg(F.avg(difference).alias("mean_difference"), F.count_if(difference > 0).alias("better"))
