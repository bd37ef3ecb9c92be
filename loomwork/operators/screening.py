"""Score tests of many groups of candidate columns from one scan."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from .linear import _design, _sum_rows

#: Directions of a group of which the model's columns leave no more than this share count as repeated ones.
REPEATED = 1e-9


def upper_tail(statistic: float, freedom: int) -> float:
    """P(chi square >= statistic) by Wilson and Hilferty's cube root."""
    if statistic <= 0:
        return 1.0
    scale = 2 / (9 * freedom)
    return 0.5 * math.erfc((np.cbrt(statistic / freedom) - (1 - scale)) / math.sqrt(2 * scale))


def screen(df: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], label: str, weights: np.ndarray, penalty: float = 0.0, top: int = 20, level: float = 0.05) -> DataFrame:
    """(group, columns, chi2, p, gain, passes, leading) of each group added to a fitted logistic model, labels 0 and 1.

    One scan sums the weighted products of all columns, model's and candidates'; a group's statistic
    needs only its own block, of which what the model's columns explain is taken away (Schur complement).
    Candidates count as standardized: that is a change of basis of the sums, as the model has a
    constant, so the moments take no scan of their own. ``gain``: about the fall of the mean loss;
    ``passes``: p below ``level`` shared by all groups (Bonferroni); ``leading``: whether a column
    correlates with the label more than the ``top``-th of the model's does.
    """
    extra = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    d, m = len(features) + 1, len(extra)
    place = {c: d + i for i, c in enumerate(extra)}

    def partial(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x[:, :d] @ weights, -700, 700)))
        return np.column_stack([x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p), x.sum(0), (x * x).sum(0), x.T @ y, np.full(d + m, y @ y)])

    sums = _sum_rows(_design(df, [*features, *extra], label), partial, d + m, d + m + 5)
    info, slope, first, second, with_y = sums[:, : d + m], sums[:, d + m], sums[:, d + m + 1], sums[:, d + m + 2], sums[:, d + m + 3]
    n = first[0]
    if not n:
        raise ValueError("no rows to screen on")
    mean = first / n
    spread = np.sqrt(np.maximum(second / n - mean**2, 0))
    flat = spread <= 1e-9 * np.maximum(np.abs(mean), 1)
    spread[flat] = 1.0
    y_mean = with_y[0] / n
    y_spread = math.sqrt(max(sums[0, -1] / n - y_mean**2, 0)) or 1.0
    related = np.where(flat, 0, np.abs(with_y / n - mean * y_mean) / (spread * y_spread))
    basis = np.eye(d + m)  # row i: column i as a sum of raw ones
    basis[d:, 0] = -mean[d:] / spread[d:]
    basis[range(d, d + m), range(d, d + m)] = 1 / spread[d:]
    info, slope = basis @ info @ basis.T + 2 * penalty * n * np.eye(d + m), basis @ slope
    base = np.linalg.pinv(info[:d, :d], hermitian=True)
    leader = np.sort(related[1:d])[-top] if d > top else -1.0
    rows = []
    for name, columns in groups.items():
        at = [place[c] for c in columns]
        left = info[np.ix_(at, at)] - info[np.ix_(at, range(d))] @ base @ info[np.ix_(range(d), at)]
        size, axes = np.linalg.eigh(left)
        own = size > REPEATED * np.diag(info)[at].max()
        chi2 = float(((axes[:, own].T @ slope[at]) ** 2 / size[own]).sum())
        p = upper_tail(chi2, len(at))
        rows.append((name, len(at), chi2, float(p), float(chi2 / (2 * n)), bool(p * len(groups) < level), bool(related[at].max() > leader)))
    return df.sparkSession.createDataFrame(rows, "group string, columns int, chi2 double, p double, gain double, passes boolean, leading boolean")
