"""What roots and logarithms of columns tell of a label beyond powers of the columns, all columns from one scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matrices

#: Share of a curve's variance that powers must leave for a partial correlation.
LEFT = 1e-9


def _correlations(sums: np.ndarray) -> np.ndarray:
    """Correlations from sums of products whose first column is 1; 0 where one is constant."""
    n = max(sums[0, 0], 1.0)
    mean = sums[0] / n
    cover = (sums / n - np.outer(mean, mean))[1:, 1:]
    spread = np.sqrt(np.maximum(np.diag(cover), 0))
    spread[spread <= 1e-9 * np.maximum(np.abs(mean[1:]), 1e-3)] = 0.0
    both = np.outer(spread, spread)
    return np.divide(cover, both, out=np.zeros_like(cover), where=both > 0)


def gains(df: DataFrame, columns: Sequence[str], label: Column, degree: int = 1) -> DataFrame:
    """(column, n, r, r_sqrt, r_log1p, partial_sqrt, partial_log1p, noise) of each column against ``label``.

    The curves are taken of a value's distance to the column's least. A partial correlation is
    given the powers up to ``degree``; it is 0 where they leave nothing of the curve or of the label.
    One scan gives the columns' least, mean and spread, another one sums of products a column: small
    matrices, added up on the executors. Rows without the column's value or the label don't count
    for it; ``noise`` is 2 / sqrt(n), null without rows, as are the correlations then.
    """
    if degree < 1:
        raise ValueError("degree must be 1 or more")
    data = df.select(label.cast("double").alias("y"), *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns))).where("y is not null")
    row = data.agg(*(f(f"c{i}") for i in range(len(columns)) for f in (F.min, F.avg, F.stddev_pop))).first() if columns else ()
    about = [row[3 * i : 3 * i + 3] for i in range(len(columns))]
    width = degree + 4  # 1, the powers, two curves, the label

    def partial(values: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for x, (low, mean, spread) in zip(values[1:], about, strict=True):
            has = ~np.isnan(x.astype(float))
            x, y = x.astype(float)[has], values[0][has]
            z = (x - (mean or 0.0)) / (spread or 1.0)
            far = np.maximum(x - (low or 0.0), 0)
            m = np.column_stack([z**p for p in range(degree + 1)] + [np.sqrt(far), np.log1p(far), y])
            out.append((m.T @ m).ravel())
        return out

    found = {r["i"]: np.frombuffer(r["cells"], "<f8").reshape(width, width) for r in matrices.summed(data, partial, "<f8").collect()} if columns else {}
    rows = []
    for i, c in enumerate(columns):
        sums = found.get(i, np.zeros((width, width)))
        n = int(sums[0, 0])
        if not n:
            rows.append((c, 0, *[None] * 6))
            continue
        r = _correlations(sums)
        powers, last = slice(0, degree), width - 2
        base = np.linalg.pinv(r[powers, powers], rcond=1e-12, hermitian=True)
        left = r[degree:, degree:] - r[degree:, powers] @ base @ r[powers, degree:]
        own = np.diag(left)
        beyond = [float(left[k, -1] / math.sqrt(own[k] * own[-1])) if own[k] > LEFT and own[-1] > LEFT else 0.0 for k in (0, 1)]
        rows.append((c, n, float(r[0, last]), float(r[degree, last]), float(r[degree + 1, last]), *beyond, 2 / math.sqrt(n)))
    names = ("r", "r_sqrt", "r_log1p", "partial_sqrt", "partial_log1p", "noise")
    return df.sparkSession.createDataFrame(rows, "column string, n long, " + ", ".join(f"{c} double" for c in names))
