"""Linear and logistic trainers: sums on the executors, small algebra on the driver."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sum_rows(df: DataFrame, partial, rows: int, width: int) -> np.ndarray:
    """Sums over partitions of a small matrix that ``partial(x, y)`` gives for each batch, a row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
                if any(np.isnan(c).any() for c in columns):
                    raise ValueError("a feature or the label is missing")
                total += partial(np.column_stack(columns[:-1]), columns[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows * width, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    out = np.zeros(rows * width)
    for r in df.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(rows, width)


def _design(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.select(F.lit(1.0).alias("bias"), *(F.col(c).cast("double") for c in features), F.col(label).cast("double").alias("label"))


def gram(df: DataFrame, features: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, X'y, n) with a bias column first."""
    d = len(features) + 1
    s = _sum_rows(_design(df, features, label), lambda x, y: x.T @ np.column_stack([x, y]), d, d + 1)
    return s[:, :d], s[:, d], int(s[0, 0])


def least_squares(df: DataFrame, features: Sequence[str], label: str) -> np.ndarray:
    """Minimum-norm weights from the Gram matrix's eigenvalues."""
    a, b, _ = gram(df, features, label)
    value, vector = np.linalg.eigh(a)
    kept = value > value.max() * len(value) * np.finfo(float).eps
    return vector[:, kept] @ ((vector[:, kept].T @ b) / value[kept])


def ridge(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float]) -> dict[float, np.ndarray]:
    """Weights for each penalty from one pass; the bias is penalised too."""
    a, b, n = gram(df, features, label)
    return {p: np.linalg.solve(a + 2 * n * p * np.eye(len(b)), b) for p in penalties}


def ridge_by_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, penalties: Sequence[float]) -> dict[float, list[np.ndarray]]:
    """For each penalty the weights of each fold's model, which is fitted on the other folds; one pass for all, as sums over folds add up."""
    d = len(features) + 1

    def partial(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([x[at == f, :d].T @ x[at == f] for f in range(k)])

    rows = df.select(F.lit(1.0).alias("bias"), *(F.col(c).cast("double") for c in features), F.col(label).cast("double").alias("__label"), F.col(fold).cast("double").alias("__fold"))
    own = _sum_rows(rows, partial, k * d, d + 1).reshape(k, d, d + 1)
    others = [sum(own[j] for j in range(k) if j != f) + np.zeros((d, d + 1)) for f in range(k)]
    return {p: [np.linalg.solve(s[:, :d] + 2 * s[0, 0] * p * np.eye(d), s[:, d]) for s in others] for p in penalties}


def newton_logistic(df: DataFrame, features: Sequence[str], label: str, penalty: float = 1e-4, steps: int = 20, tolerance: float = 1e-10) -> np.ndarray:
    """Damped Newton on the mean logistic loss plus ``penalty`` times the squared norm, labels 0 and 1.

    The design is kept in the executors' memory or on their disks (a lost part is made anew). A pass gives the loss
    and the derivatives where the line search looks, as the first size it tries is mostly taken.
    """
    data = _design(df, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    d = len(features) + 1
    w = np.zeros(d)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = x @ w
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return np.column_stack([x.T @ (x * (p * (1 - p))[:, None]), x.T @ (p - y), x.sum(0), np.full(d, (np.logaddexp(0, z) - y * z).sum())])

        s = _sum_rows(data, run, d, d + 3)
        n = max(1.0, s[0, d + 1])  # the first column is 1
        return s[0, d + 2] / n + penalty * w @ w, s[:, d] / n + 2 * penalty * w, s[:, :d] / n + 2 * penalty * np.eye(d)

    try:
        loss, g, h = at(w)
        for _ in range(steps):
            step = np.linalg.solve(h + 1e-10 * np.eye(d), g)
            if g @ step / 2 <= tolerance:
                break
            size = 1.0
            while size > 1e-6 and (there := at(w - size * step))[0] > loss - 1e-4 * size * (g @ step):
                size /= 2
            if size <= 1e-6:
                break
            w, (loss, g, h) = w - size * step, there
    finally:
        data.unpersist()
    return w


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, which lost executors don't touch; a local folder only where none is set and all tasks run in this process (tests)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomwork-"))
    return df.checkpoint()


def gradient_descent(df: DataFrame, features: Sequence[str], label: str, steps: int, rate: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Full-batch descent on half the mean squared error, and its value: one pass, as the gradient needs only sums."""
    a, b, n = gram(df, features, label)
    yy = float(df.agg(F.sum(F.col(label).cast("double") ** 2)).first()[0] or 0.0)
    w, n = np.zeros(len(b)) if start is None else np.asarray(start, float), max(1, n)
    for _ in range(steps):
        w = w - rate * (a @ w - b) / n
    return w, float((w @ a @ w - 2 * w @ b + yy) / (2 * n))


class Logistic:
    """Mean weighted logistic loss and gradient, a job each time; labels 0 and 1, positives weighing ``positive``."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, penalty: float = 0.0, positive: float = 1.0):
        self.data, self.d, self.penalty, self.positive = _design(df, features, label), len(features) + 1, penalty, positive

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """With the penalty, which covers the bias."""
        positive, d = self.positive, self.d

        def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s, z = np.where(y == 1, positive, 1.0), x @ w
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return np.column_stack([x.T @ (s * (p - y)), np.full(d, s @ (np.logaddexp(0, z) - y * z)), np.full(d, s.sum())])

        sums = _sum_rows(self.data, run, d, 3)
        n = sums[0, 2] or 1.0
        return sums[0, 1] / n + self.penalty * w @ w, sums[:, 0] / n + 2 * self.penalty * w


def logistic_descent(f: Logistic, steps: int, rate: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Fixed steps; the loss comes without the penalty."""
    w = np.zeros(f.d) if start is None else np.asarray(start, float)
    for _ in range(steps):
        w = w - rate * f(w)[1]
    return w, float(f(w)[0] - f.penalty * w @ w)


def adaptive_descent(f: Logistic, steps: int, rate: float = 1.0, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Barzilai-Borwein steps within [1e-10, 1e10], halved until the loss falls enough."""
    w = np.zeros(f.d) if start is None else np.asarray(start, float)
    loss, g = f(w)
    for _ in range(steps):
        if g @ g < 1e-24:
            break
        size = rate
        while size > 1e-12:
            there, slope = f(w - size * g)
            if there <= loss - 1e-4 * size * g @ g:
                break
            size /= 2
        else:
            break
        moved, bent = -size * g, slope - g
        w, loss, g = w + moved, there, slope
        rate = float(np.clip(moved @ moved / max(moved @ bent, 1e-300), 1e-10, 1e10))
    return w, float(loss - f.penalty * w @ w)


def extra_gradient(f: Logistic, steps: int, radius: float = 10.0, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Universal extra-gradient in a ball: two jobs a step, steps from the gradients' differences, a weighted mean as result."""
    project = lambda v: v * min(1.0, radius / max(float(np.linalg.norm(v)), 1e-300))
    y = project(np.zeros(f.d) if start is None else np.asarray(start, float))
    mean, weight, spent, diameter = np.zeros(f.d), 0.0, 0.0, 2 * radius
    for t in range(1, steps + 1):
        eta = 2 * diameter / np.sqrt(1 + spent)
        m = f((t * y + mean) / (weight + t))[1]
        x = project(y - eta * t * m)
        g = f((t * x + mean) / (weight + t))[1]
        y = project(y - eta * t * g)
        mean, weight, spent = mean + t * x, weight + t, spent + t * t * float((g - m) @ (g - m))
    w = mean / max(weight, 1.0)
    return w, float(f(w)[0] - f.penalty * w @ w)


def score_test(df: DataFrame, features: Sequence[str], candidates: Sequence[str], label: str, weights: np.ndarray, penalty: float = 0.0) -> tuple[float, float]:
    """(statistic, p-value) of adding ``candidates`` to a logistic model fitted with ``penalty``, from one pass; the p-value by Wilson and Hilferty's cube root."""
    d, k = len(features) + 1, len(candidates)

    def partial(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x[:, :d] @ weights, -700, 700)))
        return x.T @ np.column_stack([x * (p * (1 - p))[:, None], y - p, np.ones(len(x))])

    s = _sum_rows(_design(df, [*features, *candidates], label), partial, d + k, d + k + 2)
    info, slope = s[:, :-2] + 2 * penalty * s[0, -1] * np.eye(d + k), s[d:, -2]  # the first column is 1, so its sum counts rows
    left = info[d:, d:] - info[d:, :d] @ np.linalg.pinv(info[:d, :d]) @ info[:d, d:]
    statistic = float(slope @ np.linalg.pinv(left, hermitian=True) @ slope)
    if statistic <= 0:
        return statistic, 1.0
    scale = 2 / (9 * k)
    z = (np.cbrt(statistic / k) - (1 - scale)) / math.sqrt(scale)
    return statistic, 0.5 * math.erfc(z / math.sqrt(2))
