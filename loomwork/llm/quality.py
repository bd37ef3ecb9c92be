"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

The features (shares of character classes, word and line statistics) come from a
few numpy passes over each slice of rows. Random cosines approximate a Gaussian
kernel; each partition sums the normal equations of its labelled rows, by fold,
and only those sums (a fixed size) reach the driver. Leaving a fold out of the
total gives scores that the isotonic fit hasn't seen; it works on a histogram of
them with ``BINS`` rows.

Defined results: a null text counts as empty, and an empty one is scored by its
(zero) statistics; labels that are null or belong to no document are ignored; a
document labelled more than once counts once for each label; without labels
every score is 0.5; rows that repeat are scored alike; an empty table gives an
empty result; a null key is neither learned from nor held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

COSINES = 256
RIDGE = 1e-3
FOLDS = 4
BINS = 2000
#: Labelled rows that are learned from at most, the first by hash.
MAX_LABELS = 1_000_000
PARTIALS = 24
BLOCK = 32
THRESHOLD = 0.3

# Character classes whose shares are features.
_SETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "#*$%&", "|<>", "!?", ".,;:", "'\"()[]{}", "@/\\_=+~^`-"]
_CLASS = np.full(256, len(_SETS), np.int64)
for _k, _s in enumerate(_SETS):
    _CLASS[[ord(c) for c in _s]] = _k
_CLASS[128:] = len(_SETS) + 1
N_CLASSES = len(_SETS) + 2
N_FEATURES = N_CLASSES + 13


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each row of a slice."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows), size)
    classes = np.bincount(owner * N_CLASSES + _CLASS[data], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)
    safe = np.maximum(size, 1)
    begin, end, first = T.words(data, offsets)
    n, length = np.diff(first), end - begin
    word_row = T.row_of(first)
    some = np.maximum(n, 1)
    mean = T.sums(length, first) / some
    square = T.sums(length * length, first) / some
    span = T.SpanHash(data)
    key = T.mix(span(begin, end) + (word_row.astype(T.U64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    fresh = np.ones(len(key), bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    caps = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int64)])
    upper = caps[end] - caps[begin]
    last = data[end - 1] if len(end) else data[:0]
    lb, le, lf = T.lines(data, offsets)
    line_row, lines = T.row_of(lf), np.maximum(np.diff(lf), 1)
    line_key = T.mix(span(lb, le) + (line_row.astype(T.U64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))
    order = np.argsort(line_key)
    again = np.zeros(len(line_key), bool)
    again[order[1:]] = line_key[order[1:]] == line_key[order[:-1]]
    words_in = np.searchsorted(begin, le) - np.searchsorted(begin, lb)
    share = classes / safe[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(1)
    return np.column_stack([
        np.sqrt(share), np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(square - mean * mean, 0)), T.sums(fresh, first) / some, T.sums(upper == length, first) / some,
        T.sums(upper > 0, first) / some, T.sums(_CLASS[last] >= 5, first) / some, T.sums(length == 1, first) / some, np.log1p(n / lines),
        np.bincount(line_row[again], weights=(le - lb)[again], minlength=rows) / safe, T.sums(words_in == 1, lf) / lines, entropy,
    ])


def cosines(x: np.ndarray, centre: np.ndarray, spread: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(x.shape[1])
    frequency, phase = rng.normal(0, scale, (x.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
    z = np.clip((x - centre) / spread, -8, 8)
    return np.column_stack([np.sqrt(2 / n) * np.cos(z @ frequency + phase), np.ones(len(x))])


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of means ``value`` with these weights."""
    blocks: list[list[float]] = []  # weight, mean, length
    for w, v in zip(weight, value, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.zeros(0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy().reshape(len(column), N_FEATURES)


def feature_table(docs: DataFrame, text: str, key: str, told: str | None = None) -> DataFrame:
    """(key, x), and with ``told`` a column of that name with the text's SHA-256 in hex, a null text's being that of an empty one."""
    kind = dict(docs.select(key).dtypes)[key]
    more = [F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(told)] if told else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(1)):
                x = statistics(data, offsets)
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), x.ravel())
                rest = [c.slice(i, j - i) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows, *rest], [key, "x", *([told] if told else [])])

    return docs.select(F.col(key), F.col(text), *more).mapInArrow(run, f"`{key}` {kind}, x array<double>" + (f", `{told}` string" if told else ""))


class Classifier:
    """Weights and calibration, small enough to go with each task."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray], n: int, seed: int):
        self.centre, self.spread, self.weights, self.knots, self.n, self.seed = centre, spread, weights, knots, n, seed

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosines(x, self.centre, self.spread, self.n, self.seed) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; within a level of the isotonic fit the raw score still orders by a hundredth."""
        raw = self.raw(x)
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", n: int = COSINES, ridge: float = RIDGE, seed: int = 3, max_labels: int = MAX_LABELS) -> Classifier | None:
    """Learns from the labelled rows whose crc32 of the key as text isn't 0 modulo 5."""
    spark = features.sparkSession
    scratch = Scratch(spark, "quality-fit")
    known = labels.select(F.col(key), F.col(label).cast("double").alias("y")).where("y is not null").where(F.crc32(F.col(key).cast("string")) % 5 != 0)
    rows = scratch.save(features.join(known, key).withColumn("h", F.xxhash64(F.col(key).cast("string"))), "rows")
    total = rows.count()
    if total > max_labels:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * max_labels / total))
    moments = rows.agg(*(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(N_FEATURES) for f in (F.avg, F.stddev_pop))).first()
    if not total or moments[0] is None:
        return None
    centre, spread = np.array(moments[0::2], float), np.array(moments[1::2], float)
    spread[spread < 1e-9] = 1.0
    d = n + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, d, d + 2))
        for batch in batches:
            fold = batch.column(2).to_numpy() % FOLDS
            for at in range(0, len(fold), 4096):
                part = batch.slice(at, 4096)
                z, y = cosines(_matrix(part, "x"), centre, spread, n, seed), part.column(1).to_numpy()
                for k in range(FOLDS):
                    own = fold[at : at + 4096] == k
                    sums[k] += z[own].T @ np.column_stack([z[own], y[own], np.ones(own.sum())])
        yield pa.RecordBatch.from_pydict({
            "fold": pa.array(np.repeat(np.arange(FOLDS), d), pa.int32()), "i": pa.array(np.tile(np.arange(d), FOLDS), pa.int32()),
            "block": pa.array(np.repeat(np.arange(FOLDS), d) * d + np.tile(np.arange(d) // BLOCK, FOLDS), pa.int32()), "row": pa.array(list(sums.reshape(-1, d + 2)), pa.list_(pa.float64())),
        })

    def gather(table: pa.Table) -> pa.Table:
        rows, fold = table.column("i").to_numpy(), table.column("fold")[0].as_py()
        at, inverse = np.unique(rows, return_inverse=True)
        out = np.zeros((len(at), d + 2))
        np.add.at(out, inverse, table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, d + 2))
        return pa.table({"fold": pa.array(np.full(len(at), fold), pa.int32()), "i": pa.array(at, pa.int32()), "row": pa.array(list(out), pa.list_(pa.float64()))})

    kind = "fold int, i int, row array<double>"
    partial = rows.select("x", "y", F.pmod("h", F.lit(FOLDS)).alias("h")).coalesce(PARTIALS).mapInArrow(add, "fold int, i int, block int, row array<double>")
    sums = np.zeros((FOLDS, d, d + 2))
    for r in partial.groupBy("block").applyInArrow(gather, kind).collect():  # FOLDS * d rows
        sums[r["fold"], r["i"]] = r["row"]

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :d] + ridge * max(1.0, s[d - 1, d + 1]) / n * np.eye(d), s[:, d])

    whole = sums.sum(0)
    held = np.array([solve(whole - sums[k]) for k in range(FOLDS)])
    edges = (-0.5, 1.5)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            raw = (cosines(_matrix(batch, "x"), centre, spread, n, seed) * held[fold]).sum(1)
            at = np.clip((raw - edges[0]) / (edges[1] - edges[0]) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    seen = rows.select("x", "y", F.pmod("h", F.lit(FOLDS)).alias("h")).mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    place = np.array([edges[0] + (r["bin"] + 0.5) * (edges[1] - edges[0]) / BINS for r in seen])
    fitted = isotonic(np.array([r["n"] for r in seen], float), np.array([r["y"] for r in seen]))
    scratch.drop("rows")
    return Classifier(centre, spread, solve(whole), (place, fitted), n, seed)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD, told: str | None = None) -> DataFrame:
    """(key, held_out, score, predicted) of each document; ``told`` names one more column, the text's SHA-256, which tells rows of one key apart."""
    features = Scratch(docs.sparkSession, "quality").save(feature_table(docs, text, key, told), "features")
    more = [told] if told else []
    model = fit(features, labels, key, label)
    kind = dict(features.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x")
            score = np.concatenate([model.score(x[a : a + 4096]) for a in range(0, len(x), 4096)]) if model and len(x) else np.full(len(x), 0.5)
            rest = [batch.column(batch.schema.get_field_index(c)) for c in more]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *rest], [key, "score", *more])

    scored = features.mapInArrow(run, f"`{key}` {kind}, score double" + "".join(f", `{c}` string" for c in more))
    return scored.select(key, F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)
