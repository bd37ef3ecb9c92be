import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import linear, metrics, sampling, statistics, validation


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v) if i % 9 else None, float(i % 4), bool(rng.random() < 0.3)) for i, v in enumerate(rng.normal(size=1000).round(2))]
    return spark.createDataFrame(rows, "id long, v double, c double, y boolean")


def test_quantiles(spark, table):
    v = np.array([r.v for r in table.collect() if r.v is not None])
    levels = [0, 0.005, 0.1, 0.5, 0.9, 0.995, 1]
    assert statistics.quantiles(table, "v", levels) == pytest.approx(np.quantile(v, levels).tolist())
    assert statistics.quantiles(table.where("id < 0"), "v", levels) == []
    assert statistics.quantiles(spark.createDataFrame([(3.0,)] * 5, "v double"), "v", [0, 0.5, 1]) == [3.0] * 3


def test_discretized(spark, table):
    v = np.array([r.v for r in table.collect() if r.v is not None])
    edges = np.unique(np.quantile(v, np.linspace(0, 1, 11)))
    for r in statistics.discretized(table, "v").collect():
        assert r.code == (None if r.v is None else min(np.searchsorted(edges, r.v, "right") - 1, len(edges) - 2))
    assert {(r.c, r.code) for r in statistics.discretized(table, "c").collect()} == {(float(i), i) for i in range(4)}
    assert [r.code for r in statistics.discretized(spark.createDataFrame([(None,)] * 2, "v double"), "v").collect()] == [None] * 2


def test_value_ranges(table):
    v = np.array([r.v for r in table.collect() if r.v is not None])
    got = statistics.value_ranges(table, "v", -1.0, 1.0, [0, 0.5, 1]).first()
    z = (v - v.mean()) / v.std()
    assert (got.n, got.outside) == (len(v), int((abs(v) > 1).sum())) and got.skewness == pytest.approx((z**3).mean())
    assert got.quantiles == pytest.approx(np.quantile(v, [0, 0.5, 1]).tolist())
    empty = statistics.value_ranges(table.where("id < 0"), "v", -1.0, 1.0).first()
    assert (empty.n, empty.outside, empty.quantiles) == (0, 0, [])


def test_prevalence_by_group(table):
    by_value = {r.low: r.n for r in statistics.prevalence_by_group(table, "c", F.col("y")).collect()}
    assert by_value == {0.0: 250, 1.0: 250, 2.0: 250, 3.0: 250}
    rows = table.collect()
    edges = np.unique(np.quantile([r.v for r in rows if r.v is not None], np.linspace(0, 1, 11)))
    bins = [None if r.v is None else int(np.clip(np.searchsorted(edges, r.v, side="right") - 1, 0, len(edges) - 2)) for r in rows]
    want = {None if b is None else round(float(edges[b]), 6): (bins.count(b), np.mean([r.y for r, x in zip(rows, bins, strict=True) if x == b])) for b in set(bins)}
    got = {None if r.low is None else round(r.low, 6): (r.n, r.rate) for r in statistics.prevalence_by_group(table, "v", F.col("y")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and got[k][1] == pytest.approx(p) for k, (n, p) in want.items())


def test_one_per_group(spark):
    rows = [(i, None if i < 5 else 1, None if i < 5 else 1, None if i >= 5 else 1, None if i % 2 == 0 else 1, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, c0 int, c1 int, c2 int, c3 int, c4 int")
    assert statistics.one_per_group(df, ["c1", "c0", "c2", "c3", "c4"]) == ["c1", "c3", "c4"] and statistics.one_per_group(df, ["c4"]) == ["c4"]


def test_stratified_split(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    got = sampling.stratified_split(df, "y", "id", 0.2).groupBy("validation").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert {(r.validation, r.n, r.p) for r in got} == {(True, 200, 20), (False, 800, 80)}


def test_labels(spark):
    df = spark.createDataFrame([(0.5, 1, True), (0.4, -1, True), (0.4, -1, False), (None, None, False)], "s double, l int, k boolean")
    got = df.select(metrics.with_known(metrics.predicted(F.col("s"), 0.5), F.col("k")).alias("p"), metrics.to_01(F.col("l")).alias("y"), metrics.class_weights(F.col("l"), 3).alias("w")).collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 3.0), (1, 0.0, 1.0), (-1, 0.0, 1.0), (None, 0.0, 1.0)]


def test_score_test_with_a_penalty(spark):
    """The statistic is the gain of the best quadratic step in the new weights, all others refitted: numeric derivatives of the penalized likelihood."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    penalty, start, full = 0.05, linear.newton_logistic(df, ["a"], "y", 0.05), np.column_stack([np.ones(300), x])

    def likelihood(v):
        z = full @ v
        return -(np.logaddexp(0, z) - y * z).sum() - 300 * penalty * v @ v

    at, step = np.append(start, [0.0, 0.0]), 1e-3
    unit = np.eye(4) * step
    slope = np.array([(likelihood(at + u) - likelihood(at - u)) / (2 * step) for u in unit])
    bend = np.array([[(likelihood(at + u + v) - likelihood(at + u - v) - likelihood(at - u + v) + likelihood(at - u - v)) / (4 * step**2) for v in unit] for u in unit])
    gain = -slope @ np.linalg.solve(bend, slope)  # twice the gain of one Newton step, as the fitted weights' slopes are 0
    assert linear.score_test(df, ["a"], ["b", "c"], "y", start, penalty)[0] == pytest.approx(gain, rel=1e-3)


def test_best_rows_leave_out_what_diverged(spark):
    rows = [("a", 1, float("nan")), ("a", 2, 0.4), ("a", 3, 0.4), ("b", 1, float("inf")), ("c", 1, 0.1), ("c", 2, None)]
    got = validation.best_rows(spark.createDataFrame(rows, "variant string, fold int, score double"), "variant", "score").collect()
    assert {tuple(r) for r in got} == {("a", 2, 0.4), ("c", 1, 0.1)}
