import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwork.operators import cleaning, linear, metrics, sampling, statistics
from loomwork.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    names = sorted(frame.columns)
    return sorted(repr([None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, (int, float)) else v for v in r]) for r in frame[names].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(plans.QUERIES) <= set(entry.queries())


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_codes(spark):
    df = spark.createDataFrame([(77.0,), (88.0,), (98.0,), (5.0,), (None,)], "v double")
    assert [r[0] for r in cleaning.codes_to_null(df, {"v": ((77,), (88,))}).collect()] == [None, 0.0, 98.0, 5.0, None]


def test_units_and_months(spark):
    assert column(spark, [102.0, 203.0, 0.0, 402.0, None], lambda v: cleaning.unit_codes(v, {1: 365, 2: 52})) == [730.0, 156.0, 0.0, 402.0, None]
    assert column(spark, [62015.0, 772015.0, 51890.0, None, 122016.0], lambda v: cleaning.months_before(v, F.lit(12.0 * 2015 + 10))) == [4.0, 3.5, None, None, 0.0]


def test_gates_see_earlier_fills(spark):
    df = spark.createDataFrame([(2.0, None, None), (1.0, 1.0, None), (None, None, None)], "a double, b double, c double")
    got = cleaning.fill_by_gates(df, [({"a": (2,)}, {"b": 3}), ({"b": (3,)}, {"c": 8}), ({"gone": (1,)}, {"c": 9})])
    assert [tuple(r) for r in got.collect()] == [(2.0, 3.0, 8.0), (1.0, 1.0, None), (None, None, None)]


def test_digitize(spark):
    assert column(spark, [0.0, 1.0, 2.0, 3.0, 7.0, 8.0, 30.0, None], lambda v: cleaning.digitize(v, (1, 3, 8, 15, 30))) == [0, 1, 1, 2, 2, 3, 5, None]


def test_threshold_ties_take_the_highest(spark):
    data = [(0.9, True), (0.9, False), (0.5, True), (0.5, False), (0.1, False)]
    got = metrics.best_threshold(spark.createDataFrame(data, "s double, y boolean"), "s", F.col("y")).first()
    assert (got.threshold, got.tp, got.fp, got.fn, got.tn) == (0.5, 2, 2, 0, 1)
    rng = np.random.default_rng(0)
    data = [(float(round(s, 2)), bool(rng.random() < s)) for s in rng.random(500)]
    best = max((2 * sum(y for s, y in data if s >= t) / (sum(s >= t for s, _ in data) + sum(y for _, y in data)), t) for t in {s for s, _ in data})
    got = metrics.best_threshold(spark.createDataFrame(data, "s double, y boolean"), "s", F.col("y")).first()
    assert (got.fbeta, got.threshold) == pytest.approx(best)
    assert metrics.best_threshold(spark.createDataFrame([], "s double, y boolean"), "s", F.col("y")).count() == 0


def test_zero_cases(spark):
    got = metrics.scores(metrics.confusion(spark.createDataFrame([(False, False)], "y boolean, p boolean"), F.col("y"), F.col("p"))).first()
    assert (got.precision, got.recall, got.fbeta, got.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None), (4.0, None), (None, None)], "a double, b double")
    assert statistics.medians(df, ["a", "b"]).first() == (2.5, 5.0)
    assert {r.column: r.mode for r in statistics.modes(statistics.value_histogram(df, ["a", "b"])).collect()} == {"a": 1.0, "b": 5.0}
    assert {r.column: r["std"] for r in statistics.moments(df, ["a", "b"]).collect()} == {"a": pytest.approx(math.sqrt(1.25)), "b": 1.0}
    one = spark.createDataFrame([(1,), (None,), (2,), (3,)], "v int")
    two = spark.createDataFrame([(1,), (2,), (2,), (2,)], "v int")
    assert statistics.variation_distance(one, two, "v").first()[0] == pytest.approx(0.5)
    pair = spark.createDataFrame([(0, 0), (1, 1)] * 4, "a int, b int")
    assert statistics.information(pair, "a", "b").first() == pytest.approx((1, 1, 1))


def test_folds(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1003)], "id int, y int")
    got = sampling.stratified_folds(df, "y", "id", 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert sorted(r.p for r in got) == [20, 20, 20, 20, 21] and max(r.n for r in got) - min(r.n for r in got) <= 2
    assert sampling.undersample(df, "y", "id", 3).count() == 404


@pytest.mark.parametrize("positives", [1, 3, 7, 8])
def test_undersample_rounds_halves_as_sql(spark, tmp_path, positives):
    c = duckdb.connect()
    c.sql(f"copy (select * from '{SF}/orders.parquet' where o_orderpriority <> '1-URGENT' union all (select * from '{SF}/orders.parquet' where o_orderpriority = '1-URGENT' order by o_orderkey limit {positives})) to '{tmp_path}/orders.parquet' (format parquet)")
    c.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    ours, theirs = plans.QUERIES["undersample_exact"](spark, str(tmp_path)).toPandas(), c.sql(plans.ORACLE_SQL["undersample_exact"]).df()
    assert rows(ours) == rows(theirs)


def test_linear(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x @ [1, -2, 0.5] + 0.3 + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    full = np.column_stack([np.ones(400), x])
    assert linear.least_squares(df, ["a", "b", "c"], "y") == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0])
    assert linear.ridge(df, ["a", "b", "c"], "y", [0.0])[0.0] == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0])
    df = df.withColumn("y", (F.col("y") > 0.5).cast("int"))
    w, t, p = linear.newton_logistic(df, ["a", "b", "c"], "y", 1e-2), (y > 0.5).astype(float), 1e-2
    assert np.abs(full.T @ (1 / (1 + np.exp(-full @ w)) - t) / 400 + 2 * p * w).max() < 1e-5
