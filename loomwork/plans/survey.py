"""Queries on the survey catalogue, mask and contingency operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, matrices, minibatch

#: A coded table from ``orders``: unit codes, dates, gates and bins as surveys have them.
_CODES = catalogue.Catalogue(
    codes={"rate": ((777, 999), (888,)), "watch": ((777,), ()), "date": ((), ()), "year": ((), ()), "month": ((), ()), "age": ((), ()), "days": ((77, 99), (88,)), "check": ((7, 9), ())},
    gates=[({"q1": (2,)}, {"q2": 8, "days": 0}), ({"q2": (8,)}, {"q3": 5}), ({"q1": (1,), "q4": (1,)}, {"q3": 1}), ({"absent": (1,)}, {"q4": 9})],
    conversions={"rate": catalogue.Conversion("rate"), "watch": catalogue.Conversion("duration", ("age",), 555.0), "date": catalogue.Conversion("months", ("year", "month")), "check": catalogue.Conversion("recode", values={8: 5})},
    bins={"days": (1, 8, 15, 22, 30)},
    left_out={"domain": ["year", "month"], "leakage": ["q4"], "R1": ["q1"]},
)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    df = _t(spark, sf_dir, "orders").select(
        "o_orderkey", d(100 + k % 400).alias("rate"), F.when(k % 10 == 0, F.lit(555.0)).otherwise(d(100 + k % 399)).alias("watch"), d((k % 12 + 1) * 10000 + 1890 + k % 130).alias("date"), d(2010 + k % 5).alias("year"),
        d(k % 12 + 1).alias("month"), d(18 + k % 60).alias("age"), F.when(k % 6 > 0, d(k % 100)).alias("days"), d(k % 10).alias("check"), d(k % 3).alias("q1"), F.when(k % 4 > 0, d(k % 9)).alias("q2"), F.when(k % 5 > 0, d(k % 7)).alias("q3"), d(k % 2).alias("q4"),
    )
    done = catalogue.clean(df, _CODES, "o_orderkey")
    names = _CODES.candidates([c for c in done.columns if c != "o_orderkey"], select=["R1"])
    return done.select("o_orderkey", *(F.round(c, 6).alias(c) for c in names))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(F.when(k % 4 > 0, 1).alias("a"), F.when(k % 4 == 0, 1).alias("b"), F.when((k % 4 > 0) | (k % 97 == 0), 1).alias("c"), F.when(k % 3 > 0, 1).alias("d"), F.when((k % 3 > 0) & (k % 89 > 0), 1).alias("e"), F.lit(1).alias("f"))


def missing_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.missing_together(_masks(spark, sf_dir), ["a", "b", "c", "d", "e", "f"])


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 12).alias("a"), (F.col("l_orderkey") % 4).alias("b"), (F.col("l_linenumber") - 1).alias("c"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_orderkey") % 3).alias("d"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("e"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("f"))


def determination_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrices.determinations(_coded(spark, sf_dir), ["a", "b", "c", "d", "e", "f"], [12, 4, 7, 3, 2, 2])
    return found.select("a", "b", "n", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"))


def _weights(spark: SparkSession, features: list[str], w: np.ndarray, loss: float) -> DataFrame:
    return spark.createDataFrame([(n, round(float(v), 8)) for n, v in zip(["bias", *features, "loss"], [*w, loss], strict=True)], "name string, value double")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity").cast("double") / 50).alias("quantity"), F.col("l_discount").cast("double").alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def descent_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["quantity", "discount"]
    return _weights(spark, names, *minibatch.descent_by_rows(_labelled(spark, sf_dir), names, "y", "id", 0.05, 1000))


def clipped_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["quantity", "discount"]
    return _weights(spark, names, *minibatch.clipped_newton(_labelled(spark, sf_dir), names, "y", "id", steps=100))


_UNIT = "CASE floor({v} / 100) WHEN 1 THEN ({v} % 100) * {f[0]} WHEN 2 THEN ({v} % 100) * {f[1]} WHEN 3 THEN ({v} % 100) * {f[2]} WHEN 4 THEN ({v} % 100) * 1.0 ELSE {v} END"
_PAIRS = [(a, b) for i, a in enumerate("abcdef") for b in "abcdef"[i + 1 :]]
ORACLE_SQL = {
    "clean_survey": f"""
WITH raw AS (SELECT o_orderkey, o_orderkey AS k, (100 + o_orderkey % 400)::DOUBLE AS rate, CASE WHEN o_orderkey % 10 = 0 THEN 555 ELSE 100 + o_orderkey % 399 END::DOUBLE AS watch, (o_orderkey % 12 + 1)::DOUBLE AS mm, (1890 + o_orderkey % 130)::DOUBLE AS yyyy,
  (2010 + o_orderkey % 5)::DOUBLE AS year, (18 + o_orderkey % 60)::DOUBLE AS age, CASE WHEN o_orderkey % 6 > 0 AND o_orderkey % 100 NOT IN (77, 99) THEN CASE WHEN o_orderkey % 100 = 88 THEN 0 ELSE o_orderkey % 100 END END::DOUBLE AS days,
  CASE o_orderkey % 10 WHEN 7 THEN NULL WHEN 9 THEN NULL WHEN 8 THEN 5 ELSE o_orderkey % 10 END::DOUBLE AS "check", (o_orderkey % 3)::DOUBLE AS q1, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 9 <> 7 THEN o_orderkey % 9 END::DOUBLE AS q2, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END::DOUBLE AS q3, (o_orderkey % 2)::DOUBLE AS q4 FROM orders),
one AS (SELECT *, CASE WHEN q1 = 2 THEN coalesce(q2, 8) ELSE q2 END AS q2b, CASE WHEN q1 = 2 THEN coalesce(days, 0) ELSE days END AS daysb FROM raw),
two AS (SELECT *, CASE WHEN q2b = 8 THEN coalesce(q3, 5) ELSE q3 END AS q3b FROM one)
SELECT o_orderkey, round({_UNIT.format(v="rate", f=("365.0", "52.0", "12.0"))}, 6) AS rate, round(CASE WHEN watch = 555 THEN age ELSE {_UNIT.format(v="watch", f=("(1.0::DOUBLE / 365)", "(1.0::DOUBLE / 52)", "(1.0::DOUBLE / 12)"))} END, 6) AS watch,
  round(CASE WHEN yyyy >= 1900 THEN greatest(12 * year + mm - (12 * yyyy + mm), 0) END, 6)::DOUBLE AS date, age, CASE WHEN daysb IS NULL THEN NULL ELSE (daysb >= 1)::INT + (daysb >= 8)::INT + (daysb >= 15)::INT + (daysb >= 22)::INT + (daysb >= 30)::INT END::DOUBLE AS days, "check", q2b AS q2,
  CASE WHEN q1 = 1 AND q4 = 1 THEN coalesce(q3b, 1) ELSE q3b END AS q3 FROM two""",
    "missing_together": """
WITH RECURSIVE m AS (SELECT [(o_orderkey % 4 = 0)::INT, (o_orderkey % 4 > 0)::INT, (o_orderkey % 4 = 0 AND o_orderkey % 97 > 0)::INT, (o_orderkey % 3 = 0)::INT, (o_orderkey % 3 = 0 OR o_orderkey % 89 = 0)::INT, 0] AS m FROM orders),
p AS (SELECT i, j, corr(m[i], m[j]) AS r FROM m, range(1, 6) a(i), range(1, 6) b(j) GROUP BY ALL),
l AS (SELECT i, j FROM p WHERE r > 0.9), reach AS (SELECT i, j FROM l UNION SELECT reach.i, l.j FROM reach JOIN l ON reach.j = l.i)
SELECT substr('abcdef', i::INT, 1) AS column, substr('abcdef', min(j)::INT, 1) AS least FROM reach GROUP BY i HAVING count(*) > 1""",
    "determination_pairs": "WITH c AS (SELECT l_orderkey % 12 AS a, l_orderkey % 4 AS b, l_linenumber - 1 AS c, CASE WHEN l_orderkey % 5 > 0 THEN l_orderkey % 3 END AS d, (l_returnflag = 'R')::INT AS e, (l_linestatus = 'O')::INT AS f FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round((entropy({a}) + entropy({b}) - entropy({a} || '-' || {b})) / nullif(entropy({b}), 0), 6) AS forward, round((entropy({a}) + entropy({b}) - entropy({a} || '-' || {b})) / nullif(entropy({a}), 0), 6) AS backward FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS),
}

QUERIES = {f.__name__: f for f in (clean_survey, missing_together, determination_pairs, descent_by_rows, clipped_newton)}
