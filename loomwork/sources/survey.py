"""Survey files: wide CSV sources with their labels, cached as Parquet; predictions as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_features(spark: SparkSession, path: str, columns: Sequence[str], key: str = "Id") -> DataFrame:
    """(key, columns) with NULL for empty cells; a header that differs is an error."""
    schema = ", ".join([f"`{key}` long", *(f"`{c}` double" for c in columns)])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_labelled(spark: SparkSession, features: str, labels: str, columns: Sequence[str], label: str, key: str = "Id") -> DataFrame:
    """Features joined with their labels by key; rows without a partner on either side are an error."""
    x = read_features(spark, features, columns, key)
    y = spark.read.schema(f"`{key}` long, `{label}` int").option("header", True).option("enforceSchema", False).csv(labels)
    for one, other in ((x, y), (y, x)):
        if not one.join(other, key, "left_anti").isEmpty():
            raise ValueError("features and labels hold different keys")
    return x.join(y, key)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``, built first if it isn't there (whole, by its success marker)."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def every_nth(df: DataFrame, key: str, n: int = 50, ranges: int = 256) -> DataFrame:
    """Each n-th row by key, from the first; ranks are summed by key range, so that no task orders all rows."""
    edges = sorted(set(df.stat.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.001)))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(key))) if edges else F.lit(0)
    rows = df.withColumn("__at", at)
    before = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = rows.groupBy("__at").count().select("__at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__at").orderBy(key)) - 1
    ranked = rows.withColumn("__rank", rank).join(F.broadcast(base), "__at")  # at most ``ranges`` rows
    return ranked.where((F.col("__base") + F.col("__rank")) % n == 0).select(*df.columns)


def write_submission(df: DataFrame, path: str, key: str = "Id", prediction: str = "Prediction") -> None:
    """(key, prediction) as CSV with a header, by key; predictions other than -1 and 1 are an error."""
    if not df.where(~F.coalesce(F.col(prediction).isin(-1, 1), F.lit(False))).isEmpty():
        raise ValueError("predictions must be -1 or 1")
    out = df.select(F.col(key).cast("long"), F.col(prediction).cast("int")).orderBy(key)
    out.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def check_submission(spark: SparkSession, path: str, keys: DataFrame, key: str = "Id", prediction: str = "Prediction") -> bool:
    """Whether the file holds each of ``keys`` once with a prediction of -1 or 1, and no other."""
    got = spark.read.schema(f"`{key}` long, `{prediction}` int").option("header", True).option("lineSep", "\r\n").csv(path)
    want = keys.select(F.col(key).cast("long"))
    same = got.select(key).exceptAll(want).isEmpty() and want.exceptAll(got.select(key)).isEmpty()
    return same and got.where(~F.coalesce(F.col(prediction).isin(-1, 1), F.lit(False))).isEmpty()
