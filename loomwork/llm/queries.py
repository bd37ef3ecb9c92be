"""The driver's queries on the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, collocations, jaccard, lines, media, mixing, packing, passages, quality, repetition, secrets, suffix, superminhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(_table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_table(spark, sf_dir, "documents"), short=True)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(_table(spark, sf_dir, "documents"), with_media=False)


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_passages, op4_secrets, op5_mixing, op6_suffix, op7_lines, op8_jaccard, op9_repetition, op10_media, op11_superminhash, op12_alignment, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op13_collocations": collocations.ORACLE_SQL}
