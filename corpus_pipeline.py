"""A corpus pipeline of five operators: each stage is written and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard, lines, mixing, packing, quality
from loomwork.llm.scratch import Scratch


def _told() -> Column:
    """What tells rows of one key apart: a hash of the text, a null one being empty."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this input's labelled rows, predicts to be good.

    Each row is judged by its own text, whatever its key, null ones included; null and empty
    texts have a score as any other. Repeated rows stay or go together. Without labelled rows all
    scores are a half, so that all stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality.classify(docs, labels, told="__told").where("predicted = 1").select(F.col("doc_id").alias("__good"), "__told").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["__good"]) & (_told() == good["__told"]), "left_semi")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated or nearly repeated lines, short ones included; those of which no word is left go.

    Documents that lose no line stay as they are, so null and empty texts do. A row that repeats
    whole loses its lines to the first; an empty table stays empty.
    """
    done = lines.deduplicated(docs, short=True)
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD)
    return done.where((F.col("__removed") == 0) | worded).select(*docs.columns).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long")))


def _sortable(docs: DataFrame) -> Column:
    """A text that sorts as ``doc_id``; null ones come last."""
    if dict(docs.dtypes)["doc_id"] == "string":
        key = F.concat(F.lit("0"), "doc_id")
    else:  # the sign bit turned, so that negative ones come first
        key = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.coalesce(key, F.lit("N"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, another one for each row: keys that several rows have are followed by the text's hash.

    Of rows of one key and text, which are copies, one stays: the least as JSON.
    """
    many = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__many"))
    if many.isEmpty():
        return docs.withColumn("__key", _sortable(docs))
    shared = docs["doc_id"].eqNullSafe(many["__many"])
    single = docs.join(many, shared, "left_anti").withColumn("__key", _sortable(docs))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = docs.join(many, shared, "left_semi").select(F.concat_ws("-", _sortable(docs), _told()).alias("__key"), row)
    rows = rows.groupBy("__key").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return single.unionByName(rows.select("__row.*", "__key"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the first by key; rows of one key go by their texts' hashes, null keys come last.

    Rows without words, null texts included, are near nothing and stay; an empty table stays empty.
    """
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD)
    keyed = _keyed(docs.where(worded))
    found = jaccard.join(keyed, key="__key").where("__key = component_id").select("__key")
    return keyed.join(found, "__key", "left_semi").select(*docs.columns).unionByName(docs.where(~worded))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass that takes words of a document.

    Null and empty texts hold no words and give no row; rows of one key are documents of their
    own; a null source is a source like others, the last. An empty table stays empty.
    """
    return mixing.mixed(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    Rows of one key, null ones included, are packed each; a null text is an empty document, a
    piece of the end mark alone. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No stage of models and components is expressible in plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 1:
            scratch.drop(f"stage-{k - 2}")
    return docs
