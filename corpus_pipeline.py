"""From raw documents to token ids: the stages, and a run over a folder of tables.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept. Decisions take effect: rejected documents, further copies and
contaminated documents go, secrets are masked in the text. All but the last
return the columns of ``documents``. Every row is judged by itself: its id may be
missing or shared with other rows, of which the clean ones stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.base import table, with_row_key
from tapeloom.llm.bpe import encode, vocabulary_path
from tapeloom.llm.credentials import mask_secrets
from tapeloom.llm.decontaminate import clean_documents
from tapeloom.llm.jaccard import similarity_components
from tapeloom.llm.quality import good_documents
from tapeloom.session import scratch_path, written_once

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier gives less than an even chance of being good."""
    return good_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar texts: the smallest id's, then the first."""
    keyed = with_row_key(docs.select(*COLUMNS), "__row")
    found = similarity_components(keyed, id_col="__row").filter("n_shingles > 0").select(
        F.col("doc_id").alias("__row"), "component_id")
    members = written_once(found.join(keyed.select("__row", "doc_id"), "__row"), "members")
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("first"),
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id", F.col("first.__row").alias("__first"))
    further = members.join(first, "component_id").filter("__row <> __first").select("__row")
    return keyed.join(further, "__row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; a text's length follows."""
    return mask_secrets(docs).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of what is left."""
    return encode(docs, vocabulary_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: Trained scores, similarity groups and merges are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
