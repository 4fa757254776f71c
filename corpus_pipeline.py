"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage reads what its predecessor kept, as Parquet, and returns the rows that stay;
all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.exact import keep_one_each
from leafmill.llm.minhash import near_duplicates
from leafmill.llm.mixing import mixed_corpus, source_labels
from leafmill.llm.store import Scratch
from leafmill.llm.tiling import decontaminate
from leafmill.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier flags go; null and empty texts, long ones, repeats and further columns are as in ``reject_toxic``."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once; null texts are empty ones. All columns are kept."""
    return keep_one_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays. Texts without words and rows without doc_id stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover enough of a benchmark item go. Null texts and rows without doc_id stay; all columns are kept."""
    verdict = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = verdict.where("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says; with a least rate of 1 none is lost. Columns named domain, rate or copy give way."""
    labels = source_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed_corpus(docs, labels, least_rate=1.0)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier, the sketches and the mixing rates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
