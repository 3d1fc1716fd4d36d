"""From raw documents to packed training sequences; each stage works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._shared import cut, intermediates, release
from lectern.llm.fertility import keep_good
from lectern.llm.jaccard_join import deduplicate
from lectern.llm.mixing import apply_mix
from lectern.llm.packing import pack_documents
from lectern.llm.secret_scan import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and the fertility bands; null and blank texts fail."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard similarity 0.8: the smallest id; a null id is larger than any."""
    return deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text replaced by their kind; n_chars follows the text, null for a null one."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them; a null source is one of its own."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are documents of their own."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Sampling and packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage leaves behind goes once the next one's input is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = intermediates(spark)
    for _, stage in STAGES[:-1]:
        made: list[str] = []
        docs = cut(stage(spark, docs, sf_dir), "stage", made)
        release(spark, before | {made[0].rsplit("/", 1)[-1]})
    return STAGES[-1][1](spark, docs, sf_dir)
