"""Documents from files and strings; PDF through an injected parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import file_kind, looks_like_markdown

RUNS = "path string, page int, seq long, str string, a double, b double, x double, y double, width double, height double, view_x0 double, view_y0 double, font string"
REJECTED = "That file is not a PDF, Markdown or plain text file."


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text, markdown): whole files; the title is the name without its last extension."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]+\z", "").alias("title"), "text", (name.rlike(r"(?i)\.(md|markdown)\z") | looks_like_markdown(F.col("text"))).alias("markdown"))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, "Pasted text", text)], "doc_id long, title string, text string")


def dispatch(files: DataFrame) -> DataFrame:
    """(name, mime) -> kind, with a message for what can't be read."""
    kind = file_kind(F.col("name"), F.col("mime"))
    return files.withColumn("kind", kind).withColumn("error", F.when(F.col("kind") == "rejected", REJECTED))


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Items of each page of each PDF under path. parse(bytes) yields (page, seq, str, a, b, x, y, width, height, view_x0, view_y0, font)."""
    columns = [c.split()[0] for c in RUNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(at, *item) for item in parse(content)], columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RUNS)
