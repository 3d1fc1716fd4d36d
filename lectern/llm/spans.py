"""Byte spans of documents: merging them, and what is left without them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

import pyarrow as pa

from ._shared import small_rows

SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
#: Order of documents: by id, null last; ids that come with several texts go by the text's hash.
LAST = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, version, text): doc and version order the documents, a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs; spans that touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of sorted disjoint spans."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join(kept) + data[at:]


def removed(documents: DataFrame, found: DataFrame, with_kept: bool = False, least_run: int = 0) -> DataFrame:
    """keyed() documents and (doc, version, start, end) rows -> doc_id, n_bytes, spans (merged), n_removed, n_spans, kept_sha256, kept (bytes, on demand).

    Spans are gathered for a document at a time, so they are bounded by its
    length. Documents without spans come out whole; merged runs of fewer than
    `least_run` bytes stay.
    """
    per_doc = found.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = documents.join(per_doc, ["doc", "version"], "left").select("doc_id", "text", "found")
    fields = [StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("spans", ArrayType(SPAN))]
    schema = StructType(fields + [StructField("kept", BinaryType())] * with_kept)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in small_rows(batches):
            rows = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = [(a, b) for a, b in merged([(s["start"], s["end"]) for s in spans or ()]) if b - a >= least_run]
                kept = without(text, runs)
                rows.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], kept)[: len(arrow)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(run, schema)
