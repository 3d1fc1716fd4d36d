"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find the repeats.

Where the hash of the 16 bytes before a place has GEAR_BITS zero bits, a cut may
lie; the one with the least hash comes first and keeps others LEAST bytes away. So
cuts hang on the bytes around them, not on the cut before, and two copies of a
passage fall into step a few dozen bytes from its ends. Chunks go to their digest's bucket packed in arrays,
each digest once per task; the smallest (document, offset) keeps its chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ._shared import buckets_for, cut, small_rows, text_bytes
from .spans import keyed, removed

#: Chunks are at least LEAST bytes and end where GEAR_BITS bits of the hash are zero; stretches without a cut are cut every MOST bytes, and an end of fewer than LEAST bytes belongs to the chunk before it.
LEAST, GEAR_BITS, MOST = 48, 3, 1024
REACH = 16
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Makes an order of hashes that share their first bits.
SPREAD = np.uint32(2654435769)
SEGMENT = 1 << 20
CHUNK = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("version", "<i8"), ("start", "<u8"), ("end", "<u8")])
TASK_BYTES, HELD = 48 << 20, 400_000
#: Fewer repeated bytes in a row than this stay: a short line that many documents share, such as a greeting, is no copied passage.
LEAST_RUN = 128


def gear_hash(data: np.ndarray) -> np.ndarray:
    """sum of GEAR[byte i-j] << 2j over j < REACH, modulo 2**32, by doubling the reach."""
    h, reach = GEAR[data], 1
    while reach < REACH:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(2 * reach)
        h, reach = more, 2 * reach
    return h


def cuts(data: bytes, least: int = LEAST, bits: int = GEAR_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of a document; the same bytes around a cut give the same cut."""
    if not data:
        return []
    places, ranks = [], []
    top = np.uint32(((1 << bits) - 1) << (32 - bits))
    for at in range(0, len(data), SEGMENT):
        lead = min(at, REACH - 1)
        part = np.frombuffer(data, dtype=np.uint8, offset=at - lead, count=min(SEGMENT, len(data) - at) + lead)
        h = gear_hash(part)[lead:]
        found = np.flatnonzero(h & top == 0)
        places.append(found + at + 1)
        ranks.append(h[found] * SPREAD)
    place = np.concatenate(places)
    place = place[np.argsort(np.concatenate(ranks), kind="stable")]
    # 1: no cut may lie here, as one with a smaller hash, the start or the end is too near
    shut, full = bytearray(len(data) + 1), b"\1" * (2 * least - 1)
    shut[:least] = shut[max(0, len(data) - least + 1) :] = b"\1" * min(least, len(data) + 1)
    chosen = []
    for at in range(0, len(place), SEGMENT):
        for end in place[at : at + SEGMENT].tolist():
            if not shut[end]:
                chosen.append(end)
                shut[end - least + 1 : end + least] = full
    ends, last = [], 0
    for end in [*sorted(chosen), len(data)]:
        while end - last >= most + least:
            last += most
            ends.append(last)
        ends.append(end)
        last = end
    return ends


def _first_of(table: np.ndarray) -> np.ndarray:
    """Whether each chunk is the first with its digest by document and offset."""
    order = np.lexsort((table["start"], table["version"], table["doc"], table["low"], table["high"]))
    sorted_ = table[order]
    first = np.ones(len(table), dtype=bool)
    first[1:] = (sorted_["high"][1:] != sorted_["high"][:-1]) | (sorted_["low"][1:] != sorted_["low"][:-1])
    # rows that repeat a document are one document: their chunk is first as well
    same = np.zeros(len(table), dtype=bool)
    same[1:] = ~first[1:] & (sorted_["doc"][1:] == sorted_["doc"][:-1]) & (sorted_["version"][1:] == sorted_["version"][:-1]) & (sorted_["start"][1:] == sorted_["start"][:-1])
    group = np.cumsum(~same) - 1
    out = np.empty(len(table), dtype=bool)
    out[order] = first[~same][group]
    return out


def duplicate_chunks(documents: DataFrame, least: int = LEAST, bits: int = GEAR_BITS, most: int = MOST) -> DataFrame:
    """keyed() documents -> (doc, version, start, end) of the chunks that repeat an earlier one."""
    buckets = buckets_for(text_bytes(documents, "text") / (least + (1 << bits)) * CHUNK.itemsize, TASK_BYTES)
    schema = StructType([StructField("bucket", IntegerType()), StructField("again", BinaryType()), StructField("chunks", BinaryType())])

    def flush(held: list) -> pa.RecordBatch:
        table = np.array(held, dtype=CHUNK)
        first = _first_of(table)
        again, table = table[~first], table[first]
        place = (table["low"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        table, place = table[order], place[order]
        names = np.unique(place)
        edges = np.searchsorted(place, names)
        parts = [table[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(table)], strict=True)]
        rows = [(-1, again.tobytes(), None)] + [(int(n), None, p) for n, p in zip(names, parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "again", "chunks"])

    def run(batches):
        held: list = []
        for batch in small_rows(batches):
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                data, start = text.as_py(), 0
                for end in cuts(data, least, bits, most):
                    digest = hashlib.blake2b(data[start:end], digest_size=16).digest()
                    held.append((int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"), doc, version, start, end))
                    start = end
                if len(held) >= HELD:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.frombuffer(b"".join(rows["chunks"]), dtype=CHUNK)
        again = table[~_first_of(table)]
        return pd.DataFrame({c: again[c].astype("int64") for c in ("doc", "version", "start", "end")})

    chunks = cut(documents.select("doc", "version", "text").mapInArrow(run, schema), "chunks")
    spans = "doc long, version long, start long, end long"

    def unpack(batches):
        for batch in batches:
            again = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(again[c].astype(np.int64)) for c in ("doc", "version", "start", "end")], names=["doc", "version", "start", "end"])

    # what a task itself saw before is settled; the rest meets in the buckets
    local = chunks.where("bucket = -1").select("again").mapInArrow(unpack, spans)
    return local.unionByName(chunks.where("bucket >= 0").groupBy("bucket").applyInPandas(settle, spans))


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, least_run: int = LEAST_RUN, **sizes) -> DataFrame:
    """One row per document: n_bytes, the spans of chunks that repeat an earlier chunk (smaller id, or earlier in the document), n_removed, n_spans, kept_sha256.

    A null or empty text has no chunks; rows that repeat id and text are one
    document and share its spans; a null id comes after all others; an empty
    table gives no rows; other columns are ignored. Only the one
    chunk of a shorter document has fewer than LEAST bytes. Neighbouring
    repeated chunks are one run, and only runs of `least_run` bytes go.
    """
    documents = keyed(docs, id_col, text_col)
    return removed(documents, duplicate_chunks(documents, **sizes), with_kept, least_run)
