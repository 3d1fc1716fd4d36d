"""Bounded-space online packing of tokenised documents into windows.

Every task keeps at most `open_windows` open. A document's full windows leave at
once; its rest goes into the open window that it fits best. When none fits and
no more may be opened, the fullest is filled up with the front of the rest and
leaves. What stays open is merged by groups of tasks, level by level, until
one group is left, so memory never depends on the number of tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ._shared import cut, small_rows, texts_of
from .vocabulary import ByteBpe, loaded

WINDOW, OPEN_WINDOWS, TASKS_PER_GROUP, END_ID = 2048, 16, 64, 1


class Packer:
    """add() yields closed windows as (sequence, [(key, start, ids, doc_tokens, offset)]); leave() the open ones."""

    def __init__(self, first: int, window: int, most: int) -> None:
        self.next, self.window, self.most = first, window, most
        self.open: list[list] = []  # [tokens, pieces]

    def _close(self, pieces: list) -> tuple[int, list]:
        self.next += 1
        return self.next - 1, pieces

    def add(self, key, start: int, ids: bytes, doc_tokens: int) -> Iterator[tuple[int, list]]:
        while len(ids) >= 4 * self.window:
            yield self._close([(key, start, ids[: 4 * self.window], doc_tokens, 0)])
            ids, start = ids[4 * self.window :], start + self.window
        while ids:
            size = len(ids) // 4
            fits = [w for w in self.open if w[0] + size <= self.window]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
                size = self.window - best[0]
            best[1].append((key, start, ids[: 4 * size], doc_tokens, best[0]))
            best[0] += size
            ids, start = ids[4 * size :], start + size
            if best[0] == self.window:
                self.open.remove(best)
                yield self._close(best[1])

    def leave(self) -> Iterator[tuple[int, list]]:
        for _, pieces in self.open:
            yield self._close(pieces)


def _schema(id_type) -> StructType:
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return StructType([StructField("doc_id", id_type), *[StructField(n, LongType()) for n in names], StructField("group", LongType()), StructField("ids", BinaryType())])


def _rows(windows, arrow, group: int | None, with_ids: bool) -> pa.RecordBatch:
    """Pieces of windows as a batch; group: of windows that stay open."""
    flat = [(k, s, len(i) // 4, zlib.crc32(i), n, seq, off, group, i if with_ids or group is not None else None) for seq, pieces in windows for k, s, i, n, off in pieces]
    columns = list(zip(*flat, strict=True)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _merger(level: int, last: bool, arrow: pa.Schema, window: int, open_windows: int, with_ids: bool):
    """Packs what a group of tasks left open; the last group keeps one window open, so that all but one are full."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        group = table.column("group")[0].as_py()
        packer, done = Packer(level << 56 | group << 32, window, 1 if last else open_windows), []
        for r in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            done.extend(packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        left = list(packer.leave())
        parts = [_rows(done + left if last else done, arrow, None, with_ids)]
        return pa.Table.from_batches(parts if last else [*parts, _rows(left, arrow, group // TASKS_PER_GROUP, with_ids)], schema=arrow)

    return merge


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row per piece: where a run of a document's ids lies in which sequence; with_ids: also the ids, little-endian uint32.

    Each row of docs is a document of its own, also with a repeated id; a null
    or empty text is its end id alone; an empty table gives no rows; other
    columns are ignored. All sequences are full but the last of all.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    schema = _schema(chosen.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)
    end = struct.pack("<I", END_ID)

    def pack(batches):
        task = TaskContext.get().partitionId()
        packer, bpe = Packer(task << 32, window, open_windows), loaded(ByteBpe, vocabulary)
        for batch in small_rows(batches):
            keys, done = batch.column(0).to_pylist(), []
            for i, data in texts_of(batch, "_text"):
                ids = bpe.ids(data.decode("utf-8", "replace")) + end
                done.extend(packer.add(keys[i], 0, ids, len(ids) // 4))
            yield _rows(done, arrow, None, with_ids)
        yield _rows(packer.leave(), arrow, task // TASKS_PER_GROUP, with_ids)

    out = [cut(chosen.mapInArrow(pack, schema), "packed")]
    level = 1
    while True:
        rest = out[-1].where("`group` is not null")
        top = rest.agg(F.max("group")).first()[0]
        out[-1] = out[-1].where("`group` is null")
        if top is None:
            break
        merge = _merger(level, top == 0, arrow, window, open_windows, with_ids)
        out.append(cut(rest.groupBy("group").applyInArrow(merge, schema), "packed"))
        level += 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.drop("group") if with_ids else whole.drop("group", "ids")
