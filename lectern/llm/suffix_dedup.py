"""Exact substring dedup by prefix doubling over sampled suffixes.

A byte is removed if a string of `length` bytes covers it that also starts
earlier. Ranking every suffix would sort some 24 bytes for each byte of text at
each of seven offsets, so only a sample takes part, and nothing is lost by it:

1. Names of 1, 2, 4, ... 32 bytes are doubled at every position, locally: equal
   names are equal ranks. Of the 69 names inside a window of 100 bytes the least
   is the window's anchor. Equal windows have equal anchors at equal offsets.
2. First round in Spark: the anchors' names of 32 bytes are sorted and counted.
   Unique ones leave, and with them all their windows.
3. Second round, at an offset of 32: of the anchors left, pairs of the name and
   the name of the 32 bytes behind it (for windows that reach there) or before
   it (for the others) are sorted and counted; unique pairs leave with the
   windows they stand for.
4. Last round, past the threshold: the bytes of the windows left of an anchor
   (at most 168) go to its name's bucket, are sorted by document and place, and
   whole strings, then single windows, are held against the first that is
   equal. The comparison is of bytes, not of hashes.

Names move packed, once per block of documents, and come back as bits, so a
passage that a third of all documents holds costs one entry a block in a round.
In step 4 the strings of a name that occurs more than FREQUENT times, such as
one line between ever other neighbours, are dealt by their own bytes instead:
window by window, to the bucket of the window's digest of 128 bits, each digest
once per task. A window that repeats the one a period before it, as in long runs
of one character or line, is settled where it stands and goes through no round.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ._shared import buckets_for, cut, discard, small_rows, text_bytes
from .chunk_dedup import CHUNK, _first_of
from .spans import keyed, removed

LENGTH, GRAM = 100, 32
INDEX_BITS = 21
SEGMENT = 1 << 20
#: Longest period that is looked for.
MOST_PERIOD = 4096
BLOCK_ANCHORS = 1 << 18
TASK_BYTES = 24 << 20
#: Strings of one name that are still compared in one task, some 16 KB of memory each; windows that a task holds before it deals them.
FREQUENT, HELD = 8192, 400_000
_RANDOM = np.random.default_rng(77)
FIRST = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _RANDOM.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def doubled_names(data: np.ndarray) -> np.ndarray:
    """A 64-bit name of the GRAM bytes from each position: names of n bytes at p and p+n make the name of 2n bytes at p."""
    names, reach = FIRST[data], 1
    for factor in FACTORS[: GRAM.bit_length() - 1]:
        names = names[:-reach] * factor + names[reach:]
        names ^= names >> np.uint64(29)
        reach *= 2
    return names


def _periodic(part: np.ndarray, names: np.ndarray, chosen: np.ndarray, length: int) -> np.ndarray:
    """Which windows equal the window a period before them. Periods are looked for where neighbouring anchors have one name; missing one costs time only."""
    again = np.zeros(len(chosen), dtype=bool)
    spot = chosen[np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))]
    gaps = np.diff(spot)[names[spot[1:]] == names[spot[:-1]]]
    periods, counts = np.unique(gaps[gaps <= MOST_PERIOD], return_counts=True)
    for p in periods[counts >= 3][np.argsort(-counts[counts >= 3], kind="stable")[:8]].tolist():
        differ = np.concatenate([[0], np.cumsum(part[p:] != part[:-p], dtype=np.int32)])
        again[p:] |= differ[length : length + len(again) - p] == differ[: len(again) - p]
    return again


def anchors(data: bytes, length: int = LENGTH) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int]]]:
    """Runs of windows with one anchor: (name, name behind, name before, anchor, first window, last window), positions in the document; and the spans of windows settled as periodic.

    The names behind and before are of 32 bytes each, cut to 15 bits and never
    0; 0 where no window of the run reaches so far. A name that is equal by
    chance costs time in the next round, nothing else.
    """
    span = length - GRAM + 1
    parts, settled = [], []
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(SEGMENT + length - 1, len(data) - at))
        names = doubled_names(part)
        low = np.uint64((1 << INDEX_BITS) - 1)
        least, reach = (names & ~low) | np.arange(len(names), dtype=np.uint64), 1
        while 2 * reach <= span:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        chosen = (least & low).astype(np.int64)
        again = _periodic(part, names, chosen, length)
        if again.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
            settled += [(s + at, e + at + length - 1) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        window = np.flatnonzero(~again)
        spot = chosen[window]
        new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (np.diff(window) > 1)]))
        first, last = window[new], window[np.append(new[1:], len(window)) - 1]
        spot = spot[new]
        behind, before = spot - last <= (span - 1) // 2, spot - first > (span - 1) // 2
        half = lambda place, there: np.where(there, (names[np.where(there, place, 0)] >> np.uint64(48)) | np.uint64(1), 0).astype("<u2")  # noqa: E731, B023
        parts.append((names[spot], half(spot + GRAM, behind), half(spot - GRAM, before), spot + at, first + at, last + at))
    if not parts:
        return (np.empty(0, np.uint64), *[np.empty(0, "<u2")] * 2, *[np.empty(0, np.int64)] * 3), []
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)), settled


def _batches_of(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


DOC = np.dtype([("doc", "<i8"), ("version", "<i8"), ("anchors", "<i8")])
SPANS = np.dtype([("doc", "<i8"), ("version", "<i8"), ("start", "<i8"), ("end", "<i8")])
SPAN_COLUMNS = "doc long, version long, start long, end long"


def _named_blocks(documents: DataFrame, length: int) -> DataFrame:
    """(block, docs, names, behind, before, settled): the anchors' names of some documents in order, and the spans that are settled already."""
    binary = ("docs", "names", "behind", "before", "settled")

    def run(batches):
        task, held, names, count, done = TaskContext.get().partitionId(), [], [], 0, 0
        settled: list = []

        def flush():
            packed = [np.array(held, dtype=DOC), *(np.concatenate(x) for x in zip(*names, strict=True)), np.array(settled, dtype=SPANS)]
            return _batches_of([[task << 32 | done], *([x.tobytes()] for x in packed)], [pa.int64(), *[pa.binary()] * 5], ["block", *binary])

        for batch in small_rows(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True)
            for doc, version, text in rows:
                data = text.as_py()
                if len(data) < length:
                    continue
                found, spans = anchors(data, length)
                settled += [(doc, version, start, end) for start, end in spans]
                held.append((doc, version, len(found[0])))
                names.append(found[:3])
                count += len(found[0])
                if count >= BLOCK_ANCHORS:
                    yield flush()
                    held, names, settled, count, done = [], [], [], 0, done + 1
        if held:
            yield flush()

    schema = StructType([StructField("block", LongType()), *[StructField(n, BinaryType()) for n in binary]])
    return documents.select("doc", "version", "text").mapInArrow(run, schema)


def _settled(blocks: DataFrame) -> DataFrame:
    def unpack(batches):
        for batch in batches:
            spans = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=SPANS)
            yield _batches_of([spans[n] for n in SPANS.names], [pa.int64()] * 4, list(SPANS.names))

    return blocks.where("length(settled) > 0").select("settled").mapInArrow(unpack, SPAN_COLUMNS)


def _dealt(names: np.ndarray, buckets: int):
    """Distinct names by bucket: (distinct sorted by bucket, index of each name there, how often each occurs, bucket numbers, bucket edges)."""
    distinct, back, counts = np.unique(names, return_inverse=True, return_counts=True)
    bucket = ((distinct >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.arange(len(order))
    numbers, edges = np.unique(bucket[order], return_index=True)
    return distinct[order], where[back], counts[order], numbers, np.append(edges, len(order))


def _names(packed) -> np.ndarray:
    return np.frombuffer(packed.as_py(), dtype="<u8")


def _round(blocks: DataFrame, buckets: int, made: list[str], frequent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One round over (block, names): names meet by bucket, are sorted and counted.

    Returns (block, answers: bits of which are repeated, by bucket), and (often,
    strings): the names that occur more than `frequent` times, and how often in all.
    """

    def deal(batches):
        for batch in batches:
            for block, names in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names = _names(names)
                if not len(names):
                    continue
                distinct, _, times, numbers, edges = _dealt(names, buckets)
                cells = list(zip(edges[:-1], edges[1:], strict=True))
                more = [times[a:b][times[a:b] > 1].astype("<u4").tobytes() for a, b in cells]
                yield _batches_of([numbers, [block] * len(cells), [distinct[a:b].tobytes() for a, b in cells], [np.packbits(times[a:b] > 1).tobytes() for a, b in cells], more], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "block", "names", "multiple", "times"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, dtype="<u8") for x in rows["names"]]
        own = np.concatenate([np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(p)) for m, p in zip(rows["multiple"], parts, strict=True)])
        distinct, back = np.unique(np.concatenate(parts), return_inverse=True)
        times = np.ones(len(own), dtype=np.int64)
        times[own > 0] = np.concatenate([np.frombuffer(x, dtype="<u4") for x in rows["times"]])
        counts = np.bincount(back, weights=times).astype(np.int64)
        again = counts[back] > 1
        edges = np.cumsum([0, *map(len, parts)])
        answer = {"block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "again": [np.packbits(again[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], "often": None, "strings": 0}
        often = counts > (frequent or np.inf)
        found = {"block": [-1], "bucket": [-1], "again": [None], "often": [distinct[often].tobytes()], "strings": [int(counts[often].sum())]}
        return pd.concat([pd.DataFrame(answer), pd.DataFrame(found)]) if often.any() else pd.DataFrame(answer)

    dealt = blocks.mapInArrow(deal, "bucket int, block long, names binary, multiple binary, times binary")
    counted = cut(dealt.groupBy("bucket").applyInPandas(count, "block long, bucket int, again binary, often binary, strings long"), "answers", made)
    answers = counted.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "again"))).alias("answers"))
    return answers, counted.where("block < 0").select("often", "strings")


def _answered(names: np.ndarray, answers, buckets: int) -> np.ndarray:
    """Which of the names that a block had dealt are repeated."""
    if not len(names):
        return np.zeros(0, dtype=bool)
    _, where, _, _, edges = _dealt(names, buckets)
    again = np.concatenate([np.unpackbits(np.frombuffer(x["again"], dtype=np.uint8), count=b - a) for x, a, b in zip(answers.as_py(), edges[:-1], edges[1:], strict=True)])
    return again[where] > 0


def repeated_anchors(blocks: DataFrame, buckets: int, made: list[str], frequent: int = FREQUENT) -> tuple[DataFrame, np.ndarray, int]:
    """(doc, version, flags): for documents with any, which of their anchors are repeated with what is behind them, and which with what is before, as packed bits; the sorted names that occur more than `frequent` times; how often these occur in all."""
    first, many = _round(blocks.select("block", "names"), buckets, made, frequent)
    # few: a name for more than `frequent` strings
    often = many.collect()

    def pair(batches):
        for batch in batches:
            for block, docs, names, behind, before, answers in zip(*batch.columns, strict=True):
                names = _names(names)
                again = _answered(names, answers, buckets)
                sides = [np.frombuffer(x.as_py(), dtype="<u2").astype(np.uint64) for x in (behind, before)]
                masks = [again & (x > 0) for x in sides]
                # the side is part of the pair: it says at which offset the second name stands
                pairs = np.concatenate([(names[m] * FACTORS[k] + x[m]) * FACTORS[k + 2] for k, (m, x) in enumerate(zip(masks, sides, strict=True))])
                if len(pairs):
                    pairs ^= pairs >> np.uint64(29)
                    yield _batches_of([[block.as_py()], [docs.as_py()], [np.packbits(masks).tobytes()], [pairs.tobytes()]], [pa.int64(), *[pa.binary()] * 3], ["block", "docs", "masks", "names"])

    left = blocks.join(first, "block").select("block", "docs", "names", "behind", "before", "answers")
    left = cut(left.mapInArrow(pair, "block long, docs binary, masks binary, names binary"), "pairs", made)
    second, _ = _round(left.select("block", "names"), buckets, made)

    def flag(batches):
        for batch in batches:
            for docs, masks, names, answers in zip(*batch.columns, strict=True):
                docs, names = np.frombuffer(docs.as_py(), dtype=DOC), _names(names)
                ends = np.cumsum(docs["anchors"])
                flags = np.unpackbits(np.frombuffer(masks.as_py(), dtype=np.uint8), count=2 * ends[-1])
                flags[flags > 0] = _answered(names, answers, buckets)
                flags = flags.reshape(2, -1).T
                some = [(d["doc"], d["version"], np.packbits(flags[e - d["anchors"] : e]).tobytes()) for d, e in zip(docs, ends, strict=True) if flags[e - d["anchors"] : e].any()]
                if some:
                    yield _batches_of(list(zip(*some, strict=True)), [pa.int64(), pa.int64(), pa.binary()], ["doc", "version", "flags"])

    flagged = left.join(second, "block").select("docs", "masks", "names", "answers").mapInArrow(flag, "doc long, version long, flags binary")
    return flagged, np.sort(np.frombuffer(b"".join(r.often for r in often), dtype="<u8")), sum(r.strings for r in often)


#: name, document, version, first window, anchor - first window, bytes; then the bytes.
HEAD = "<QqqQBB"


def _runs(windows: np.ndarray) -> np.ndarray:
    """The windows' rows with neighbours of a document made one; digests are left out."""
    order = np.lexsort((windows["start"], windows["version"], windows["doc"]))
    spans = windows[order]
    if not len(spans):
        return spans
    new = np.ones(len(spans), dtype=bool)
    new[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["version"][1:] != spans["version"][:-1]) | (spans["start"][1:] > spans["end"][:-1])
    first = np.flatnonzero(new)
    out = spans[first]
    # windows are equally long, so the last one ends last
    out["end"] = spans["end"][np.append(first[1:], len(spans)) - 1]
    out["high"] = out["low"] = 0
    return out


def dealt_strings(documents: DataFrame, flagged: DataFrame, buckets: int, length: int = LENGTH, often: np.ndarray = np.empty(0, np.uint64), wide: int = 0) -> DataFrame:
    """(bucket, strings): strings of repeated anchors to the bucket of their name, packed; names in `often` go as windows to one of `wide` buckets after these, and what a task settles itself goes to as many after those."""
    joined = documents.select("doc", "version", "text").join(flagged.dropDuplicates(["doc", "version"]), ["doc", "version"])

    def emit(held: dict) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        return _batches_of([list(held), [pack(b"".join(x)) for x in held.values()]], [pa.int32(), pa.binary()], ["bucket", "strings"])

    def flush(windows: list, task: int) -> pa.RecordBatch:
        table = np.array(windows, dtype=CHUNK)
        first = _first_of(table)
        again, table = _runs(table[~first]), table[first]
        place = buckets + (table["low"] % np.uint64(wide)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        table, place = table[order], place[order]
        names, edges = np.unique(place, return_index=True)
        held = {int(n): [table[a:b].tobytes()] for n, a, b in zip(names, edges, [*edges[1:], len(table)], strict=True)}
        if len(again):
            held[buckets + wide + task % wide] = [again.tobytes()]
        return emit(held)

    def strings(batches):
        windows: list[tuple] = []
        task = TaskContext.get().partitionId()
        for batch in small_rows(batches):
            held: dict[int, list[bytes]] = {}
            for doc, version, text, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                data = text.as_py()
                (names, _, _, anchor, first, last), _ = anchors(data, length)
                both = np.unpackbits(np.frombuffer(bits.as_py(), dtype=np.uint8), count=2 * len(names)).reshape(-1, 2) > 0
                flags, many = both.any(axis=1), np.isin(names, often)
                # windows whose side of the anchor is unique have left
                reach = (length - GRAM) // 2
                first, last = np.where(both[:, 1], first, np.maximum(first, anchor - reach)), np.where(both[:, 0], last, np.minimum(last, anchor - reach - 1))
                for f, e in zip(first[flags & many].tolist(), last[flags & many].tolist(), strict=True):
                    for at in range(f, e + 1):
                        digest = hashlib.blake2b(data[at : at + length], digest_size=16).digest()
                        windows.append((int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"), doc, version, at, at + length))
                    if len(windows) >= HELD:
                        yield flush(windows, task)
                        windows = []
                kept = np.flatnonzero(flags & ~many)
                spot = ((names >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
                for k, n, a, f, e in zip(spot[kept].tolist(), names[kept].tolist(), anchor[kept].tolist(), first[kept].tolist(), last[kept].tolist(), strict=True):
                    size = e + length - f
                    held.setdefault(k, []).append(struct.pack(HEAD, n, doc, version, f, a - f, size) + data[f : e + length])
            if held:
                yield emit(held)
        if windows:
            yield flush(windows, task)

    return joined.select("doc", "version", "text", "flags").mapInArrow(strings, "bucket int, strings binary")


def repeated_windows(documents: DataFrame, flagged: DataFrame, buckets: int, length: int = LENGTH, often: np.ndarray = np.empty(0, np.uint64), wide: int = 0) -> DataFrame:
    """(doc, version, start, end) that windows with an equal earlier one cover."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        records = []
        unpack = zstandard.ZstdDecompressor().decompress
        if rows["bucket"].iloc[0] >= buckets:
            table = np.frombuffer(b"".join(map(unpack, rows["strings"])), dtype=CHUNK)
            if rows["bucket"].iloc[0] < buckets + wide:
                table = _runs(table[~_first_of(table)])
            return pd.DataFrame({c: table[c].astype("int64") for c in ("doc", "version", "start", "end")})
        for blob in map(unpack, rows["strings"]):
            at = 0
            while at < len(blob):
                name, doc, version, first, offset, size = struct.unpack_from(HEAD, blob, at)
                at += struct.calcsize(HEAD)
                records.append((name, doc, version, first, offset, blob[at : at + size]))
                at += size
        records.sort()
        out: list[tuple[int, int, int, int]] = []
        whole: dict = {}
        windows: dict = {}
        current, distinct = None, []

        def compare():
            """Windows of the first strings of one name, in document order."""
            windows.clear()
            for doc, version, first, offset, data in distinct:
                for i in range(len(data) - length + 1):
                    key = (offset - i, data[i : i + length])
                    here = (doc, version, first + i)
                    if windows.setdefault(key, here) != here:
                        out.append((doc, version, first + i, first + i + length))

        for name, doc, version, first, offset, data in records:
            if name != current:
                if len(distinct) > 1:
                    compare()
                whole.clear()
                current, distinct = name, []
            here = (doc, version, first)
            seen = whole.setdefault((offset, data), here)
            if seen is here:
                distinct.append((doc, version, first, offset, data))
            elif seen != here:
                out.append((doc, version, first, first + len(data)))
        if len(distinct) > 1:
            compare()
        # neighbours of a document become one row
        out.sort()
        kept: list[list[int]] = []
        for doc, version, start, end in out:
            if kept and kept[-1][0] == doc and kept[-1][1] == version and start <= kept[-1][3]:
                kept[-1][3] = max(kept[-1][3], end)
            else:
                kept.append([doc, version, start, end])
        return pd.DataFrame(np.array(kept, dtype=np.int64).reshape(-1, 4), columns=["doc", "version", "start", "end"])

    dealt = dealt_strings(documents, flagged, buckets, length, often, wide)
    return dealt.groupBy("bucket").applyInPandas(settle, SPAN_COLUMNS)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: n_bytes, spans of bytes covered by a string of `length` bytes that starts earlier too, n_removed, n_spans, kept_sha256.

    Earlier: in a document with a smaller id, or before in the same. Strings lie
    inside one document and are judged on the input. A null text is empty; texts
    shorter than `length` stay whole; rows that repeat id and text are one
    document and share its spans; a null id comes after all others; an empty
    table gives no rows; other columns are ignored.
    """
    if not 3 * GRAM - 1 <= length <= GRAM + 100:
        raise ValueError(f"length must be {3 * GRAM - 1} to {GRAM + 100}")
    documents = keyed(docs, id_col, text_col)
    total = text_bytes(documents, "text")
    made: list[str] = []  # tables that only the rounds read
    blocks = cut(_named_blocks(documents, length), "names", made)
    settled = cut(_settled(blocks), "settled")
    flagged, often, strings = repeated_anchors(blocks, buckets_for(total / 4, TASK_BYTES), made, frequent)
    flagged = cut(flagged, "flags")
    discard(docs.sparkSession, made)
    wide = buckets_for(strings * (length - GRAM + 2) / 2 * CHUNK.itemsize, TASK_BYTES)
    found = cut(repeated_windows(documents, flagged, buckets_for(total, TASK_BYTES), length, often, wide), "windows")
    return removed(documents, found.unionByName(settled), with_kept)
