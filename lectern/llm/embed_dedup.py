"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, connected components.

Equal vectors are one node with a weight, and get one string of signs; a table's
key is a stretch of it. What is shuffled per table is the sign string, not the
vector: nodes that share a key meet, and a pair goes on if its strings differ in
so few signs that the cosine may be reached (it fails for 3 in 10^7 pairs at the
threshold). A pair that meets in several tables counts in the first only, which
the strings tell without any exchange. Vectors are then fetched once for each
meeting in which a node has such a pair, and the cosine is verified in double
precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StructField, StructType

from ._shared import cut, small_rows
from .blocks import block_pairs, forest, pair_mask
from .components import components

COSINE, RECALL, BLOCK, SEED = 0.9, 0.9995, 1024, 20240
#: Members that share a key by chance, about; sets the number of signs. Comparing signs is cheap, so that it may be high and the tables few.
CHANCE = 256
#: Signs in a string, at least; standard deviations by which a pair at the threshold may differ in more signs than expected.
LEAST_SIGNS, SPREAD = 128, 5
#: Vector bytes that one task gathers, about.
TASK_BYTES = 24 << 20


def table_plan(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(signs a table, tables): a key's bucket holds about CHANCE unrelated vectors, and a pair at the very threshold is met with probability `recall`."""
    bits = max(4, math.ceil(math.log2(max(2, rows) / CHANCE)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _signs(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Packed sign strings; the first bits * tables signs are the keys'."""
    n = -(-max(LEAST_SIGNS, bits * tables) // 64) * 64
    planes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], n))
    return np.packbits(vectors @ planes > 0, axis=1)


def _keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    part = np.unpackbits(signs, axis=1, count=bits * tables).reshape(len(signs), tables, bits)
    return part @ (1 << np.arange(bits, dtype=np.int64))


def most_differing(signs: int, cosine: float) -> float:
    """Signs in which two vectors at the threshold differ at most, but for a few pairs in ten million."""
    share = math.acos(cosine) / math.pi
    return signs * share + SPREAD * math.sqrt(signs * share * (1 - share))


def _unit(data: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    vectors = np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1).astype(np.float64)
    largest = np.abs(vectors).max(axis=1)
    # squares of these would overflow or vanish; powers of two change no direction
    odd = (largest > 1e100) | (largest < 1e-100)
    vectors[odd] = np.ldexp(vectors[odd], -np.frexp(largest[odd])[1][:, None])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _valid(kind: str):
    """Rows to (id, vector bytes): null where it links with nothing."""

    def run(batches):
        for batch in small_rows(batches):
            out = []
            for v in batch.column(1).to_pylist():
                x = None
                if v and not any(c is None for c in v):
                    x = np.array(v, dtype=kind) + np.array(0, dtype=kind)  # one zero
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, type=pa.binary())], names=["vec_id", "vector"])

    return run


NOTHING = pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64")})


def _pruner(bits: int, tables: int, cosine: float):
    """Of a task's meetings, the members with a pair of their own that the signs let pass; member rows as they came, without vectors."""

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "node"])
        unit, table, side, within = (rows[c].to_numpy() for c in ("unit", "table", "side", "within"))
        lengths = rows["signs"].map(len).to_numpy()
        signs = np.frombuffer(b"".join(rows["signs"]), dtype=np.uint8).reshape(len(rows), lengths[0])
        words, most = signs.view(np.uint64), most_differing(8 * lengths[0], cosine)
        edges = np.flatnonzero(np.diff(unit)) + 1
        goes_on = np.zeros(len(rows), dtype=bool)
        for start, stop in zip([0, *edges], [*edges, len(rows)], strict=True):
            if stop - start < 2:
                continue
            at = slice(start, stop)
            differ = np.zeros((stop - start, stop - start), dtype=np.uint16)
            for w in range(words.shape[1]):
                column = words[at, w]
                differ += np.bitwise_count(column[:, None] ^ column[None, :])
            i, j = np.nonzero((differ <= most) & pair_mask(side[at], bool(within[start])))
            if not len(i):
                continue
            some = np.union1d(i, j)
            keys = np.zeros((stop - start, tables), dtype=np.int64)
            keys[some] = _keys(signs[at][some], bits, tables)
            for part in range(0, len(i), 1 << 18):
                x, y = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
                mine = (keys[x] == keys[y]).argmax(axis=1) == table[start]
                goes_on[start + x[mine]] = goes_on[start + y[mine]] = True
        return rows.loc[goes_on, ["node", "unit", "table", "side", "within", "task"]]

    return prune


def _linker(bits: int, tables: int, cosine: float, kind: str):
    """Links of a task's buckets: a count for each node, and a forest of node pairs."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["node"].to_numpy(), rows["unit"].to_numpy()))
        unit, node, weight, table, side, within = (rows[c].to_numpy()[order] for c in ("unit", "node", "weight", "table", "side", "within"))
        data, signs = rows["vector"].to_numpy()[order], rows["signs"].to_numpy()[order]
        edges = np.flatnonzero(np.diff(unit)) + 1
        counted, low_nodes, high_nodes = [], [], []
        for start, stop in zip([0, *edges], [*edges, len(unit)], strict=True):
            if stop - start < 2:
                continue
            at = slice(start, stop)
            vectors = _unit(list(data[at]), kind)
            near = vectors @ vectors.T >= cosine - 1e-12
            if near.sum() == stop - start:  # only each with itself
                continue
            i, j = np.nonzero(near & pair_mask(side[at], bool(within[start])))
            if not len(i):
                continue
            some = np.union1d(i, j)
            keys = np.zeros((stop - start, tables), dtype=np.int64)
            keys[some] = _keys(np.frombuffer(b"".join(signs[at][some]), dtype=np.uint8).reshape(len(some), -1), bits, tables)
            kept = [np.empty(0, dtype=np.int64)] * 2
            for part in range(0, len(i), 1 << 16):
                x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                mine = ((keys[x] == keys[y]).argmax(axis=1) == table[start]) & ((vectors[x] * vectors[y]).sum(axis=1) >= cosine)
                kept = [np.concatenate([kept[0], x[mine]]), np.concatenate([kept[1], y[mine]])]
            i, j = kept
            if len(i):
                own, w = node[at], weight[at]
                links = np.bincount(i, weights=w[j], minlength=len(own)) + np.bincount(j, weights=w[i], minlength=len(own))
                low, high = forest(i, j, len(own))
                counted.append((own[links > 0], links[links > 0].astype(np.int64)))
                low_nodes.append(own[low])
                high_nodes.append(own[high])
        if not counted:
            return NOTHING
        # one row a node and task: sums of counts, and a forest of the forests
        nodes, place = np.unique(np.concatenate([n for n, _ in counted]), return_inverse=True)
        links = np.bincount(place, weights=np.concatenate([c for _, c in counted])).astype(np.int64)
        low, high = (np.searchsorted(nodes, np.concatenate(x)) for x in (low_nodes, high_nodes))
        low, high = forest(low, high, len(nodes))
        return pd.concat([pd.DataFrame({"node": nodes, "links": links, "other": pd.array([None] * len(nodes), dtype="Int64")}), pd.DataFrame({"node": nodes[low], "links": 0, "other": pd.array(nodes[high], dtype="Int64")})])

    return link


def near_embeddings(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: n_links (other vectors at `cosine` or more), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero, not finite or that hold nulls link with
    nothing and are their own component; equal vectors link with each other;
    vectors of different lengths never link; rows that repeat an id are vectors
    of their own; a null id counts as larger than any; an empty table gives no
    rows; other columns are ignored.
    """
    kind, width = ("<f4", 4) if table.schema[vector_col].dataType.elementType == FloatType() else ("<f8", 8)
    schema = StructType([StructField("vec_id", LongType()), StructField("vector", BinaryType())])
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(_valid(kind), schema)
    rows = cut(rows.withColumn("node", F.xxhash64("vector")), "vectors")
    nodes = cut(rows.where("vector is not null").groupBy("node", "vector").agg(F.count(F.lit(1)).alias("weight")), "nodes")
    total, longest = nodes.agg(F.count(F.lit(1)), F.max(F.length("vector"))).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = table_plan(total, cosine, recall)
    signed_schema = StructType([*nodes.schema.fields, StructField("signs", BinaryType()), StructField("keys", ArrayType(LongType()))])

    def sign(batches):
        for batch in small_rows(batches):
            vectors = batch.column(1).to_pylist()
            signs: list = [None] * len(vectors)
            keys: list = [None] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                own = _signs(_unit([vectors[i] for i in at], kind), bits, tables)
                for i, x, k in zip(at, own, _keys(own, bits, tables) + (int(n) // width << 40), strict=True):
                    signs[i], keys[i] = x.tobytes(), k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64()))], names=["node", "vector", "weight", "signs", "keys"])

    signed = cut(nodes.mapInArrow(sign, signed_schema), "signs")
    members = signed.select("node", "signs", F.posexplode("keys").alias("table", "key"))
    pairs = block_pairs(members, ["table", "key"], "node", block)
    signs = max(LEAST_SIGNS, bits * tables) // 8 + 8
    unit = F.xxhash64("table", "key", "a", "b")
    task = F.pmod("unit", F.lit(max(12, math.ceil(total * tables * (signs + 64) / TASK_BYTES))))
    units = pairs.select("node", "signs", "table", "side", (F.col("a") == F.col("b")).alias("within"), unit.alias("unit")).withColumn("task", task)
    met = "node long, unit long, table int, side int, within boolean, task long"
    met = cut(units.groupBy("task").applyInPandas(_pruner(bits, tables, cosine), met), "met")
    parts = max(12, math.ceil(met.count() * (longest + signs + 64) / TASK_BYTES))
    whole = met.hint("merge").join(signed.select("node", "vector", "weight", "signs"), "node").withColumn("task", F.pmod("unit", F.lit(parts)))
    found = cut(whole.groupBy("task").applyInPandas(_linker(bits, tables, cosine, kind), "node long, links long, other long"), "links")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    joined = rows.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("node")).alias("node")).join(links, "node", "left").join(roots, "node", "left")
    same = nodes.select("node", (F.col("weight") - 1).alias("copies"))
    joined = cut(joined.join(same, "node", "left").withColumn("root", F.coalesce("root", "node")), "joined")
    lowest = joined.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(lowest, "root", "left")
    component = F.coalesce("component_id", "vec_id")
    count = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))
    return out.select("vec_id", count.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
