"""N-gram Jaccard join with Bayesian pruning (after BayesLSH-Lite, Satuluri and Parthasarathy, 2012).

1. Each text becomes its set of word shingles; texts with one set are one node
   with a MinHash signature.
2. Nodes that share a MinHash band are candidates. Signatures, not texts, meet
   by band; every pair of a band has its values compared a few at a time and is
   dropped as soon as the posterior probability of reaching the threshold is
   below `tolerance`. A band with more than `block` nodes isn't compared there:
   all its nodes stay candidates of each other.
3. What candidates connect is a cluster, found by distributed contraction. Texts
   are fetched for clusters only, once for each pair of blocks of their cluster,
   pruned pair by pair in the same way and verified on the shingles themselves.

No pair is ever a row: tasks return counts of links and spanning forests.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ._shared import cut, per_text
from .blocks import block_pairs, forest, pair_mask
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5 values: a pair at 0.8 shares no band with probability 0.00005, one at 0.9 practically never.
BANDS, ROWS = 25, 5
TOLERANCE, STEP = 1e-5, 25
BLOCK = 256
#: Nodes up to which a band is pruned pair by pair on signatures alone.
LARGE_BAND = 512
TASK_BYTES = 16 << 20
CACHED_WORDS = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLY, _ADD = (np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_MULTIPLY = _MULTIPLY | np.uint64(1)
_ADD = _mixed(_ADD)
_HASHES: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    cache = _HASHES
    new = [w for w in set(words) if w not in cache]
    if len(cache) + len(new) > CACHED_WORDS:
        cache.clear()
        new = list(set(words))
    for w in new:
        cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter((cache[w] for w in words), dtype=np.uint64, count=len(words))


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; a shorter text is one run, a blank one has none."""
    hashes = word_hashes(data.split())
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    out = np.full(len(hashes) - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = _mixed(out * MIX + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(out)


def set_name(values: np.ndarray) -> int | None:
    """A 64-bit name of a set of shingles; None of the empty one."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True) if len(values) else None


def minhash(values: np.ndarray) -> np.ndarray:
    """The low halves of BANDS * ROWS minima, in parts so that a long text needs no large matrix."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        part = values[at : at + 1024, None] * _MULTIPLY + _ADD
        best = np.minimum(best, (part ^ (part >> np.uint64(32))).min(axis=0))
    return best.astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band's values."""
    keys = np.arange(BANDS, dtype=np.uint64) * MIX
    for i in range(ROWS):
        keys = _mixed(keys + signatures.reshape(-1, BANDS, ROWS)[:, :, i] * MIX)
    return keys


def least_matches(similarity: float, tolerance: float = TOLERANCE, total: int = BANDS * ROWS) -> list[int]:
    """By number of compared values n: fewer matches than this leave the posterior of similarity >= threshold below tolerance.

    With a uniform prior the posterior after m matches in n is Beta(m+1, n-m+1),
    whose tail above t is the chance of at most m successes in n+1 trials of t.
    """
    out = []
    for n in range(total + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def candidate_pairs(signatures: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, similarity: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) among `allowed` that share a band and survive."""
    keys = band_keys(signatures)
    near = np.zeros(allowed.shape, dtype=bool)
    for band in range(BANDS):
        near |= keys[:, band][:, None] == keys[:, band][None, :]
    return surviving_pairs(signatures, sizes, *np.nonzero(near & allowed), similarity, tolerance)


def surviving_pairs(signatures: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose sizes permit the similarity and whose values, compared STEP at a time, never make it improbable."""
    fits = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[fits], j[fits]
    matches, need = np.zeros(len(i), dtype=np.int64), least_matches(similarity, tolerance)
    for at in range(0, BANDS * ROWS, STEP):
        for part in range(0, len(i), 1 << 15):
            k = slice(part, part + (1 << 15))
            matches[k] += (signatures[i[k], at : at + STEP] == signatures[j[k], at : at + STEP]).sum(axis=1)
        alive = matches >= need[min(at + STEP, BANDS * ROWS)]
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def verified_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose Jaccard similarity on the shingles is `similarity` or more."""
    sizes = np.array([len(s) for s in sets])
    if not len(i):
        return i, j
    # common shingles of all pairs at once: products of presence columns, a slice of the vocabulary at a time
    used = np.union1d(i, j)
    values, counts = np.unique(np.concatenate([sets[k] for k in used]), return_counts=True)
    values = values[counts > 1]
    row = np.zeros(len(sets), dtype=np.int64)
    row[used] = np.arange(len(used))
    places = []
    for k in used:
        spot = np.searchsorted(values, sets[k])
        spot[spot == len(values)] = 0
        places.append(np.sort(spot[values[spot] == sets[k]]) if len(values) else spot[:0])
    common, width = np.zeros((len(used), len(used)), dtype=np.float64), 8192
    for at in range(0, len(values), width):
        present = np.zeros((len(used), min(width, len(values) - at)), dtype=np.float32)
        for r, spots in enumerate(places):
            lo, hi = np.searchsorted(spots, [at, at + width])
            present[r, spots[lo:hi] - at] = 1
        common += present @ present.T
    shared = common[row[i], row[j]]
    close = shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[close], j[close]


def _signatures(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype="<u4").reshape(-1, BANDS * ROWS)


def _pruner(similarity: float):
    """(key, node, n_shingles, signature) rows of some bands -> (u, v): a forest of the pairs that survive."""

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "node"])
        node, sizes, signatures = rows["node"].to_numpy(), rows["n_shingles"].to_numpy(), _signatures(rows["signature"])
        edges = np.flatnonzero(np.diff(rows["key"].to_numpy())) + 1
        names, place = np.unique(node, return_inverse=True)
        root = np.empty((2, 0), dtype=np.int64)
        held, waiting, shapes = [], 0, {}

        def flush() -> np.ndarray:
            """The forest so far and the survivors of the waiting pairs, as one forest."""
            i, j = np.concatenate(held, axis=1) if held else np.empty((2, 0), dtype=np.int64)
            i, j = surviving_pairs(signatures, sizes, i, j, similarity)
            return np.stack(forest(np.append(root[0], place[i]), np.append(root[1], place[j]), len(names)))

        for start, stop in zip([0, *edges], [*edges, len(node)], strict=True):
            n = stop - start
            if n not in shapes:
                shapes[n] = np.stack(np.triu_indices(n, 1))
            held.append(shapes[n] + start)
            waiting += held[-1].shape[1]
            if waiting > 1 << 18:
                root = flush()
                held, waiting = [], 0
        low, high = flush()
        return pd.DataFrame({"u": names[low], "v": names[high]})

    return prune


def _linker(words: int, similarity: float):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        counted = {}
        pairs = []
        for (_cluster, a, b), part in rows.groupby(["cluster", "a", "b"], sort=False):
            # rows may repeat: each node counts once
            part = part.drop_duplicates("node").sort_values("node")
            if len(part) < 2:
                continue
            node, weight = part["node"].to_numpy(), part["weight"].to_numpy()
            i, j = candidate_pairs(_signatures(part["signature"]), part["n_shingles"].to_numpy(), pair_mask(part["side"].to_numpy(), a == b), similarity)
            if not len(i):
                continue
            used = np.union1d(i, j)
            sets = [np.empty(0, dtype=np.uint64)] * len(part)
            for k in used:
                sets[k] = shingles((part["text"].iloc[k] or "").encode("utf-8", "surrogatepass"), words)
            i, j = verified_pairs(sets, i, j, similarity)
            for x, y in ((i, j), (j, i)):
                links = np.bincount(x, weights=weight[y], minlength=len(node)).astype(np.int64)
                for k in np.flatnonzero(links):
                    counted[node[k]] = counted.get(node[k], 0) + int(links[k])
            low, high = forest(i, j, len(node))
            pairs += zip(node[low].tolist(), node[high].tolist(), strict=True)
        out = [(n, c, None) for n, c in counted.items()] + [(a, 0, b) for a, b in pairs]
        return pd.DataFrame({"node": pd.Series([x[0] for x in out], dtype="int64"), "links": pd.Series([x[1] for x in out], dtype="int64"), "other": pd.Series([x[2] for x in out], dtype="Int64")})

    return link


def candidates(nodes: DataFrame, similarity: float, block: int) -> DataFrame:
    """(node, n_shingles, signature) -> (u, v) pairs that connect whatever may be similar."""
    width = 4 * ROWS
    keys = F.posexplode(F.array(*[F.xxhash64(F.substring("signature", band * width + 1, width), F.lit(band)) for band in range(BANDS)])).alias("band", "key")
    banded = nodes.select("node", keys).select("node", "key")
    shared = cut(banded.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    members = cut(banded.join(shared, "key"), "banded")
    large = members.where((F.col("n") > block) & (F.col("node") != F.col("leader"))).select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    small = members.where(F.col("n") <= block)
    tasks = max(12, math.ceil(small.count() * (BANDS * ROWS * 4 + 100) / TASK_BYTES))
    met = small.select("key", "node").hint("merge").join(nodes.select("node", "n_shingles", "signature"), "node").withColumn("task", F.pmod("key", F.lit(tasks)))
    return large.unionByName(met.groupBy("task").applyInPandas(_pruner(similarity), "u long, v long"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per document: class_id (smallest id its links reach), n_links (other documents linked directly), kept (first of its class), node.

    Texts with equal shingle sets are linked at similarity 1; kept is true for
    the smallest id, then hash of the text (`version`), and for rows that repeat
    it. Texts without a word, null
    and empty ones included, link with nothing; a text of fewer than `words`
    words is one shingle; words are case-sensitive runs without white space; a
    null id is larger than any; an empty table gives no rows; other columns are
    ignored.
    """

    def make():
        def sketch(data: bytes) -> tuple:
            found = shingles(data, words)
            if not len(found):
                return None, 0, None
            return set_name(found), len(found), minhash(found).astype("<u4").tobytes()

        return sketch

    fields = [("node", LongType()), ("n_shingles", LongType()), ("signature", BinaryType())]
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("version"))
    sketches = cut(per_text(named, {"doc_id": "doc_id", "version": "version"}, "text", fields, make), "sketches")
    nodes = cut(sketches.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "version")).alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature")), "nodes")
    clusters = components(candidates(nodes, similarity, max(block, LARGE_BAND))).select("node", F.col("root").alias("cluster"))
    members = nodes.select("node", "rep", "weight", "n_shingles", "signature").join(clusters, "node")
    units = cut(block_pairs(members, ["cluster"], "node", block), "units")
    held = units.agg(F.sum(F.col("n_shingles") * 8 + BANDS * ROWS * 4 + 100)).first()[0] or 0
    task = F.pmod(F.xxhash64("cluster", "a", "b"), F.lit(max(12, math.ceil(held / TASK_BYTES))))
    same = units["rep"]["version"].eqNullSafe(named["version"]) & units["rep"]["doc_id"].eqNullSafe(named["doc_id"])
    # always shuffled: the units grow with the data, so their broadcast must not be a matter of size
    texts = units.hint("merge").join(named, same).select("cluster", "a", "b", "side", "node", "weight", "n_shingles", "signature", "text", task.alias("task"))
    found = cut(texts.groupBy("task").applyInPandas(_linker(words, similarity), "node long, links long, other long"), "links")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    facts = nodes.select("node", "rep", (F.col("weight") - 1).alias("copies")).join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    facts = cut(facts, "facts")
    lowest = facts.groupBy("root").agg(F.min("rep").alias("first"))
    facts = facts.join(lowest, "root").select("node", "first", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketches.select("doc_id", "version", "node", "n_shingles").join(facts, "node", "left")
    alone = F.col("first").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("first")["doc_id"])
    kept = alone | (F.col("first")["doc_id"].eqNullSafe(F.col("doc_id")) & F.col("first")["version"].eqNullSafe(F.col("version")))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"), "n_shingles", "version")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class: the smallest id, of several texts under it the smallest hash, of repeated rows any one.

    Columns stay as they are, whatever their names. Texts without a word, null
    ones included, are classes of their own; an empty table stays empty.
    """
    kept = jaccard_join(docs, id_col, text_col, **options).where("kept").select("doc_id", "version").distinct().alias("k")
    # the row rides in a struct, so that no name of its columns meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version")).alias("r")
    joined = rows.join(kept, F.col("r.id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.version") == F.col("k.version")))
    return joined.select("r.row", "r.id", "r.version").dropDuplicates(["id", "version"]).select("row.*")
