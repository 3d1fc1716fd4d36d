"""Mixing sources to target weights by balanced sampling with the cube method (Deville and Tillé, 2004).

A source's documents all get the same expected number of copies, target over
size. The whole part is taken for sure; the fractional part is an inclusion
probability that the flight phase moves through the null space of two
constraints, documents and tokens, until it is 0 or 1. The flight runs in
blocks of a source side by side; each leaves at most two undecided documents,
which fly again together, block level by block level. Only the last two of a
source land, by the rounding that keeps its tokens nearest the target.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, copies_dealt, cut

WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES, BLOCK, SEED = 1.5, 2.0, 4096, 0
NEAR = 1e-9
#: Rows alike that one task deals to blocks at a time.
ALIKE = 100_000


def word_count(text):
    """Words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> with target: weights repeat over the sources by code point, null last; no target above `most` times its size.

    Resharing an excess by weight until none is above is filling all sources to
    one level per weight; sources reach their cap in the order of cap over
    weight. The windows run over one row per source.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("weight", pick).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if this source and all after it stay below their caps; the first source for which that holds sets it
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    level = capped.withColumn("level", left / heavy).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    found = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"]
    return level.select("source", "source_size", F.coalesce(F.least(found * F.col("weight"), F.col("cap")), F.col("cap"), F.lit(0.0)).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Moves chances along null vectors of (1, size) until at most two lie strictly between 0 and 1; totals of both stay.

    coin: a uniform number in [0, 1) for each document; a move takes the one of
    the document that joined last.
    """
    chance = chance.copy()
    scale = size / max(1.0, float(size.max(initial=0)))
    held: list[int] = []
    for k in range(len(chance)):
        if not NEAR < chance[k] < 1 - NEAR:
            chance[k] = round(chance[k])
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        step = (scale[c] - scale[b], scale[a] - scale[c], scale[b] - scale[a])  # orthogonal to (1, 1, 1) and the sizes
        if max(map(abs, step)) < 1e-12:
            step = (1.0, -1.0, 0.0)
        reach, back = 1e300, 1e300
        for i, d in zip(held, step, strict=True):
            if abs(d) > 1e-15:
                up, down = (1 - chance[i]) / abs(d), chance[i] / abs(d)
                reach, back = min(reach, up if d > 0 else down), min(back, down if d > 0 else up)
        # the chance of each way makes the move a martingale, so each document keeps its expectation
        move = reach if coin[k] < back / (reach + back) else -back
        for i, d in zip(held, step, strict=True):
            chance[i] += move * d
        left = [i for i in held if NEAR < chance[i] < 1 - NEAR]
        for i in held:
            if i not in left:
                chance[i] = round(chance[i])
        held = left
    return chance


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last undecided to 0 or 1, so that their tokens come nearest to what was due; ties to fewer documents."""
    open_ = [i for i in range(len(chance)) if 0 < chance[i] < 1]
    due = float(sum(chance[i] * size[i] for i in open_))
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(int(size[i]) for j, i in enumerate(open_) if m >> j & 1) - due), bin(m).count("1"), m))
    for j, i in enumerate(open_):
        chance[i] = best >> j & 1
    return chance


def _decide(last: bool, seed: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("spot", "ascending"), ("size", "ascending")])
        size = table.column("size").to_numpy().astype(float)
        # coins hang on seed, source, level and block alone, so reruns agree
        name = repr((seed, level, table.column("source")[0].as_py(), table.column("block")[0].as_py())).encode("utf-8", "surrogatepass")
        coin = np.random.default_rng(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little")).random(len(size))
        chance = flight(table.column("chance").to_numpy(), size, coin)
        if last:
            chance = land(chance, size)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: size, its source's size and target, copies (0, 1 or 2 ...) and taken = copies * size.

    A null text has size 0; a null source is a source of its own, last in
    order; sources without words get target 0; an empty table gives no rows;
    other columns are ignored. Rows alike in id, text and source are
    interchangeable, so they are counted before they are dealt to blocks, and
    may swap copies without changing the result. Blocks are set by hashes
    of ids and by counts, so partitions and reruns make no difference; another
    `seed` draws another mix with the same expectations.
    """
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("spot")), "sizes")
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sources, weights, share, most).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cut(targets.withColumn("due", due).withColumn("whole", F.floor(F.col("due") + NEAR)), "targets")
    largest = targets.agg(F.max("n")).first()[0]
    columns = "doc_id", "source", "size", "spot", "chance", "block"
    # per-source facts ride along: sources are few against documents, and the join splits a hot source
    alike = base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("alike"))
    dealt = copies_dealt(alike, "alike", "nth", ALIKE)
    joined = dealt.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chance = F.greatest(F.col("due") - F.col("whole"), F.lit(0.0))
    blocks = F.floor((F.col("n") - 1) / block) + 1
    place = F.when(F.col("nth") == 0, F.xxhash64("spot", F.lit(seed))).otherwise(F.xxhash64("spot", F.lit(seed), "nth"))
    level = joined.select("doc_id", "source", "size", "spot", chance.alias("chance"), F.pmod(place, blocks).alias("block"))
    decided = []
    last = False
    while largest is not None:
        count = (largest - 1) // block + 1
        last = count == 1
        done = cut(level.select(*columns).groupBy("source", "block").applyInArrow(_decide(last, seed, len(decided)), level.schema), "flight")
        if last:
            decided.append(done)
            break
        settled = F.col("chance").isin(0.0, 1.0)
        decided.append(done.where(settled))
        largest = 2 * count
        # all blocks of a source shrink alike: a source with one block was only flown, so it flies again with itself
        level = done.where(~settled).withColumn("block", F.floor(F.col("block") / (block // 2)))
    if not decided:
        return docs.sparkSession.createDataFrame([], base.select("doc_id", "spot", "size", "source", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken")).schema)
    drawn = decided[0]
    for part in decided[1:]:
        drawn = drawn.unionByName(part)
    out = drawn.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    copies = (F.col("whole") + F.round("chance")).cast("long")
    return out.select("doc_id", "spot", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns stay as they are, whatever their names.

    Nulls, empty tables, ties and repeated rows: as in mix(). Rows alike in id,
    text and source are matched one to one, in any order.
    """
    drawn = mix(docs, id_col, text_col, source_col, **options).select("spot", F.col("doc_id").alias("id"), F.col("source").alias("from"), "copies")
    alike = Window.partitionBy("spot", "id", "from").orderBy(F.lit(0))
    drawn = drawn.withColumn("place", F.row_number().over(alike)).where("copies > 0")
    # the row rides in a struct, so that no name of its columns meets one of ours
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.xxhash64(F.col(id_col), F.col(text_col)).alias("spot"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("from"))
    rows = rows.withColumn("place", F.row_number().over(alike)).alias("r")
    same = (F.col("r.spot") == F.col("d.spot")) & F.col("r.id").eqNullSafe(F.col("d.id")) & F.col("r.from").eqNullSafe(F.col("d.from")) & (F.col("r.place") == F.col("d.place"))
    joined = rows.join(drawn.alias("d"), same)
    return joined.select(F.col("r.row").alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("d.copies"))).alias("copy")).select("row.*")
