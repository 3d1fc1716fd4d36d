"""Jump consistent hashing (Lamping and Veach, 2014) as one column expression.

Native throughout: the 64-bit linear congruential step is done on two 32-bit
halves, so nothing overflows under ANSI arithmetic, and the jumps are a fold
over a constant sequence, which ends after at most `shards` steps because each
jump lands on a larger shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import copies_dealt, cut

#: The multiplier of the generator in the paper, and its four 16-bit digits from the lowest.
MULTIPLIER = 2862933555777941757
DIGITS = [MULTIPLIER >> (16 * i) & 0xFFFF for i in range(4)]
LOW = 0xFFFFFFFF
#: Rows numbered by one task of the slot window.
ROWS_PER_RANGE = 100_000


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) of key * MULTIPLIER + 1 modulo 2**64."""
    m0, m1, m2, m3 = (F.lit(d).cast("long") for d in DIGITS)
    bottom = low * m0 + F.shiftleft((low * m1).bitwiseAND(0xFFFF), 16) + F.lit(1)
    top = (
        F.shiftright(bottom, 32) + F.shiftright(low * m1, 16) + low * m2
        + F.shiftleft((low * m3).bitwiseAND(0xFFFF), 16) + high * m0 + F.shiftleft((high * m1).bitwiseAND(0xFFFF), 16)
    )
    return top.bitwiseAND(LOW), bottom.bitwiseAND(LOW)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to shards-1 of a 64-bit key; one more shard moves keys only into the new one."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = key.cast("long")
    state = lambda high, low, shard, jump: F.struct(high.alias("high"), low.alias("low"), shard.alias("shard"), jump.alias("jump"))

    def fold(s: Column, _: Column) -> Column:
        high, low = _step(s["high"], s["low"])
        jump = F.floor((s["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(s["jump"] >= shards, s).otherwise(state(high, low, s["jump"], jump))

    zero = F.lit(0).cast("long")
    start = state(F.shiftrightunsigned(key, 32), key.bitwiseAND(LOW), zero, zero)
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, fold, lambda s: s["shard"].cast("int"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """One row per document: its shard by the law `key`, its slot there, and its shard once one more is appended.

    The key is a whole-number id itself (the jump hash's generator spreads even
    neighbouring ones) and xxhash64 of any other id, so rows with one id share a
    shard whatever their texts. A null id is a key like any other (-1); a null text has
    size 1 and the CRC of no bytes; an empty table gives no rows; other columns
    are ignored. Slots of a shard are gapless: rows are numbered inside ranges
    of the shard (by another hash) in parallel and shifted by the rows of the
    ranges before. Rows alike in id, CRC and size are interchangeable, so they
    are counted before the shuffle and dealt out again afterwards.
    """
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)) if whole else F.xxhash64(F.col(id_col))
    spread = max(1, docs.count() // (shards * ROWS_PER_RANGE) + 1)
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(spread)).alias("range"),
    )
    # written once: ranges, places and both kinds of groups are read from it
    alike = cut(placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("n")), "alike")
    counts = alike.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("place", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "range"])
    return copies_dealt(numbered, "n", "copy", ROWS_PER_RANGE).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("place") + F.col("skip") + F.col("copy")).cast("long").alias("slot"), "grown_shard"
    )
