"""Pairs inside groups of any size, in blocks.

A group with more than `block` members is dealt into blocks by hash, and a task
gets two blocks at a time, so no group meets in one task whole and no pair
becomes a row: tasks return counts and a spanning forest of what they linked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, group: list[str], node: str, block: int) -> DataFrame:
    """members with columns `a`, `b` (the pair of blocks) and `side`: each member once for every pair that its block is part of.

    Groups of one member are dropped. Blocks are even in expectation.
    """
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = members.join(sizes, group).withColumn("_blocks", F.ceil(F.col("_n") / block))
    own = F.pmod(F.xxhash64(node, F.lit(7)), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    paired = dealt.withColumn("_own", own).select("*", other)
    return paired.select(*members.columns, F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def pair_mask(side: np.ndarray, within: bool) -> np.ndarray:
    """Which (i, j) of a task's members are its own to compare: above the diagonal, and across the blocks unless both are one."""
    mask = np.triu(np.ones((len(side), len(side)), dtype=bool), 1)
    return mask if within else mask & (side[:, None] != side[None, :])


def forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (left[k], right[k]) among n members, enough to keep what they connect: fewer than n."""
    root = np.arange(n)
    while True:  # minima along links and pointer jumps until nothing moves
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]
