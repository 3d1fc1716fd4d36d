"""Distributed connected components by repeated contraction.

Each round every node moves to the closed neighbour with the smallest
round-salted hash, edges are rewritten to the new names, and loops and repeats
go. Only minima are gathered for a node, never a list of its neighbours, so a
hub with any number of edges costs one partially aggregated row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root): nodes with one root are connected.

    Nodes without edges aren't listed. Loops, repeats and either direction are
    fine, nulls are dropped; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    pairs = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    moves = []
    while not pairs.isEmpty():
        salt = F.lit(len(moves))
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.col("v"), salt).alias("h"), F.col("v").alias("id"))).alias("b"))
        own = F.struct(F.xxhash64(F.col("u"), salt).alias("h"), F.col("u").alias("id"))
        move = cut(best.select(F.col("u").alias("node"), F.least(F.col("b"), own)["id"].alias("to")), "moves")
        moves.append(move)
        a, b = move.toDF("u", "x"), move.toDF("v", "y")
        pairs = pairs.join(a, "u").join(b, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        pairs = cut(pairs, "edges")
    if not moves:
        return spark.createDataFrame([], "node long, root long")
    found = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), "to")
        found = found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
