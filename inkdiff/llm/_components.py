"""Connected components of a distributed edge list, by alternating min-label steps with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of edges(a, b): label is the least node that it is connected with.

    Each round links every node's larger neighbours, and then its smaller ones, with its least neighbour (large star and
    small star). The edge list never grows, so no node gathers its neighbours in one task: only minima are aggregated.
    A round's table is removed as soon as the next one is written; the result is written and may be discarded.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = current.union(current.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        past, current = current, materialize(small, "edges")
        discard(past)
        mark = tuple(current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    named = current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(current.select(F.col("b"), F.col("b")).distinct())
    out = materialize(named, "components")
    discard(current)
    return out
