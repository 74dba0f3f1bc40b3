"""Connected components over an edge table, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Every step joins two written
tables, so that a hot vertex is split by the skew join, and every step's result
is written to the shared folder, so that a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    spark = edges.sparkSession
    flip = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # large: all neighbours of u; small: only the smaller ones (a < b in edges)
    near = (edges.unionByName(flip) if large else flip).toDF("u", "v")
    least = materialize(spark, near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    both = near.join(least.hint("merge"), "u")
    if large:
        out = both.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = both.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    done = materialize(spark, out.filter("a < b").distinct(), "star")
    discard(spark, least)
    return done


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).collect()[0]
    return row["n"], row["s"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has long columns a and b. Returns (node, label) for every node
    of an edge with a != b; label is the smallest node of its component."""
    spark = edges.sparkSession
    now = materialize(
        spark,
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = _signature(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = _star(now, True)
        small = _star(large, False)
        discard(spark, now)
        discard(spark, large)
        now, after = small, _signature(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )
