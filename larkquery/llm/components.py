"""Connected components by alternating large-star and small-star steps; the edges stay in DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as u > v; each u sends its neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


#: Edges in one written file of a round.
FILE_EDGES = 500_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs, any direction -> (node, component) for every node with an edge; component: its least node.

    Loops and repeated edges change nothing; null ends are ignored.  Every round is written to the shared folder, where the last one stays.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = write_shared(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(high, low), "edges")
    seen = None
    for _ in range(most_rounds):
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign["n"] == 0 or sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = sign
        stars = _small_star(_large_star(now).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        before, now = now, write_shared(stars, "edges", files=-(-sign["n"] // FILE_EDGES))
        drop_shared(before)
    raise RuntimeError("components did not settle")
