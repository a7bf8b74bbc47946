"""Connected components of an edge table by alternating large-star and small-star contraction.

Every step is a partial-aggregated minimum per vertex, written, and a join back to the edges: broadcast where the vertices are counted
to be few, else a join of two exchanges, in which the planner splits the edges of a hub. No adjacency list is ever gathered. Each round is written to the shared scratch folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Gives one row per vertex that has an edge to another: vertex, root (its component's smallest)."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(sized(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(sized(low), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct())
        last, seen = seen, _digest(now)
        if last == seen:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("vertex"), "root")
    return roots.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
