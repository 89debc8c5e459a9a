"""Connected components of an undirected edge list, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every node of edges(u, v): component is the smallest id reachable.

    Alternates two contractions until only stars are left: every node hands its larger neighbours
    to its least neighbour, then every node hands its smaller ones to the least of them. Each
    round is two groupings and two joins over the edges, which shrink to one star for each
    component; hot nodes are only ever grouped by min() and joined, never collected.
    Null ends and loops are left out; without edges there are no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.where("u <> v and u is not null and v is not null")
    e = scratch.table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break  # every node but the stars' least ones has one edge
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        old, e = e, scratch.table(small.where("u <> v").distinct())
        scratch.drop(old)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
