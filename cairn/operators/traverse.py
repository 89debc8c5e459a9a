"""Breadth-first traversal of imports from many sources at once: distances, least shortest paths, impact.

Each level is one join of the frontier with the edges and one anti-join with what was seen;
its rows are checkpointed, so a level's plan does not hold those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.graph import CodeGraph, require_node
from cairn.session import cut


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, distance, path): for every node reached, the least id sequence among the shortest; sources reach themselves at 0.

    edges(from_id, to_id); sources(id).
    """
    step = cut(edges.select("from_id", "to_id").distinct())
    seen = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance"), F.array("id").alias("path")).distinct()
    seen = front = cut(seen)
    while True:
        reached = front.join(step, front.id == step.from_id).select("source", F.col("to_id").alias("id"), F.col("distance") + 1, F.concat("path", F.array("to_id")).alias("path"))
        # of the paths to one node in a level the least: its prefix is the least of the level before
        reached = reached.toDF("source", "id", "distance", "path").groupBy("source", "id").agg(F.min("distance").alias("distance"), F.min("path").alias("path"))
        front = cut(reached.join(seen, ["source", "id"], "left_anti").select("source", "id", "distance", "path"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, distance): least number of edges; sources reach themselves at 0."""
    step = cut(edges.select("from_id", "to_id").distinct())
    seen = front = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct())
    level = 0
    while True:
        level += 1
        reached = front.join(step, front.id == step.from_id).select("source", F.col("to_id").alias("id")).distinct()
        front = cut(reached.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(level).alias("distance")))
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def least_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, path): for every connected one of pairs(pair, from_id, to_id), the least id sequence among its shortest paths.

    Searched from both ends: in each round a pair's smaller frontier grows by one level, and a pair
    is done at the level where its frontiers meet. The path is then followed from the start, by
    the least node that still leads to the other end in the steps left.
    """
    step = cut(edges.select("from_id", "to_id").distinct())
    pairs = cut(pairs.select("pair", "from_id", "to_id").distinct())
    ends = pairs.select("pair", F.lit(0).alias("side"), F.col("from_id").alias("id")).union(pairs.select("pair", F.lit(1), "to_id"))
    seen = front = cut(ends.withColumn("level", F.lit(0)))
    met = cut(pairs.where("from_id = to_id").select("pair", F.lit(0).alias("forward"), F.lit(0).alias("backward")))
    while True:
        front = front.join(met.select("pair"), "pair", "left_anti")
        sizes = front.groupBy("pair").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
        # a pair with an end that leads no further is not connected
        grows = sizes.where("a > 0 and b > 0").select("pair", F.when(F.col("a") <= F.col("b"), 0).otherwise(1).alias("grows"))
        front = cut(front.join(grows, "pair"))
        out = front.where("side = 0 and grows = 0").join(step, F.col("id") == step.from_id).select("pair", "side", F.col("to_id").alias("id"), "level")
        back = front.where("side = 1 and grows = 1").join(step, F.col("id") == step.to_id).select("pair", "side", F.col("from_id").alias("id"), "level")
        grown = out.union(back).distinct().join(seen.select("pair", "side", "id"), ["pair", "side", "id"], "left_anti")
        grown = cut(grown.select("pair", "side", "id", (F.col("level") + 1).alias("level")))
        if grown.isEmpty():
            break
        other = seen.select("pair", (1 - F.col("side")).alias("side"), "id", F.col("level").alias("there"))
        levels = lambda k: F.max(F.when(F.col("side") == k, F.col("level")).otherwise(F.col("there")))
        found = grown.join(other, ["pair", "side", "id"]).groupBy("pair").agg(levels(0).alias("forward"), levels(1).alias("backward"))
        met = cut(met.union(found))
        seen = seen.union(grown)
        front = front.where("side <> grows").select("pair", "side", "id", "level").union(grown)
    return _follow(step, pairs, seen, met)


def _follow(step: DataFrame, pairs: DataFrame, seen: DataFrame, met: DataFrame) -> DataFrame:
    """(pair, path) of the pairs that met, from the levels seen at both ends."""
    ends = met.join(pairs, "pair")
    most = ends.agg(F.max("forward").alias("f"), F.max(F.col("forward") + F.col("backward")).alias("d")).first()
    if most.d is None:
        return ends.select("pair", F.array("from_id").alias("path"))
    levels = seen.join(met, "pair")
    back = levels.where("side = 1 and level <= backward").select("pair", "id", (F.col("forward") + F.col("backward") - F.col("level")).alias("at"))
    ahead = levels.where("side = 0 and level <= forward").select("pair", "id", F.col("level").alias("at"))
    # what was seen from the start counts where it leads to the meeting level
    middle = cut(back.join(met, "pair").where("at = forward").select("pair", "id", "at").join(ahead, ["pair", "id", "at"], "left_semi"))
    useful, last = middle, middle
    for at in range(most.f - 1, -1, -1):
        before = last.union(middle).where(F.col("at") == at + 1).distinct().join(step, F.col("id") == step.to_id).select("pair", F.col("from_id").alias("id"), F.lit(at).alias("at"))
        last = cut(before.distinct().join(ahead, ["pair", "id", "at"], "left_semi"))
        useful = useful.union(last)
    useful = cut(useful.union(back.join(met, "pair").where("at > forward").select("pair", "id", "at")).distinct())
    paths = cut(ends.select("pair", F.col("from_id").alias("id"), F.array("from_id").alias("path"), (F.col("forward") + F.col("backward")).alias("d")))
    for at in range(1, most.d + 1):
        going = paths.where(F.col("d") >= at).join(step, F.col("id") == step.from_id).select("pair", F.col("to_id").alias("id"), F.lit(at).alias("at"))
        least = going.join(useful, ["pair", "id", "at"], "left_semi").groupBy("pair").agg(F.min("id").alias("to"))
        more = F.when(F.col("to").isNotNull(), F.array_append("path", F.col("to"))).otherwise(F.col("path"))
        paths = cut(paths.join(least, "pair", "left").select("pair", F.coalesce("to", "id").alias("id"), more.alias("path"), "d"))
    return paths.select("pair", "path")


def path(graph: CodeGraph, from_id: str, to_id: str) -> list[str] | None:
    """The least shortest import path, or None; both ends must be nodes."""
    for node in (from_id, to_id):
        require_node(graph.nodes, node)
    pair = graph.nodes.where(F.col("id") == from_id).select(F.lit(0).alias("pair"), F.lit(from_id).alias("from_id"), F.lit(to_id).alias("to_id"))
    row = least_paths(graph.imports(), pair).select("path").first()
    return row.path if row else None


def impact_distances(graph: CodeGraph, targets: DataFrame) -> DataFrame:
    """(target, id, distance): what depends on each target by imports, directly or not; the target itself excluded."""
    back = graph.imports().select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return distances(back, targets).where("distance > 0").select(F.col("source").alias("target"), "id", "distance")


def impact(graph: CodeGraph, target: str) -> tuple[DataFrame, CodeGraph]:
    """(affected: id and distance, by distance and id; the imports among the affected and the target)."""
    require_node(graph.nodes, target)
    start = graph.nodes.where(F.col("id") == target).select("id")
    affected = impact_distances(graph, start).select("id", "distance")
    inside = affected.select("id").union(start)
    edges = graph.imports().join(inside.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(inside.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return affected.orderBy("distance", "id"), CodeGraph(graph.nodes.join(inside, "id", "left_semi"), edges.select("kind", "from_id", "to_id").distinct())
