"""Layers of an import graph: strongly connected components, then longest paths between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges among nodes that have edges both in and out: what is left when all others are taken off, again and again."""
    rest, n = edges, edges.count()
    while n:
        ends = rest.select(F.col("from_id").alias("id")).intersect(rest.select(F.col("to_id").alias("id")))
        kept = cut(rest.join(ends, F.col("from_id") == ends.id, "left_semi").join(ends, F.col("to_id") == ends.id, "left_semi"))
        m = kept.count()
        if m == n:
            return kept
        rest, n = kept, m
    return rest


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes(id) under edges(from_id, to_id): the least id of the strongly connected component.

    Forward-backward colouring, all components at once. Nodes without edges both in and out are
    components of their own and are taken off first. A colour is the least id from which a node can
    be reached, spread until nothing changes; what reaches its colour's root inside the colour is
    the root's component. The rest goes into the next round. Nodes that only edges name count too.
    """
    edges = cut(edges.where("from_id <> to_id").select("from_id", "to_id").distinct())
    nodes = cut(nodes.select("id").union(edges.select("from_id")).union(edges.select("to_id")).distinct())
    rest, done = edges, None
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        colour = cut(rest.select(F.col("from_id").alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            spread = colour.join(rest, colour.id == rest.from_id).select(F.col("to_id").alias("id"), "colour")
            spread = cut(colour.withColumn("own", F.col("colour")).unionByName(spread, allowMissingColumns=True).groupBy("id").agg(F.min("colour").alias("colour"), F.max("own").alias("own")))
            changed = not spread.where("colour < own").isEmpty()
            colour = spread.select("id", "colour")
            if not changed:
                break
        ends = lambda c: colour.select(F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
        inside = cut(rest.join(ends("from_id"), "from_id").join(ends("to_id"), "to_id").where("from_id_colour = to_id_colour").select("from_id", "to_id"))
        found = front = cut(colour.where("id = colour"))
        while True:
            back = front.join(inside, front.id == inside.to_id).select(F.col("from_id").alias("id"), "colour").distinct()
            front = cut(back.join(found.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            found = found.union(front)
        found = cut(found)
        done = found if done is None else done.union(found)
        out = found.select("id")
        rest = cut(rest.join(out, rest.from_id == out.id, "left_anti").join(out, F.col("to_id") == out.id, "left_anti"))
    if done is None:
        return nodes.withColumn("component", F.col("id"))
    return nodes.join(done, "id", "left").select("id", F.coalesce("colour", "id").alias("component"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, layer): a component's layer is the length of the longest path to it from components that nothing outside imports.

    Layers are peeled off the condensation, one round each: what no edge of the rest leads to.
    """
    own = cut(components(nodes, edges))
    a, b = own.select(F.col("id").alias("from_id"), F.col("component").alias("a")), own.select(F.col("id").alias("to_id"), F.col("component").alias("b"))
    rest = cut(edges.select("from_id", "to_id").join(a, "from_id").join(b, "to_id").where("a <> b").select("a", "b").distinct())
    left, level, out = cut(own.select("component").distinct()), 0, []
    while True:
        held = rest.select(F.col("b").alias("component")).distinct()
        out.append(cut(left.join(held, "component", "left_anti").withColumn("layer", F.lit(level))))
        left = cut(left.join(held, "component", "left_semi"))
        if left.isEmpty():
            break
        rest, level = cut(rest.join(left, rest.a == left.component, "left_semi")), level + 1
    found = out[0]
    for part in out[1:]:
        found = found.union(part)
    return own.join(found, "component").select("id", "component", "layer")
