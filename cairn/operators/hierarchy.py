"""Containment: parents, children, ancestors and the rules they obey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.graph import EDGE_COLUMNS, CodeGraph, require_node
from cairn.schema import LEGAL_CONTAINMENT, PAGE, GraphError
from cairn.session import stored


def parents(graph: CodeGraph) -> DataFrame:
    """(child, parent): the distinct containment pairs."""
    return graph.contains().select(F.col("to_id").alias("child"), F.col("from_id").alias("parent")).distinct()


def violations(graph: CodeGraph) -> DataFrame:
    """(rule, id): nodes that break containment; every rule is one set-wise test."""
    pair = stored(parents(graph))
    kind = graph.nodes.select("id", "kind")
    typed = pair.join(kind.select(F.col("id").alias("parent"), F.col("kind").alias("pk")), "parent", "left").join(kind.select(F.col("id").alias("child"), F.col("kind").alias("ck")), "child", "left")
    legal = F.concat_ws(">", "pk", "ck").isin(*(f"{p}>{c}" for p, c in LEGAL_CONTAINMENT))
    missing = typed.where("pk is null or ck is null").select(F.lit("missing node").alias("rule"), F.col("child").alias("id"))
    illegal = typed.where(F.col("pk").isNotNull() & F.col("ck").isNotNull() & ~legal).select(F.lit("invalid containment"), "child")
    many = pair.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("multiple containment parents"), "child")
    return missing.union(illegal).union(many).union(cycles(pair).select(F.lit("containment cycle"), "id")).distinct()


def cycles(pair: DataFrame) -> DataFrame:
    """(id): nodes on or above a cycle, left when children without children of their own are peeled off."""
    rest = pair
    while True:
        kept = stored(rest.join(rest.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"))
        if kept.count() == rest.count():
            return kept.select(F.col("child").alias("id")).distinct()
        rest = kept


def validate(graph: CodeGraph) -> None:
    if row := violations(graph).first():
        raise GraphError("invalid_graph", f"{row.rule}: {row.id}")


def children(graph: CodeGraph, node_id: str) -> DataFrame:
    """(id) of the node's children, by id."""
    return parents(graph).where(F.col("parent") == node_id).select(F.col("child").alias("id")).orderBy("id")


def page(rows: DataFrame, order: list, offset: int) -> tuple[DataFrame, int]:
    """(a page of PAGE rows, the number of all rows); the number holds for empty pages too."""
    if offset < 0:
        raise GraphError("bad_request", "offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(PAGE), rows.count()


def children_page(graph: CodeGraph, node_id: str, offset: int) -> tuple[DataFrame, int]:
    """A page of the node's children as nodes, by path and id; unknown ids are refused."""
    require_node(graph.nodes, node_id)
    own = parents(graph).where(F.col("parent") == node_id).select(F.col("child").alias("id"))
    return page(graph.nodes.join(own, "id", "left_semi"), ["path", "id"], offset)


def ancestors(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """(id): the ids and all that contain them; as many rounds as containment is deep."""
    pair = stored(parents(graph))  # read at every level
    found = front = stored(ids.select("id").distinct())
    while True:
        front = front.join(pair, front.id == pair.child).select(F.col("parent").alias("id")).distinct().join(found, "id", "left_anti")
        front = stored(front)
        if front.isEmpty():
            return found
        found = found.union(front)


def subgraph(graph: CodeGraph, ids: DataFrame, relations: DataFrame) -> CodeGraph:
    """The ids, the relations' ends and all ancestors, with the relations and the containment among them."""
    relations = stored(relations.select(EDGE_COLUMNS))
    ends = relations.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    inside = stored(ancestors(graph, ids.select("id").union(ends)))
    held = graph.contains().join(inside, graph.edges.from_id == inside.id, "left_semi").join(inside, F.col("to_id") == inside.id, "left_semi")
    return CodeGraph(graph.nodes.join(inside, "id", "left_semi"), relations.union(held.select(EDGE_COLUMNS)).distinct())
