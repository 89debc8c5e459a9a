"""Occurrences and canonical facts behind a relationship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.graph import CodeGraph
from cairn.operators.hierarchy import page
from cairn.operators.projection import Projection
from cairn.schema import GraphError


def supporting_edges(graph: CodeGraph, projection: Projection, edge: tuple[str, str, str], scope: str) -> DataFrame:
    """(kind, from_id, to_id): the canonical edges of a relationship; in package scope, those that its projected edge is derived from."""
    kind, a, b = edge
    if scope == "canonical":
        rows = graph.edges.where((F.col("kind") == kind) & (F.col("from_id") == a) & (F.col("to_id") == b)).distinct()
    elif scope == "package":
        own = projection.support.where((F.col("from_id") == a) & (F.col("to_id") == b) & (F.lit(kind) == "IMPORTS"))
        rows = own.select(F.col("source_kind").alias("kind"), F.col("source_from").alias("from_id"), F.col("source_to").alias("to_id")).distinct()
    else:
        raise GraphError("invalid_argument", f"unknown scope {scope}")
    if rows.isEmpty():
        raise GraphError("invalid_argument", "no such relationship")
    return rows


def supporting_facts(graph: CodeGraph, projection: Projection, edge: tuple[str, str, str], scope: str, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of the supporting edges, by from, to and kind."""
    return page(supporting_edges(graph, projection, edge, scope), ["from_id", "to_id", "kind"], offset)


def select_evidence(graph: CodeGraph, projection: Projection, evidence: DataFrame, edge: tuple[str, str, str], scope: str, offset: int = 0, ties: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """A page of the occurrences of the supporting edges, by path, line, column, target and snippet; `ties` are columns that make the order total."""
    facts = supporting_edges(graph, projection, edge, scope).select(F.struct("kind", "from_id", "to_id").alias("edge"))
    rows = evidence.join(facts, "edge", "left_semi")
    return page(rows, ["path", "line", "column", "edge.to_id", "snippet", *ties], offset)


def source_status(evidence: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, status) of paths(path): saved hashes against files(path, content, readable) as they are now.

    unchanged, changed, missing, unreadable, or not_recorded where no occurrence names the path.
    """
    saved = evidence.groupBy("path").agg(F.min("hash").alias("saved"))
    now = files.select("path", F.when(F.col("readable"), F.sha2("content", 256)).alias("now"), "readable")
    rows = paths.select("path").distinct().join(saved, "path", "left").join(now, "path", "left")
    status = F.when(F.col("saved").isNull(), "not_recorded").when(F.col("readable").isNull(), "missing").when(~F.col("readable"), "unreadable").when(F.col("saved") == F.col("now"), "unchanged").otherwise("changed")
    return rows.select("path", status.alias("status"))
