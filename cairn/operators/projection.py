"""The package graph derived from file imports, with the imports that support each of its edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.graph import EDGE_COLUMNS, CodeGraph
from cairn.operators.hierarchy import parents, validate
from cairn.session import stored


@dataclass(frozen=True)
class Projection:
    """graph: all packages and the derived edges; support(from_id, to_id, source_kind, source_from, source_to): one row for each supporting edge.

    lifted, if there, has the same rows and one with a null end for each import of the graph `of` that derives nothing.
    """

    graph: CodeGraph
    support: DataFrame
    of: CodeGraph | None = None
    lifted: DataFrame | None = None

    def held(self) -> Projection:
        """The same with its support, and what supports nothing, in one table."""
        if self.lifted is None:
            return Projection(self.graph, stored(self.support))
        lifted = stored(self.lifted)
        return Projection(self.graph, _support(lifted), self.of, lifted)

    def unused(self, graph: CodeGraph) -> DataFrame:
        """(kind, from_id, to_id): the imports of a graph that support no edge."""
        source = [F.col("source_kind").alias("kind"), F.col("source_from").alias("from_id"), F.col("source_to").alias("to_id")]
        if self.of is graph:
            return self.lifted.where("from_id is null or to_id is null").select(*source)
        return graph.imports().select(EDGE_COLUMNS).distinct().join(self.support.select(*source), EDGE_COLUMNS, "left_anti")

    def sources(self) -> DataFrame:
        """(from_id, to_id, sources): the supporting edges of each derived one, by from and to."""
        source = F.struct(F.col("source_from").alias("from_id"), F.col("source_to").alias("to_id"), F.col("source_kind").alias("kind"))
        return self.support.groupBy("from_id", "to_id").agg(F.sort_array(F.collect_set(source)).alias("sources"))


def project_packages(graph: CodeGraph, check: bool = False) -> Projection:
    """Imports of files whose parent is a package, lifted to packages.

    With check, a graph that breaks containment is refused first, at the cost of a pass for each
    level (a saved snapshot has been checked).

    A package target stays; a file target counts only in Python and stands for its package. Other
    imports derive nothing. Edges of a package to itself stay.
    """
    if check:
        validate(graph)
    kind = graph.nodes.select("id", "kind", "language")
    package = kind.where("kind = 'PACKAGE'").select("id")
    owner = parents(graph).join(package, F.col("parent") == package.id, "left_semi")
    files = kind.where("kind = 'FILE'")
    source = files.select("id").join(owner, F.col("id") == owner.child).select(F.col("id").alias("from_file"), F.col("parent").alias("from_id"))
    python = files.where("language = 'python'").select("id").join(owner, F.col("id") == owner.child).select("id", F.col("parent").alias("to_package"))
    target = package.select("id", F.col("id").alias("to_package")).union(python)
    lifted = (
        graph.imports()
        .select(F.col("kind").alias("source_kind"), F.col("from_id").alias("source_from"), F.col("to_id").alias("source_to"))
        .repartition("source_from")  # serves the next two
        .distinct()
        .join(source, F.col("source_from") == source.from_file, "left")
        .join(target, F.col("source_to") == target.id, "left")
        .select("from_id", F.col("to_package").alias("to_id"), "source_kind", "source_from", "source_to")
    )
    derived = _support(lifted)
    edges = derived.select(F.lit("IMPORTS").alias("kind"), "from_id", "to_id").distinct()
    return Projection(CodeGraph(graph.nodes.where("kind = 'PACKAGE'"), edges.select(EDGE_COLUMNS)), derived, graph, lifted)


def _support(lifted: DataFrame) -> DataFrame:
    return lifted.where("from_id is not null and to_id is not null")


def subset_support(projection: Projection, edges: DataFrame) -> DataFrame:
    """The support rows whose source is one of the edges."""
    e = edges.select(F.col("kind").alias("source_kind"), F.col("from_id").alias("source_from"), F.col("to_id").alias("source_to"))
    return projection.support.join(e, ["source_kind", "source_from", "source_to"], "left_semi")
