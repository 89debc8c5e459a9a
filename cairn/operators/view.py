"""Views composed of the graph operators: overview, details, inspection and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.graph import EDGE_COLUMNS, CodeGraph, is_declaration, require_node
from cairn.operators.hierarchy import children_page, parents, subgraph
from cairn.operators.evidence import supporting_facts
from cairn.operators.projection import Projection, subset_support
from cairn.operators.queries import Neighborhood, related_page


def unprojected_imports(graph: CodeGraph, projection: Projection) -> DataFrame:
    """Imports that support no edge of the projection."""
    return projection.unused(graph)


def overview(graph: CodeGraph, projection: Projection) -> CodeGraph:
    """Modules, packages and files without a parent, with the imports that the projection leaves out and their context."""
    owned = parents(graph).select(F.col("child").alias("id"))
    loose = graph.nodes.where("kind = 'FILE'").join(owned, "id", "left_anti")
    ids = graph.nodes.where("kind in ('MODULE', 'PACKAGE')").select("id").union(loose.select("id"))
    return subgraph(graph, ids, unprojected_imports(graph, projection))


def overview_counts(nodes: DataFrame) -> DataFrame:
    """One row: packages, files, declarations."""
    return nodes.agg(F.count_if(F.col("kind") == "PACKAGE").alias("packages"), F.count_if(F.col("kind") == "FILE").alias("files"), F.count_if(is_declaration(F.col("kind"))).alias("declarations"))


def package_detail(graph: CodeGraph, projection: Projection, package: str) -> CodeGraph:
    """A package, its files, every relation that touches them and the facts behind its projected edges."""
    require_node(graph.nodes, package, ("PACKAGE",))
    kind = graph.nodes.where("kind = 'FILE'").select("id")
    files = parents(graph).where(F.col("parent") == package).select(F.col("child").alias("id")).join(kind, "id", "left_semi")
    rest = graph.edges.where("kind <> 'CONTAINS'")
    touching = rest.join(files.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(EDGE_COLUMNS).union(rest.join(files.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(EDGE_COLUMNS))
    facts = projection.support.where((F.col("from_id") == package) | (F.col("to_id") == package)).select(F.col("source_kind"), F.col("source_from"), F.col("source_to"))
    ids = graph.nodes.where(F.col("id") == package).select("id").union(files)
    return subgraph(graph, ids, touching.union(facts).distinct())


def file_detail(graph: CodeGraph, file: str) -> CodeGraph:
    """A file, its declarations and what contains it."""
    require_node(graph.nodes, file, ("FILE",))
    ids = parents(graph).where(F.col("parent") == file).select(F.col("child").alias("id")).union(graph.nodes.where(F.col("id") == file).select("id"))
    return subgraph(graph, ids, graph.edges.where("false"))


def file_symbols(graph: CodeGraph, file: str) -> DataFrame:
    """The declarations directly in a file, by id."""
    require_node(graph.nodes, file, ("FILE",))
    own = parents(graph).where(F.col("parent") == file).select(F.col("child").alias("id"))
    return graph.nodes.where(is_declaration(F.col("kind"))).join(own, "id", "left_semi").orderBy("id")


def inspect_edges(graph: CodeGraph, node_id: str) -> DataFrame:
    """All edges at a node, of any kind, with their direction, by kind, from and to."""
    require_node(graph.nodes, node_id)
    direction = F.when(F.col("from_id") == node_id, "outgoing").otherwise("incoming")
    own = graph.edges.where((F.col("from_id") == node_id) | (F.col("to_id") == node_id)).distinct()
    return own.withColumn("direction", direction).orderBy(*EDGE_COLUMNS)


def inspect_page(graph: CodeGraph, projection: Projection, node_id: str, offset: int = 0) -> dict:
    """A node with its parent and the first or given pages of children, outgoing and incoming neighbours."""
    require_node(graph.nodes, node_id)
    children, n = children_page(graph, node_id, offset)
    outgoing, o = related_page(graph, projection, node_id, False, offset)
    incoming, i = related_page(graph, projection, node_id, True, offset)
    parent = parents(graph).where(F.col("child") == node_id).select("parent")
    return {"node": graph.nodes.where(F.col("id") == node_id), "parent": parent, "children": children, "children_total": n, "outgoing": outgoing, "outgoing_total": o, "incoming": incoming, "incoming_total": i}


def inspect_relations(graph: CodeGraph, node_id: str, listed: DataFrame) -> CodeGraph:
    """The relations but containment between a node and the listed(id) neighbours, with what contains them."""
    require_node(graph.nodes, node_id)
    rest = graph.edges.where("kind <> 'CONTAINS'")
    out = rest.where(F.col("from_id") == node_id).join(listed.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").select(EDGE_COLUMNS)
    back = rest.where(F.col("to_id") == node_id).join(listed.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").select(EDGE_COLUMNS)
    return subgraph(graph, graph.nodes.where(F.col("id") == node_id).select("id"), out.union(back).distinct())


def neighborhood_context(graph: CodeGraph, near: Neighborhood) -> CodeGraph:
    """The nodes of a neighbourhood with all that contains them."""
    return subgraph(graph, near.graph.nodes.select("id"), graph.edges.where("false"))


def relationship_facts(graph: CodeGraph, projection: Projection, edge: tuple[str, str, str], scope: str, offset: int = 0) -> tuple[DataFrame, int, CodeGraph]:
    """(a page of the facts behind a relationship, their number, the page's facts with what contains their ends)."""
    facts, total = supporting_facts(graph, projection, edge, scope, offset)
    return facts, total, subgraph(graph, graph.nodes.where("false").select("id"), facts.select(EDGE_COLUMNS))


def detail(graph: CodeGraph, projection: Projection, evidence: DataFrame, part: CodeGraph) -> dict:
    """A part of a graph with what only the whole can tell: child and file counts of its nodes, the projected edges that its relations support and their whole totals."""
    own = part.nodes.select("id")
    support = subset_support(projection, part.edges)
    kept = support.select("from_id", "to_id").distinct()
    totals = relationship_totals(Projection(projection.graph, projection.support.join(kept, ["from_id", "to_id"], "left_semi")), evidence)
    edges = kept.select(F.lit("IMPORTS").alias("kind"), "from_id", "to_id")
    ends = kept.select(F.col("from_id").alias("id")).union(kept.select("to_id"))
    return {
        "graph": part, "child_counts": child_counts(graph).join(own, "id", "left_semi"), "file_counts": file_counts(graph).join(own, "id", "left_semi"),
        "projection": Projection(CodeGraph(projection.graph.nodes.join(ends, "id", "left_semi"), edges.select(EDGE_COLUMNS)), support), "totals": totals,
    }


def child_counts(graph: CodeGraph) -> DataFrame:
    """(id, children) of every node, zeros included."""
    n = parents(graph).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    return graph.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("children"))


def file_counts(graph: CodeGraph) -> DataFrame:
    """(id, files) of every package: its direct file children, zeros included."""
    files = graph.nodes.where("kind = 'FILE'").select(F.col("id").alias("child"))
    n = parents(graph).join(files, "child", "left_semi").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    return graph.nodes.where("kind = 'PACKAGE'").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("files"))


def relationship_totals(projection: Projection, evidence: DataFrame) -> DataFrame:
    """(relation, total): occurrences behind each projected edge, keyed KIND:from->to, zeros included."""
    n = evidence.groupBy(F.col("edge.kind").alias("source_kind"), F.col("edge.from_id").alias("source_from"), F.col("edge.to_id").alias("source_to")).agg(F.count("*").alias("n"))
    rows = projection.support.join(n, ["source_kind", "source_from", "source_to"], "left").groupBy("from_id", "to_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return rows.select(F.format_string("IMPORTS:%s->%s", "from_id", "to_id").alias("relation"), "total")


def package_related(graph: CodeGraph, projection: Projection, package: str, incoming: bool) -> DataFrame:
    """(id, sources): a package's projected neighbours with their supporting edges, by id."""
    require_node(graph.nodes, package, ("PACKAGE",))
    own, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    return projection.sources().where(F.col(own) == package).select(F.col(other).alias("id"), "sources").orderBy("id")
