"""The tools of a saved snapshot: strict arguments, error codes, plain results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.graph import CodeGraph
from cairn.operators import evidence, queries, traverse, view
from cairn.operators.hierarchy import page
from cairn.operators.projection import project_packages
from cairn.schema import GraphError
from cairn.session import cut
from cairn.sources.repository import current_files
from cairn.sources.store import SnapshotStore


class Snapshot:
    """One published scan; every tool reads it alone, whatever is saved later."""

    def __init__(self, store: SnapshotStore, scan: str):
        self.scan, self.index, self.texts, self.store = scan, store.view(scan), store.search(scan), store
        graph, self.parts = store.load(scan)
        self.graph = CodeGraph(cut(graph.nodes), cut(graph.edges))
        projection = project_packages(self.graph)
        self.projection = type(projection)(CodeGraph(cut(projection.graph.nodes), cut(projection.graph.edges)), cut(projection.support))

    def call(self, tool: str, arguments: dict, pinned: str | None = None) -> dict:
        """A tool's result, or {"error": {"code", "message"}}; unknown and mistyped arguments, and callers pinned to another snapshot, are refused."""
        try:
            if pinned is not None and pinned != self.scan:
                raise GraphError("snapshot_changed", f"this is snapshot {self.scan}")
            if tool not in TOOLS:
                raise GraphError("route_not_found", f"no tool {tool}")
            run, types = TOOLS[tool]
            for name, value in arguments.items():
                if name not in types or not isinstance(value, types[name][0]) or isinstance(value, bool) is not (types[name][0] is bool):
                    raise GraphError("invalid_argument", f"argument {name}")
            if missing := [n for n, (_, needed) in types.items() if needed and not arguments.get(n)]:
                raise GraphError("invalid_argument", f"missing {missing}")
            return run(self, **arguments)
        except GraphError as e:
            return {"error": {"code": e.code, "message": str(e)}}

    def scoped(self, scope: str) -> CodeGraph:
        if scope not in ("canonical", "package"):
            raise GraphError("invalid_argument", f"unknown scope {scope}")
        return self.graph if scope == "canonical" else self.projection.graph


def _dicts(df) -> list[dict]:
    """Rows of a page, of a stated limit or around one node."""
    return [r.asDict(True) for r in df.collect()]


def _page(s, name, node_id, page, offset):
    """A page of a node's relation from the stored index."""
    rows, total = page(node_id, offset=offset)
    return {name: _dicts(rows), "total": total, "offset": offset}


def _children(s, node_id, offset=0):
    return _page(s, "children", node_id, s.index.children_page, offset)


def _neighbours(s, node_id, incoming=False, offset=0):
    return _page(s, "nodes", node_id, lambda i, offset: s.index.related_page(i, incoming, offset), offset)


def _graph(g):
    """A part of the graph: nodes without the counts that are not known, and edges, each in order."""
    nodes = [{k: v for k, v in n.items() if v is not None} for n in _dicts(g.nodes.orderBy("id"))]
    return {"nodes": nodes, "edges": _dicts(g.edges.orderBy("kind", "from_id", "to_id"))}


def _overview(s):
    return _graph(view.overview(s.graph, s.projection))


def _package(s, package_id):
    return _graph(view.package_detail(s.graph, s.projection, package_id))


def _file(s, file_id):
    return _graph(view.file_detail(s.graph, file_id))


def _neighborhood(s, node_id, scope="canonical", dependency_offset=0, dependent_offset=0):
    near = queries.neighborhood(s.graph, s.projection, node_id, scope, dependency_offset, dependent_offset)
    return _graph(near.graph) | {"dependencies": _dicts(near.dependencies), "dependents": _dicts(near.dependents), "dependencies_total": near.dependencies_total, "dependents_total": near.dependents_total}


def _facts(s, kind, from_id, to_id, scope="canonical", offset=0):
    facts, total, graph = view.relationship_facts(s.graph, s.projection, (kind, from_id, to_id), scope, offset)
    return {"facts": _dicts(facts), "total": total, "offset": offset, "graph": _graph(graph)}


def _page_of_search(s, term="", offset=0):
    rows, total = queries.search_page(s.texts.candidates(term.strip()), term, offset)
    return {"nodes": _dicts(rows), "total": total, "offset": offset}


def _sources(s, root, offset=0):
    """Saved sources against a folder as it is now, by path."""
    status = evidence.source_status(s.parts["evidence"], current_files(s.graph.nodes.sparkSession, root), s.parts["evidence"].select("path"))
    return _paged("sources", status, ["path"], offset)


def _snapshots(s):
    return {"snapshots": _dicts(s.store.list().limit(100).select("id", "root", "created_at", "status"))}


def _search(s, text="", kinds=(), limit=20):
    return {"nodes": _dicts(queries.search(s.texts.candidates(text), text, tuple(kinds), limit))}


def _inspect(s, node_id):
    page = view.inspect_page(s.graph, s.projection, node_id)
    return {k: _dicts(v) if hasattr(v, "collect") else v for k, v in page.items()}


def _path(s, from_id, to_id, scope="package"):
    return {"path": traverse.path(s.scoped(scope), from_id, to_id)}


def _paged(name, rows, order, offset):
    """A page of rows with their number, so that no result is larger than a page."""
    listed, total = page(rows, order, offset)
    return {name: _dicts(listed), "total": total, "offset": offset}


def _impact(s, package_id, offset=0):
    affected, graph = traverse.impact(s.projection.graph, package_id)
    rows = _paged("affected", affected, ["distance", "id"], offset)
    near = [package_id, *(r["id"] for r in rows["affected"])]
    edges = graph.edges.where(F.col("from_id").isin(near) & F.col("to_id").isin(near))
    return rows | {"edges": _dicts(edges.orderBy("from_id", "to_id"))}


def _related(incoming):
    return lambda s, package_id, offset=0: _paged("packages", view.package_related(s.graph, s.projection, package_id, incoming), ["id"], offset)


def _symbols(s, file_id, offset=0):
    return _paged("symbols", view.file_symbols(s.graph, file_id), ["id"], offset)


def _evidence(s, kind, from_id, to_id, scope="canonical", offset=0):
    rows, total = evidence.select_evidence(s.graph, s.projection, s.parts["evidence"], (kind, from_id, to_id), scope, offset, ("ordinal",))
    return {"items": _dicts(rows), "total": total, "offset": offset, "recorded": total > 0}


def _info(s):
    counts = view.overview_counts(s.graph.nodes).first().asDict()
    return counts | {"issues": s.parts["issues"].count(), "relations": {r["kind"]: r["count"] for r in s.graph.edges.groupBy("kind").count().orderBy(F.col("kind")).collect()}}


TEXT, NUMBER, FLAG = (str, False), (int, False), (bool, False)
NEEDED = (str, True)
TOOLS = {
    "scan_info": (_info, {}),
    "snapshots": (_snapshots, {}),
    "overview": (_overview, {}),
    "node_children": (_children, {"node_id": NEEDED, "offset": NUMBER}),
    "related_nodes": (_neighbours, {"node_id": NEEDED, "incoming": FLAG, "offset": NUMBER}),
    "package_detail": (_package, {"package_id": NEEDED}),
    "file_detail": (_file, {"file_id": NEEDED}),
    "neighborhood": (_neighborhood, {"node_id": NEEDED, "scope": TEXT, "dependency_offset": NUMBER, "dependent_offset": NUMBER}),
    "relationship_facts": (_facts, {"kind": NEEDED, "from_id": NEEDED, "to_id": NEEDED, "scope": TEXT, "offset": NUMBER}),
    "search_page": (_page_of_search, {"term": TEXT, "offset": NUMBER}),
    "source_status": (_sources, {"root": NEEDED, "offset": NUMBER}),
    "search_nodes": (_search, {"text": TEXT, "kinds": (list, False), "limit": NUMBER}),
    "inspect_node": (_inspect, {"node_id": NEEDED}),
    "package_dependencies": (_related(False), {"package_id": NEEDED, "offset": NUMBER}),
    "package_dependents": (_related(True), {"package_id": NEEDED, "offset": NUMBER}),
    "dependency_path": (_path, {"from_id": NEEDED, "to_id": NEEDED, "scope": TEXT}),
    "file_symbols": (_symbols, {"file_id": NEEDED, "offset": NUMBER}),
    "package_impact": (_impact, {"package_id": NEEDED, "offset": NUMBER}),
    "source_evidence": (_evidence, {"kind": NEEDED, "from_id": NEEDED, "to_id": NEEDED, "scope": TEXT, "offset": NUMBER}),
}
