"""Registered queries of the graph operators, each with SQL of its own over the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.graph import CodeGraph, build, dangling_edges, is_declaration, node_conflicts, role_of, source_hash
from cairn.operators import client, evidence, hierarchy, layers, queries, traverse, view
from cairn.operators.projection import project_packages, subset_support
from cairn.plans.adapter_sql import query
from cairn.session import cut, folder, stored
from cairn.sources import analyze, go_facts, python_facts, tsjs_facts
from cairn.sources.demo_graph import demo_evidence, demo_graph, part_graph, tables
from cairn.sources.store import SnapshotStore
from cairn.streaming import pagination

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

PACKAGE, FILE = "package:3", "file:c1"


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def text_of(column, sep="|"):
    return F.array_join(column, sep)


def held_graph(spark, sf, style="G"):
    """The graph, computed once, for operators that read it several times."""
    g = demo_graph(spark, sf, style)
    return CodeGraph(stored(g.nodes), stored(g.edges))


# ---------------------------------------------------------------- building and validation


@registered(query("SELECT DISTINCT id, kind, path, name, language, import_count FROM nodes"))
def build_graph_nodes(spark, sf):
    g = demo_graph(spark, sf)
    return build([(g.nodes, g.edges), (g.nodes, g.edges)], check=False).nodes.drop("export_count")


@registered(query("SELECT DISTINCT kind, from_id, to_id FROM edges"))
def build_graph_edges(spark, sf):
    g = demo_graph(spark, sf)
    return build([(g.nodes, g.edges), (g.nodes, g.edges)], check=False).edges


@registered(query("bad AS (SELECT * FROM nodes WHERE kind <> 'PACKAGE' OR id NOT LIKE '%:1_') SELECT kind, from_id, to_id FROM edges WHERE from_id NOT IN (SELECT id FROM bad) OR to_id NOT IN (SELECT id FROM bad)"))
def dangling_edges_found(spark, sf):
    """Edges left behind when the packages numbered 10 to 19 are taken out."""
    g = demo_graph(spark, sf)
    return dangling_edges(g.nodes.where("kind <> 'PACKAGE' or id not like '%:1_'"), g.edges)


@registered(query("SELECT id, CAST(2 AS BIGINT) AS variants FROM nodes WHERE import_count > 0 AND kind = 'FILE'"))
def node_conflicts_found(spark, sf):
    """Files whose import count a second fragment gives one higher."""
    g = demo_graph(spark, sf)
    other = g.nodes.where("kind = 'FILE'").withColumn("import_count", F.col("import_count") + 1)
    return node_conflicts(g.nodes.unionByName(other))


@registered(query("SELECT child, parent FROM parents"))
def hierarchy_parents(spark, sf):
    return hierarchy.parents(demo_graph(spark, sf))


@registered(query("""
more AS (SELECT to_id AS child, from_id AS parent FROM edges WHERE kind = 'CONTAINS' UNION SELECT 'file:s' || s_suppkey, 'package:' || ((s_nationkey + 1) % 25) FROM supplier WHERE s_suppkey % 5 = 0
  UNION SELECT 'package:' || n_nationkey, 'file:s1' FROM nation WHERE n_nationkey = 7 UNION SELECT 'file:none', 'package:1')
SELECT 'multiple containment parents' AS rule, child AS id FROM more GROUP BY child HAVING count(*) > 1
UNION SELECT 'missing node', child FROM more WHERE child NOT IN (SELECT id FROM nodes) OR parent NOT IN (SELECT id FROM nodes)
UNION SELECT 'invalid containment', 'package:7'"""))
def hierarchy_violations(spark, sf):
    """Containment with second parents, a file that holds a package and a child that is no node."""
    g = demo_graph(spark, sf)
    supplier, nation = tables(spark, sf, "supplier", "nation")
    second = supplier.where("s_suppkey % 5 = 0").select(F.lit("CONTAINS").alias("kind"), F.format_string("package:%d", (F.col("s_nationkey") + 1) % 25).alias("from_id"), F.format_string("file:s%d", "s_suppkey").alias("to_id"))
    bad = nation.where("n_nationkey = 7").select(F.lit("CONTAINS"), F.lit("file:s1"), F.format_string("package:%d", "n_nationkey"))
    none = nation.where("n_nationkey = 1").select(F.lit("CONTAINS"), F.format_string("package:%d", "n_nationkey"), F.lit("file:none"))
    return hierarchy.violations(CodeGraph(g.nodes, g.edges.union(second).union(bad).union(none)))


@registered(query(f"SELECT child AS id FROM parents WHERE parent = '{PACKAGE}'"))
def children_of(spark, sf):
    return hierarchy.children(demo_graph(spark, sf), PACKAGE)


@registered(query(f"SELECT id, path FROM nodes JOIN parents ON child = id WHERE parent = '{PACKAGE}' ORDER BY path, id LIMIT 20 OFFSET 20"))
def children_page(spark, sf):
    return hierarchy.children_page(demo_graph(spark, sf), PACKAGE, 20)[0].select("id", "path")


@registered(query("SELECT id, CASE kind WHEN 'MODULE' THEN 'ROOT' WHEN 'PACKAGE' THEN 'CONTAINER' WHEN 'FILE' THEN 'SOURCE' ELSE 'DECLARATION' END AS role FROM nodes"))
def node_roles(spark, sf):
    return demo_graph(spark, sf).nodes.select("id", role_of(F.col("language"), F.col("kind")).alias("role"))


@registered("SELECT doc_id, sha256(text) AS hash FROM documents")
def source_hashes(spark, sf):
    return tables(spark, sf, "documents")[0].select("doc_id", source_hash(F.col("text")).alias("hash"))


@registered("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_sources(spark, sf):
    rows = tables(spark, sf, "documents")[0].groupBy(source_hash(F.col("text")).alias("hash"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# ---------------------------------------------------------------- projection

_PROJECTED = "SELECT from_id, to_id, count(*) AS n, string_agg(source_from || '>' || source_to, '|' ORDER BY source_from, source_to) AS sources FROM support GROUP BY 1, 2"


def _projected(spark, sf, style):
    source = F.transform("sources", lambda s: F.concat(s["from_id"], F.lit(">"), s["to_id"]))
    rows = project_packages(demo_graph(spark, sf, style)).sources()
    return rows.select("from_id", "to_id", F.size("sources").cast("long").alias("n"), text_of(source).alias("sources"))


@registered(query(_PROJECTED))
def project_packages_go(spark, sf):
    return _projected(spark, sf, "G")


@registered(query(_PROJECTED, style="P"))
def project_packages_python(spark, sf):
    return _projected(spark, sf, "P")


@registered(query("SELECT from_id, to_id, count(*) AS n FROM support GROUP BY 1, 2"))
def project_packages_full(spark, sf):
    """The projection with its support counted, not listed."""
    return project_packages(demo_graph(spark, sf, "G")).support.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


@registered(query("SELECT from_id, to_id, source_from, source_to FROM support WHERE source_from LIKE '%1'"))
def projection_subset(spark, sf):
    g = demo_graph(spark, sf)
    return subset_support(project_packages(g), g.edges.where("from_id like '%1'")).select("from_id", "to_id", "source_from", "source_to")


# ---------------------------------------------------------------- direct queries and traversal


@registered(query(f"SELECT to_id AS id FROM pedges WHERE from_id = '{PACKAGE}'"))
def dependencies(spark, sf):
    return queries.dependencies(project_packages(demo_graph(spark, sf)).graph, PACKAGE)


@registered(query(f"SELECT from_id AS id FROM pedges WHERE to_id = '{PACKAGE}'"))
def dependents(spark, sf):
    return queries.dependents(project_packages(demo_graph(spark, sf)).graph, PACKAGE)


_REACH = """
r(src, id, d) AS (SELECT n, n, 0 FROM (SELECT {f} AS n FROM pedges UNION SELECT {t} FROM pedges) UNION SELECT r.src, e.{t}, r.d + 1 FROM r JOIN pedges e ON e.{f} = r.id WHERE r.d < 25),
dist AS (SELECT src, id, min(d) AS d FROM r GROUP BY 1, 2)"""


@registered(query(_REACH.format(f="from_id", t="to_id") + """,
p(src, id, d, path) AS (SELECT src, id, 0, [id] FROM dist WHERE d = 0 UNION ALL
  SELECT p.src, e.to_id, p.d + 1, list_append(p.path, e.to_id) FROM p JOIN pedges e ON e.from_id = p.id JOIN dist ON dist.src = p.src AND dist.id = e.to_id AND dist.d = p.d + 1)
SELECT src AS source, id, min(d) AS distance, array_to_string(min(path), '>') AS path FROM p GROUP BY 1, 2"""))
def shortest_path_all_pairs(spark, sf):
    """Between all packages, of which there are 25 at every scale."""
    edges = cut(project_packages(demo_graph(spark, sf)).graph.edges)
    nodes = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    return traverse.shortest_paths(edges, nodes).select("source", "id", "distance", text_of(F.col("path"), ">").alias("path"))


@registered(query(_REACH.format(f="to_id", t="from_id") + " SELECT src AS target, id, d AS distance FROM dist WHERE d > 0"))
def impact_all(spark, sf):
    """What depends on each package, of which there are 25 at every scale."""
    graph = project_packages(demo_graph(spark, sf)).graph
    return traverse.impact_distances(CodeGraph(graph.nodes, cut(graph.edges)), graph.nodes.select("id"))


_PAIRED = """
WITH RECURSIVE e AS (SELECT DISTINCT 'file:p' || a.l_partkey AS f, 'file:p' || b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
r(src, id, d) AS (SELECT 'file:p' || p_partkey, 'file:p' || p_partkey, 0 FROM part WHERE p_partkey <= 12 UNION SELECT r.src, t, r.d + 1 FROM r JOIN e ON f = r.id WHERE r.d < 9),
dist AS (SELECT src, id, min(d) AS d FROM r GROUP BY 1, 2),
p(src, id, d, path) AS (SELECT src, id, 0, [id] FROM dist WHERE d = 0 UNION ALL
  SELECT p.src, t, p.d + 1, list_append(p.path, t) FROM p JOIN e ON f = p.id JOIN dist ON dist.src = p.src AND dist.id = t AND dist.d = p.d + 1)
SELECT p_partkey AS pair, array_to_string(min(path), '>') AS path FROM part JOIN p ON p_partkey <= 12 AND p.src = 'file:p' || p_partkey AND p.id = 'file:p' || (7 * p_partkey + 100) GROUP BY 1"""


@registered(_PAIRED)
def least_paths_between(spark, sf):
    """The least shortest paths of twelve pairs of parts, each searched from both ends."""
    g = part_graph(spark, sf)
    own = F.col("p_partkey")
    pairs = tables(spark, sf, "part")[0].where(own <= 12).select(own.alias("pair"), F.format_string("file:p%d", own).alias("from_id"), F.format_string("file:p%d", 7 * own + 100).alias("to_id"))
    return traverse.least_paths(g.edges, pairs).select("pair", text_of(F.col("path"), ">").alias("path"))


@registered("""
WITH RECURSIVE line AS (SELECT l_orderkey, l_linenumber, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT a.brand AS a, b.brand AS b, count(*) AS n FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2),
e AS (SELECT x.a, x.b FROM n x LEFT JOIN n y ON y.a = x.b AND y.b = x.a WHERE 4 * x.n > 5 * coalesce(y.n, 0)),
brand AS (SELECT DISTINCT p_brand AS id FROM part),
r AS (SELECT id AS a, id AS b FROM brand UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1),
ce AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN c x ON x.id = e.a JOIN c y ON y.id = e.b WHERE x.component <> y.component),
l(component, d) AS (SELECT DISTINCT component, 0 FROM c UNION SELECT ce.b, l.d + 1 FROM l JOIN ce ON ce.a = l.component)
SELECT id, component, max(d) AS layer FROM c JOIN l USING (component) GROUP BY 1, 2""")
def brand_layers(spark, sf):
    """Layers of the brands, where one imports another that follows it on order lines more than 5/4 times as often as the other way round."""
    line, part = tables(spark, sf, "lineitem", "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("from_id"))
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("from_id").alias("to_id"))
    n = cut(rows.join(after, ["l_orderkey", "l_linenumber"]).groupBy("from_id", "to_id").agg(F.count("*").alias("n")))
    back = n.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.col("n").alias("m"))
    edges = n.join(back, ["from_id", "to_id"], "left").where("4 * n > 5 * coalesce(m, 0)")
    return layers.layers(part.select(F.col("p_brand").alias("id")).distinct(), edges)


_PARTS = """
WITH RECURSIVE e AS (SELECT DISTINCT 'file:p' || a.l_partkey AS f, 'file:p' || b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
r(src, id, d) AS (SELECT 'file:p' || p_partkey, 'file:p' || p_partkey, 0 FROM part WHERE p_partkey IN (1, 2, 3) UNION SELECT r.src, {1}, r.d + 1 FROM r JOIN e ON {0} = r.id WHERE r.d < 9),
dist AS (SELECT src, id, min(d) AS d FROM r GROUP BY 1, 2)"""
#: The nodes that traversals of the finer graph start from.
STARTS = ("file:p1", "file:p2", "file:p3")


@registered(_PARTS.format("f", "t") + """,
p(src, id, d, path) AS (SELECT src, id, 0, [id] FROM dist WHERE d = 0 UNION ALL
  SELECT p.src, t, p.d + 1, list_append(p.path, t) FROM p JOIN e ON f = p.id JOIN dist ON dist.src = p.src AND dist.id = t AND dist.d = p.d + 1)
SELECT src AS source, id, min(d) AS distance, array_to_string(min(path), '>') AS path FROM p GROUP BY 1, 2""")
def shortest_paths_from(spark, sf):
    """Least shortest paths from three parts to all that they reach."""
    g = part_graph(spark, sf)
    rows = traverse.shortest_paths(g.edges, g.nodes.where(F.col("id").isin(*STARTS)).select("id"))
    return rows.select("source", "id", "distance", text_of(F.col("path"), ">").alias("path"))


@registered(_PARTS.format("t", "f") + " SELECT src AS target, id, d AS distance FROM dist WHERE d > 0")
def impact_of_parts(spark, sf):
    """What depends on three parts, at any distance."""
    g = part_graph(spark, sf)
    return traverse.impact_distances(g, g.nodes.where(F.col("id").isin(*STARTS)).select("id"))


@registered(query(_REACH.format(f="to_id", t="from_id") + f", inside AS (SELECT id FROM dist WHERE src = '{PACKAGE}' UNION SELECT '{PACKAGE}') SELECT from_id, to_id FROM pedges WHERE from_id IN (SELECT id FROM inside) AND to_id IN (SELECT id FROM inside)"))
def impact_subgraph(spark, sf):
    return traverse.impact(project_packages(demo_graph(spark, sf)).graph, PACKAGE)[1].edges.select("from_id", "to_id")


_MATCH = "(lower(name) LIKE '%{0}%' OR lower(path) LIKE '%{0}%' OR lower(id) LIKE '%{0}%')"


@registered(query(f"SELECT id, name FROM nodes WHERE {_MATCH.format('customer#0000001')} ORDER BY name, id LIMIT 20"))
def search_bounded(spark, sf):
    return queries.search(demo_graph(spark, sf).nodes, "Customer#0000001").select("id", "name")


@registered(query(f"SELECT id, path FROM nodes WHERE kind <> 'MODULE' AND {_MATCH.format('er#00000')} ORDER BY path, id LIMIT 20 OFFSET 20"))
def search_page(spark, sf):
    return queries.search_page(demo_graph(spark, sf).nodes, " ER#00000 ", 20)[0].select("id", "path")


@registered(query(f"SELECT id, name FROM nodes WHERE kind <> 'MODULE' AND {_MATCH.format('er#00000')} ORDER BY name, id LIMIT 40"))
def client_search(spark, sf):
    return queries.client_search(demo_graph(spark, sf).nodes, "er#00000").select("id", "name")


@registered(query(f"""
a AS (SELECT n.id FROM nodes n JOIN pedges e ON e.to_id = n.id WHERE e.from_id = '{PACKAGE}' ORDER BY n.path, n.id LIMIT 20),
b AS (SELECT n.id FROM nodes n JOIN pedges e ON e.from_id = n.id WHERE e.to_id = '{PACKAGE}' ORDER BY n.path, n.id LIMIT 20)
SELECT from_id, to_id FROM pedges WHERE from_id = '{PACKAGE}' AND to_id IN (SELECT id FROM a) UNION SELECT from_id, to_id FROM pedges WHERE to_id = '{PACKAGE}' AND from_id IN (SELECT id FROM b)"""))
def neighborhood_package(spark, sf):
    g = demo_graph(spark, sf)
    return queries.neighborhood(g, project_packages(g), PACKAGE, "package").graph.edges.select("from_id", "to_id")


@registered(query(f"SELECT n.id, n.path FROM nodes n JOIN imports e ON e.from_id = n.id WHERE e.to_id = '{PACKAGE}' ORDER BY n.path, n.id LIMIT 20"))
def neighborhood_dependents(spark, sf):
    g = demo_graph(spark, sf)
    return queries.neighborhood(g, project_packages(g), PACKAGE).dependents.select("id", "path")


@registered(query(f"SELECT n.id, n.path FROM nodes n JOIN pedges e ON e.to_id = n.id WHERE e.from_id = '{PACKAGE}' ORDER BY n.path, n.id LIMIT 20"))
def related_page(spark, sf):
    g = demo_graph(spark, sf)
    return queries.related_page(g, project_packages(g), PACKAGE, False, 0)[0].select("id", "path")


# ---------------------------------------------------------------- containment views

_UP = "up AS (SELECT id FROM start UNION SELECT parent FROM up JOIN parents ON child = up.id)"


@registered(query(f"start AS (SELECT id FROM nodes WHERE kind = 'METHOD'), {_UP} SELECT id FROM up"))
def ancestor_closure(spark, sf):
    g = demo_graph(spark, sf)
    return hierarchy.ancestors(g, g.nodes.where("kind = 'METHOD'"))


@registered(query(f"rel AS (SELECT * FROM edges WHERE kind = 'USES_EXPORT'), start AS (SELECT from_id AS id FROM rel UNION SELECT to_id FROM rel), {_UP} SELECT kind, from_id, to_id FROM rel UNION SELECT kind, from_id, to_id FROM edges WHERE kind = 'CONTAINS' AND from_id IN (SELECT id FROM up) AND to_id IN (SELECT id FROM up)"))
def subgraph_edges(spark, sf):
    g = demo_graph(spark, sf)
    rel = g.edges.where("kind = 'USES_EXPORT'")
    return hierarchy.subgraph(g, rel.select(F.col("from_id").alias("id")), rel).edges


_LOOSE = """
loose_edges AS (SELECT * FROM edges WHERE NOT (kind = 'CONTAINS' AND to_id LIKE 'file:s%')),
lparents AS (SELECT DISTINCT to_id AS child, from_id AS parent FROM loose_edges WHERE kind = 'CONTAINS'),
rel AS (SELECT * FROM loose_edges WHERE kind = 'IMPORTS'),
start AS (SELECT id FROM nodes WHERE kind IN ('MODULE', 'PACKAGE') UNION SELECT id FROM nodes WHERE kind = 'FILE' AND id NOT IN (SELECT child FROM lparents) UNION SELECT from_id FROM rel UNION SELECT to_id FROM rel),
up AS (SELECT id FROM start UNION SELECT parent FROM up JOIN lparents ON child = up.id)"""


def _loose(spark, sf):
    """Style P with the suppliers' files outside all packages, so that no import is projected."""
    g = held_graph(spark, sf, "P")
    return CodeGraph(g.nodes, g.edges.where("not (kind = 'CONTAINS' and to_id like 'file:s%')"))


@registered(query(_LOOSE + " SELECT id FROM up", style="P"))
def overview_nodes(spark, sf):
    g = _loose(spark, sf)
    return view.overview(g, project_packages(g)).nodes.select("id")


@registered(query(_LOOSE + " SELECT kind, from_id, to_id FROM rel UNION SELECT kind, from_id, to_id FROM loose_edges WHERE kind = 'CONTAINS' AND from_id IN (SELECT id FROM up) AND to_id IN (SELECT id FROM up)", style="P"))
def overview_edges(spark, sf):
    g = _loose(spark, sf)
    return view.overview(g, project_packages(g)).edges


@registered(query("SELECT count(*) FILTER (kind = 'PACKAGE') AS packages, count(*) FILTER (kind = 'FILE') AS files, count(*) FILTER (kind NOT IN ('MODULE', 'PACKAGE', 'FILE')) AS declarations FROM nodes"))
def overview_counts(spark, sf):
    return view.overview_counts(demo_graph(spark, sf).nodes)


@registered(query(f"""
files AS (SELECT file FROM owner WHERE package = '{PACKAGE}'),
rel AS (SELECT kind, from_id, to_id FROM edges WHERE kind <> 'CONTAINS' AND (from_id IN (SELECT file FROM files) OR to_id IN (SELECT file FROM files))
  UNION SELECT source_kind, source_from, source_to FROM support WHERE from_id = '{PACKAGE}' OR to_id = '{PACKAGE}'),
start AS (SELECT '{PACKAGE}' AS id UNION SELECT file FROM files UNION SELECT from_id FROM rel UNION SELECT to_id FROM rel), {_UP} SELECT id FROM up"""))
def package_detail_nodes(spark, sf):
    g = held_graph(spark, sf)
    return view.package_detail(g, project_packages(g), PACKAGE).nodes.select("id")


@registered(query(f"start AS (SELECT '{FILE}' AS id UNION SELECT child FROM parents WHERE parent = '{FILE}'), {_UP} SELECT id FROM up"))
def file_detail_nodes(spark, sf):
    return view.file_detail(demo_graph(spark, sf), FILE).nodes.select("id")


@registered(query(f"SELECT id, name FROM nodes JOIN parents ON child = id WHERE parent = '{FILE}'"))
def file_symbols(spark, sf):
    return view.file_symbols(demo_graph(spark, sf), FILE).select("id", "name")


@registered(query(f"SELECT DISTINCT kind, from_id, to_id, CASE WHEN from_id = '{PACKAGE}' THEN 'outgoing' ELSE 'incoming' END AS direction FROM edges WHERE from_id = '{PACKAGE}' OR to_id = '{PACKAGE}'"))
def inspect_edges(spark, sf):
    return view.inspect_edges(demo_graph(spark, sf), PACKAGE)


@registered(query("SELECT id, count(child) AS children FROM nodes LEFT JOIN parents ON parent = id GROUP BY id"))
def child_counts(spark, sf):
    return view.child_counts(demo_graph(spark, sf))


@registered(query("SELECT id, count(file) AS files FROM nodes LEFT JOIN owner ON package = id WHERE kind = 'PACKAGE' GROUP BY id"))
def file_counts(spark, sf):
    return view.file_counts(demo_graph(spark, sf))


@registered(query("SELECT 'IMPORTS:' || s.from_id || '->' || s.to_id AS relation, count(*) AS total FROM support s JOIN occ ON occ.from_id = s.source_from AND occ.target = s.source_to GROUP BY 1"))
def relationship_totals(spark, sf):
    return view.relationship_totals(project_packages(demo_graph(spark, sf)), demo_evidence(spark, sf))


@registered(query(f"SELECT from_id AS id, string_agg(source_from || '>' || source_to, '|' ORDER BY source_from, source_to) AS sources FROM support WHERE to_id = '{PACKAGE}' GROUP BY 1"))
def package_related(spark, sf):
    g = demo_graph(spark, sf)
    rows = view.package_related(g, project_packages(g), PACKAGE, True)
    return rows.select("id", text_of(F.transform("sources", lambda s: F.concat(s["from_id"], F.lit(">"), s["to_id"]))).alias("sources"))


# ---------------------------------------------------------------- evidence

_BUSIEST = "best AS (SELECT from_id AS a, to_id AS b FROM support GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)"


def _busiest(projection):
    row = projection.support.groupBy("from_id", "to_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_id", "to_id").first()
    return ("IMPORTS", row.from_id, row.to_id)


@registered(query(f"""{_BUSIEST}
SELECT n_name || '/' || c_name AS path, l_linenumber AS line, CAST(l_partkey AS INTEGER) AS "column", strftime(l_shipdate, '%Y-%m-%d') AS snippet FROM occ JOIN support s ON s.source_from = occ.from_id AND s.source_to = occ.target JOIN best ON s.from_id = a AND s.to_id = b
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY 1, 2, 3, occ.target, 4, l_orderkey, l_quantity, l_extendedprice LIMIT 20"""))
def evidence_page(spark, sf):
    g = demo_graph(spark, sf)
    p = project_packages(g)
    return evidence.select_evidence(g, p, demo_evidence(spark, sf), _busiest(p), "package", 0, ("tie", "tie2", "tie3"))[0].select("path", "line", "column", "snippet")


@registered(query(f"{_BUSIEST} SELECT source_from AS from_id, source_to AS to_id FROM support JOIN best ON from_id = a AND to_id = b ORDER BY 1, 2 LIMIT 20"))
def supporting_facts(spark, sf):
    g = demo_graph(spark, sf)
    p = project_packages(g)
    return evidence.supporting_facts(g, p, _busiest(p), "package")[0].select("from_id", "to_id")


@registered("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'not_recorded' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'unreadable' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents""")
def source_status(spark, sf):
    """Documents as sources, some of them unrecorded, gone, unreadable or edited since."""
    docs = tables(spark, sf, "documents")[0].select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    saved = docs.where("doc_id % 7 <> 0").select("path", source_hash(F.col("text")).alias("hash"))
    now = docs.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"), (F.col("doc_id") % 11 != 0).alias("readable"))
    return evidence.source_status(saved, now, docs)


# ---------------------------------------------------------------- map operators


@registered(query("SELECT p.id, CASE WHEN count(f.id) = count(f.import_count) THEN CAST(coalesce(sum(f.import_count), 0) AS BIGINT) END AS imports FROM nodes p LEFT JOIN owner ON package = p.id LEFT JOIN nodes f ON f.id = owner.file WHERE p.kind = 'PACKAGE' GROUP BY p.id"))
def package_source_counts(spark, sf):
    return client.package_source_counts(demo_graph(spark, sf)).select("id", "imports")


@registered(query("SELECT from_id AS id, 'importing' AS role FROM imports UNION SELECT to_id, 'supplying' FROM imports WHERE to_id IN (SELECT id FROM nodes WHERE kind = 'FILE') UNION SELECT to_id, 'supplying' FROM edges WHERE kind = 'USES_EXPORT'"))
def file_roles(spark, sf):
    return client.file_roles(demo_graph(spark, sf))


@registered(query(f"SELECT to_id AS id FROM pedges WHERE from_id = '{PACKAGE}' UNION SELECT from_id FROM pedges WHERE to_id = '{PACKAGE}' UNION SELECT '{PACKAGE}'"))
def connected_packages(spark, sf):
    return client.connected_packages(project_packages(demo_graph(spark, sf)), PACKAGE)


@registered(query("SELECT from_id AS importer, package, string_agg(DISTINCT to_id, '|' ORDER BY to_id) AS providers FROM edges JOIN owner ON file = to_id WHERE kind = 'USES_EXPORT' GROUP BY 1, 2"))
def export_use_index(spark, sf):
    return client.export_use_index(demo_graph(spark, sf)).select("importer", "package", text_of(F.col("providers")).alias("providers"))


# packages 0 to 4 are open, files whose id ends in 7 too, and methods are shown; written from the rules of the map, on tables
_VISIBLE = """
op AS (SELECT 'package:' || n_nationkey AS id FROM nation WHERE n_nationkey < 5),
fs AS (SELECT file AS id, package FROM owner WHERE package IN (SELECT id FROM op)),
ms AS (SELECT n.id, parent FROM nodes n JOIN parents ON child = n.id JOIN fs ON fs.id = parent WHERE n.kind = 'METHOD' AND parent LIKE '%7'),
kids AS (SELECT parent, count(*) AS n FROM parents GROUP BY 1),
vnodes AS (
  SELECT p.id, CAST(NULL AS VARCHAR) AS parent_id, coalesce((SELECT count(*) FROM owner WHERE package = p.id), 0) AS child_count, p.id IN (SELECT id FROM op) AS expanded FROM nodes p WHERE kind = 'PACKAGE'
  UNION ALL SELECT fs.id, package, coalesce(n, 0), fs.id LIKE '%7' FROM fs LEFT JOIN kids ON kids.parent = fs.id
  UNION ALL SELECT id, parent, 0, false FROM ms),
alone AS (SELECT i.from_id, i.to_id, coalesce(o.package, i.from_id) AS source, coalesce(t.package, i.to_id) AS target FROM imports i LEFT JOIN owner o ON o.file = i.from_id LEFT JOIN owner t ON t.file = i.to_id
  WHERE (i.from_id, i.to_id) NOT IN (SELECT (source_from, source_to) FROM support)),
totals AS (SELECT s.from_id, s.to_id, count(*) AS total FROM support s JOIN occ ON occ.from_id = s.source_from AND occ.target = s.source_to GROUP BY 1, 2),
closed AS (SELECT * FROM support WHERE from_id NOT IN (SELECT id FROM op)),
opened AS (SELECT s.* FROM support s JOIN fs ON fs.id = s.source_from WHERE from_id IN (SELECT id FROM op)),
vedges AS (
  SELECT 'CONTAINS:' || parent_id || '->' || id AS id, 'CONTAINS' AS kind, parent_id AS source, id AS target, CAST(NULL AS VARCHAR) AS projected, CAST(NULL AS BIGINT) AS supporting_count FROM vnodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'IMPORTS:' || c.from_id || '->' || c.to_id, 'IMPORTS', c.from_id, c.to_id, 'IMPORTS:' || c.from_id || '->' || c.to_id, total FROM closed c LEFT JOIN totals t ON t.from_id = c.from_id AND t.to_id = c.to_id
  UNION ALL SELECT 'IMPORTS:' || source_from || '->' || source_to, 'IMPORTS', source_from, to_id, 'IMPORTS:' || from_id || '->' || to_id, NULL FROM opened
  UNION ALL SELECT 'IMPORTS:' || from_id || '->' || to_id, 'IMPORTS', CASE WHEN from_id IN (SELECT id FROM vnodes) THEN from_id ELSE source END, target, NULL, NULL FROM alone WHERE source IN (SELECT id FROM vnodes) AND target IN (SELECT id FROM vnodes)),
facts AS (
  SELECT 'IMPORTS:' || from_id || '->' || to_id AS edge_id, source_from AS from_id, source_to AS to_id FROM closed
  UNION SELECT 'IMPORTS:' || source_from || '->' || source_to, source_from, source_to FROM opened
  UNION SELECT 'IMPORTS:' || from_id || '->' || to_id, from_id, to_id FROM alone)"""


def _visible(spark, sf, style="G", counted=True):
    g = held_graph(spark, sf, style)
    p = project_packages(g).held()
    opened = g.nodes.where(F.col("id").isin(*(f"package:{k}" for k in range(5))))
    totals = view.relationship_totals(p, demo_evidence(spark, sf, style)) if counted else None
    return g, client.visible_graph(g, p, opened, g.nodes.where("kind = 'FILE' and id like '%7'"), ("METHOD",), totals=totals)


@registered(query(_VISIBLE + " SELECT id, parent_id, child_count, expanded FROM vnodes"))
def visible_nodes(spark, sf):
    return _visible(spark, sf, counted=False)[1].nodes.select("id", "parent_id", "child_count", "expanded")


@registered(query(_VISIBLE + " SELECT * FROM vedges"))
def visible_edges(spark, sf):
    return _visible(spark, sf)[1].edges


@registered(query(_VISIBLE + " SELECT edge_id, from_id, to_id FROM facts", style="P"))
def visible_evidence(spark, sf):
    """The facts behind the visible edges, in the style whose files import files."""
    return _visible(spark, sf, "P", counted=False)[1].evidence.select("edge_id", "from_id", "to_id")


_LINES = _VISIBLE + """,
uses AS (SELECT DISTINCT e.from_id AS importer, o.package, e.to_id AS provider FROM edges e JOIN owner o ON o.file = e.to_id WHERE e.kind = 'USES_EXPORT'),
iedges AS (SELECT v.id AS edge_id, v.target AS dependency, coalesce(n.parent_id, v.source) AS package, coalesce(t.expanded, false) AS supplies, coalesce(c.expanded, false) AS takes
  FROM vedges v LEFT JOIN vnodes n ON n.id = v.source LEFT JOIN vnodes t ON t.id = v.target LEFT JOIN vnodes c ON c.id = coalesce(n.parent_id, v.source) WHERE v.kind = 'IMPORTS'),
per AS (SELECT edge_id, count(DISTINCT from_id) AS importers, min(from_id) AS one, bool_or(to_id IN (SELECT file FROM owner)) AS direct FROM facts GROUP BY 1),
single AS (SELECT * FROM iedges JOIN per USING (edge_id) WHERE NOT supplies AND NOT direct),
many AS (SELECT i.*, f.from_id AS importer, f.to_id IN (SELECT file FROM owner) AS direct, f.to_id FROM iedges i JOIN per p USING (edge_id) JOIN facts f USING (edge_id) WHERE supplies OR p.direct),
split AS (
  SELECT DISTINCT edge_id, dependency, package, supplies, takes, importer, to_id AS provider FROM many WHERE direct
  UNION SELECT DISTINCT m.edge_id, dependency, m.package, supplies, takes, m.importer, u.provider FROM many m LEFT JOIN uses u ON u.importer = m.importer AND u.package = dependency
    WHERE NOT direct AND (edge_id, m.importer) NOT IN (SELECT (edge_id, importer) FROM many WHERE direct)),
lines AS (
  SELECT edge_id AS id, edge_id, dependency AS source, CAST(NULL AS VARCHAR) AS source_handle, package AS target, CASE WHEN takes AND importers = 1 THEN one END AS target_handle,
    CASE WHEN importers = 1 THEN one END AS importing_file, CAST(NULL AS VARCHAR) AS supplying_file FROM single
  UNION ALL SELECT CAST(to_json([edge_id, importer, provider]) AS VARCHAR), edge_id, dependency, CASE WHEN supplies THEN provider END, package, CASE WHEN takes THEN importer END, importer, provider FROM split)"""


def _lines(spark, sf, style="G", counted=False):
    """What shows and its lines, which carry no counts; edges have them if counted."""
    g, visible = _visible(spark, sf, style, counted)
    visible = visible.held()
    return visible, client.import_card_lines(visible, g)


@registered(query(_LINES + " SELECT * FROM lines"))
def card_lines(spark, sf):
    return _lines(spark, sf)[1]


@registered(query(_LINES + " SELECT * FROM lines", style="P"))
def card_lines_python(spark, sf):
    """Lines where files import files, so that each has its supplier."""
    return _lines(spark, sf, "P")[1]


@registered(query(_LINES + """ SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY edge_id, source, source_handle, target, target_handle ORDER BY importing_file DESC, supplying_file DESC) AS r FROM lines) WHERE r > 1""", style="P"))
def occluded_lines(spark, sf):
    return client.occluded(_lines(spark, sf, "P")[1]).select("id")


# of each open package's files those ending in 1 are above the window, in 3 or 7 inside, in 5 below, and others in no window
_BUNDLES = _LINES + """,
win AS (SELECT package AS card, id AS file, CASE WHEN id LIKE '%1' THEN 'window:above' WHEN id LIKE '%5' THEN 'window:below' ELSE id END AS seen FROM fs WHERE right(id, 1) IN ('1', '3', '5', '7')),
ended AS (SELECT l.*, CASE WHEN source_handle IS NOT NULL THEN coalesce(a.seen, 'window:below') END AS sh, CASE WHEN target_handle IS NOT NULL THEN coalesce(b.seen, 'window:below') END AS th, v.projected, v.supporting_count, v.target AS dep
  FROM lines l LEFT JOIN win a ON a.card = l.source AND a.file = l.source_handle LEFT JOIN win b ON b.card = l.target AND b.file = l.target_handle JOIN vedges v ON v.id = l.edge_id),
named AS (SELECT CAST(to_json(['IMPORTS', source, sh, target, th]) AS VARCHAR) AS bundle, * FROM ended),
bfacts AS (SELECT DISTINCT bundle, f.from_id, f.to_id FROM named n JOIN facts f USING (edge_id) WHERE (importing_file IS NULL OR f.from_id = importing_file) AND (supplying_file IS NULL OR f.to_id IN (supplying_file, dep))),
loaded AS (SELECT edge_id, count(*) AS n FROM facts GROUP BY 1),
missing AS (SELECT bundle, sum(rest) AS unloaded FROM (SELECT DISTINCT bundle, projected, supporting_count - n AS rest FROM named JOIN loaded USING (edge_id) WHERE supporting_count > n) GROUP BY 1),
counted AS (SELECT bundle, count(*) AS facts FROM bfacts GROUP BY 1)"""


def _bundles(spark, sf, style, counted=True):
    visible, lines = _lines(spark, sf, style, counted)
    last = F.right("id", F.lit(1))
    place = F.when(last == "1", "above").when(last == "5", "below").otherwise("visible")
    shown = visible.nodes.where("kind = 'FILE' and parent_id is not null").where(last.isin("1", "3", "5", "7"))
    return client.bundle_routes(lines, visible, shown.select(F.col("parent_id").alias("card"), F.col("id").alias("file"), place.alias("place")))


@registered(query(_BUNDLES + """
SELECT bundle AS id, min(source) AS source, min(sh) AS source_handle, min(target) AS target, min(th) AS target_handle, arg_min(edge_id, id) AS edge_id, count(*) AS members, coalesce(max(facts), 0) AS facts, CAST(coalesce(max(unloaded), 0) AS BIGINT) AS unloaded
FROM named LEFT JOIN counted USING (bundle) LEFT JOIN missing USING (bundle) GROUP BY 1"""))
def bundle_routes(spark, sf):
    return _bundles(spark, sf, "G").routes.drop("kind", "importing_file", "supplying_file")


@registered(query(_BUNDLES + " SELECT * FROM bfacts", style="P"))
def bundle_facts(spark, sf):
    return _bundles(spark, sf, "P", counted=False).facts.drop("kind")  # no fact depends on counts


@registered(query("""
tree(id, depth, sp) AS (SELECT id, 0, [path || chr(1) || id] FROM nodes WHERE kind = 'PACKAGE' UNION ALL
  SELECT n.id, depth + 1, list_append(sp, n.path || chr(1) || n.id) FROM tree JOIN parents ON parent = tree.id JOIN nodes n ON n.id = child WHERE tree.id LIKE '%1')
SELECT id, depth, CAST(row_number() OVER (ORDER BY sp) AS INTEGER) AS place FROM tree"""))
def flatten_explorer(spark, sf):
    """Packages with those that end in 1 expanded, and their files that do."""
    g = demo_graph(spark, sf)
    rows = client.flatten_explorer(g, g.nodes.where("kind = 'PACKAGE'"), g.nodes.where("id like '%1'"))
    return paths.numbered(rows, [], ["sort_path"]).select("id", "depth", (F.col("place") + 1).cast("int").alias("place"))


@registered(query("start AS (SELECT min(id) AS id FROM nodes WHERE kind = 'METHOD'), " + _UP + " SELECT id, kind, CASE kind WHEN 'PACKAGE' THEN 'packages' WHEN 'FILE' THEN 'files' ELSE 'kinds' END AS part FROM up JOIN nodes USING (id) WHERE kind <> 'MODULE'"))
def reveal_node(spark, sf):
    g = demo_graph(spark, sf)
    return client.reveal(g, g.nodes.where("kind = 'METHOD'").agg(F.min("id")).first()[0])


@registered(query(_VISIBLE + " SELECT id, parent_id AS parent, CASE WHEN parent_id IS NULL THEN 'packages' END AS section FROM vnodes"))
def explorer_tree(spark, sf):
    g, visible = _visible(spark, sf)
    return client.explorer_tree(g, visible)


@registered(query("""
tree(id, depth, sp) AS (SELECT id, 0, [path || chr(1) || id] FROM nodes WHERE kind = 'PACKAGE' UNION ALL
  SELECT n.id, depth + 1, list_append(sp, n.path || chr(1) || n.id) FROM tree JOIN parents ON parent = tree.id JOIN nodes n ON n.id = child WHERE tree.id LIKE '%1' AND n.kind <> 'STRUCT'),
rows AS (SELECT id, depth, sp, CAST(NULL AS BIGINT) AS more FROM tree UNION ALL
  SELECT t.id, depth + 1, list_append(sp, chr(1114111)), n - 5 FROM tree t JOIN (SELECT parent, count(*) AS n FROM parents GROUP BY 1) k ON k.parent = t.id WHERE t.id LIKE '%1' AND n > 5)
SELECT id, depth, more, CAST(row_number() OVER (ORDER BY sp) - 1 AS BIGINT) AS place FROM rows"""))
def explorer_pages(spark, sf):
    """The tree with five children of each open node taken as loaded, without structs."""
    g = held_graph(spark, sf)
    pages = view.child_counts(g).select("id", F.lit(5).alias("next"), F.col("children").alias("total"))
    rows = client.flatten_explorer(g, client.explorer_roots(g), g.nodes.where("id like '%1'"), ("FUNCTION", "METHOD"), pages)
    return paths.numbered(rows, [], ["sort_path"]).select("id", "depth", "more", "place")


@registered(query(f"""
near AS (SELECT to_id AS id FROM pedges WHERE from_id = '{PACKAGE}' UNION SELECT from_id FROM pedges WHERE to_id = '{PACKAGE}')
SELECT 'IMPORTS:' || p.from_id || '->' || p.to_id AS edge_id, source_from AS from_id, source_to AS to_id FROM support p WHERE p.from_id = '{PACKAGE}' AND p.to_id IN (SELECT to_id FROM pedges JOIN nodes n ON n.id = to_id WHERE from_id = '{PACKAGE}' ORDER BY n.path, n.id LIMIT 20)
UNION SELECT 'IMPORTS:' || p.from_id || '->' || p.to_id, source_from, source_to FROM support p WHERE p.to_id = '{PACKAGE}' AND p.from_id IN (SELECT from_id FROM pedges JOIN nodes n ON n.id = from_id WHERE to_id = '{PACKAGE}' ORDER BY n.path, n.id LIMIT 20)"""))
def neighborhood_facts(spark, sf):
    """A package's listed neighbours as a visible graph: the facts behind its edges."""
    g = held_graph(spark, sf)
    p = project_packages(g)
    return client.neighborhood_graph(queries.neighborhood(g, p, PACKAGE, "package"), p, "package").evidence.select("edge_id", "from_id", "to_id")


@registered(query(f"""
start AS (SELECT '{PACKAGE}' AS id UNION SELECT id FROM (SELECT n.id FROM nodes n JOIN imports e ON e.from_id = n.id WHERE e.to_id = '{PACKAGE}' ORDER BY n.path, n.id LIMIT 20)), {_UP} SELECT id FROM up"""))
def neighborhood_context(spark, sf):
    """A package's listed importers with what contains them."""
    g = held_graph(spark, sf)
    return view.neighborhood_context(g, queries.neighborhood(g, project_packages(g), PACKAGE)).nodes.select("id")


@registered(query(f"""{_BUSIEST},
page AS (SELECT source_from, source_to FROM support JOIN best ON from_id = a AND to_id = b ORDER BY 1, 2 LIMIT 20), start AS (SELECT source_from AS id FROM page UNION SELECT source_to FROM page), {_UP}
SELECT 'IMPORTS' AS kind, source_from AS from_id, source_to AS to_id FROM page UNION SELECT kind, from_id, to_id FROM edges WHERE kind = 'CONTAINS' AND from_id IN (SELECT id FROM up) AND to_id IN (SELECT id FROM up)"""))
def relationship_facts(spark, sf):
    """The first facts behind the busiest relationship, with what contains their ends."""
    g = held_graph(spark, sf)
    p = project_packages(g)
    return view.relationship_facts(g, p, _busiest(p), "package")[2].edges


@registered(query(f"""
part AS (SELECT * FROM support WHERE source_from IN (SELECT file FROM owner WHERE package = '{PACKAGE}')),
totals AS (SELECT s.from_id, s.to_id, count(*) AS total FROM support s JOIN occ ON occ.from_id = s.source_from AND occ.target = s.source_to GROUP BY 1, 2)
SELECT 'total' AS part, 'IMPORTS:' || t.from_id || '->' || t.to_id AS id, total AS n FROM totals t WHERE (t.from_id, t.to_id) IN (SELECT (from_id, to_id) FROM part)
UNION ALL SELECT 'support', from_id || '>' || to_id, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'children', f.file, (SELECT count(*) FROM parents WHERE parent = f.file) FROM owner f WHERE package = '{PACKAGE}'"""))
def detail_assembly(spark, sf):
    """What a package's own files lack when loaded alone: their child counts, and the support and whole totals of their projected edges."""
    g = held_graph(spark, sf)
    p = project_packages(g).held()
    own = hierarchy.parents(g).where(F.col("parent") == PACKAGE).select(F.col("child").alias("id"))
    part = CodeGraph(g.nodes.join(own, "id", "left_semi").where("kind = 'FILE'"), g.imports().join(own.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("kind", "from_id", "to_id"))
    out = view.detail(g, p, demo_evidence(spark, sf), part)
    rows = out["totals"].select(F.lit("total").alias("part"), F.col("relation").alias("id"), F.col("total").alias("n"))
    support = out["projection"].support.groupBy("from_id", "to_id").agg(F.count("*").alias("n")).select(F.lit("support"), F.concat("from_id", F.lit(">"), "to_id"), "n")
    return rows.union(support).union(out["child_counts"].select(F.lit("children"), "id", "children"))


@registered(query("SELECT kind, from_id, to_id FROM edges WHERE kind = 'IMPORTS'"))
def merge_edges(spark, sf):
    """Imports loaded in two batches that overlap, as one graph."""
    g = demo_graph(spark, sf)
    some = CodeGraph(g.nodes, g.imports().where("from_id not like '%1'"))
    return client.merge_graphs([some, CodeGraph(g.nodes, g.imports().where("from_id like '%1' or from_id like '%2'"))]).edges


@registered(query("SELECT id, CASE WHEN id LIKE '%3' THEN 'new ' || name ELSE name END AS name FROM nodes"))
def merge_graph(spark, sf):
    """All nodes, and a later batch that renames some."""
    nodes = demo_graph(spark, sf).nodes.select("id", "name")
    return client.merge_nodes([nodes, nodes.where("id like '%3'").withColumn("name", F.concat(F.lit("new "), "name"))])


_LABELS = """
named AS (SELECT n.id, n.kind, n.path, n.import_count, CASE WHEN n.kind = 'FILE' THEN n.name || CASE WHEN n.id LIKE '%3' THEN '.py' WHEN n.id LIKE '%4' THEN '.tsx' ELSE '' END ELSE n.name END AS name FROM nodes n),
labelled AS (SELECT n.*, CASE WHEN n.kind = 'FILE' THEN regexp_replace(n.name, '\\.(py|tsx)$', '') END AS stem, p.name AS up, p.kind AS up_kind FROM named n LEFT JOIN parents ON child = n.id LEFT JOIN nodes p ON p.id = parent)
SELECT id,"""


def _labelled(spark, sf, style):
    g = demo_graph(spark, sf, style)
    suffix = F.when(F.col("id").like("%3"), ".py").when(F.col("id").like("%4"), ".tsx").otherwise("")
    nodes = g.nodes.withColumn("name", F.when(F.col("kind") == "FILE", F.concat("name", suffix)).otherwise(F.col("name")))
    return client.present(CodeGraph(nodes, g.edges))


@registered(query(_LABELS + """
  CASE WHEN kind = 'FILE' THEN 'module' ELSE lower(kind) END AS display_kind, CASE WHEN kind = 'FILE' THEN up || '.' || stem ELSE name END AS display_name, CASE WHEN kind = 'FILE' THEN stem ELSE name END AS row_name,
  CASE WHEN kind = 'FILE' THEN up || '.' || stem ELSE name END AS card_name, CASE kind WHEN 'PACKAGE' THEN 'package ' || name WHEN 'FILE' THEN 'module' END AS secondary_label,
  CASE kind WHEN 'PACKAGE' THEN 'module' WHEN 'FILE' THEN 'declaration' ELSE 'package' END AS child_label, CASE kind WHEN 'PACKAGE' THEN 'Modules' WHEN 'FILE' THEN 'Module' ELSE 'Files' END AS row_group_label,
  CASE kind WHEN 'PACKAGE' THEN 'container' WHEN 'FILE' THEN 'source' END AS expansion, kind = 'PACKAGE' AS primary_card, CASE WHEN kind = 'PACKAGE' THEN 'packages' END AS explorer_section,
  CASE kind WHEN 'PACKAGE' THEN NULL WHEN 'FILE' THEN 'M' ELSE '·' END AS row_mark, CASE WHEN kind = 'FILE' THEN CAST(import_count AS BIGINT) END AS imports FROM labelled""", style="P"))
def presentation_labels(spark, sf):
    """Labels of a Python graph, some of whose files have suffixes."""
    return _labelled(spark, sf, "P").drop("exports")


@registered(query(_LABELS + """
  lower(kind) AS display_kind, name AS display_name, CASE WHEN kind = 'PACKAGE' THEN path ELSE name END AS row_name, CASE WHEN kind = 'PACKAGE' THEN path ELSE name END AS card_name, CASE kind WHEN 'PACKAGE' THEN 'package ' || name END AS secondary_label,
  CASE kind WHEN 'PACKAGE' THEN 'file' WHEN 'FILE' THEN 'declaration' ELSE 'package' END AS child_label, CASE kind WHEN 'PACKAGE' THEN 'container' WHEN 'FILE' THEN 'source' END AS expansion, kind = 'PACKAGE' AS primary_card,
  CASE kind WHEN 'PACKAGE' THEN NULL WHEN 'FILE' THEN 'F' ELSE '·' END AS row_mark FROM labelled"""))
def presentation_labels_go(spark, sf):
    return _labelled(spark, sf, "G").drop("row_group_label", "explorer_section", "imports", "exports")


# ---------------------------------------------------------------- paths and ladders

_URL_PATH = "ltrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')"


def _url_paths(spark, sf):
    pages = tables(spark, sf, "pages")[0]
    return pages.select("page_id", F.ltrim(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("/")).alias("path"))


@registered(rf"""
WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages)
SELECT page_id, path, CASE WHEN regexp_matches(path, '^en/[0-9]*5[^/]*(/.*)?$') THEN NULL WHEN regexp_matches(path, '^(.*/)?[^/]*\.html$') THEN 2 WHEN regexp_matches(path, '^(de|fr)/.*$') THEN 1 ELSE NULL END AS line FROM p""")
def ignore_match(spark, sf):
    """The rule, by its line, that excludes each page's path: the last match decides, and `!` clears."""
    rules = paths.parse_ignore("/[df][er]/**\n*.html\n!/en/*5*\n")
    return paths.ignore_matches(_url_paths(spark, sf), rules).select("page_id", "path", "line")


@registered(rf"""
WITH p AS (SELECT page_id, {_URL_PATH} || CASE page_id % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.tsx' WHEN 3 THEN '.RS' WHEN 4 THEN '.txt' ELSE '' END AS path FROM pages)
SELECT page_id, CASE WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.RS' THEN 'unsupported' END AS language FROM p""")
def detect_language(spark, sf):
    suffix = F.element_at(F.array(*(F.lit(s) for s in (".go", ".py", ".tsx", ".RS", ".txt", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    return _url_paths(spark, sf).select("page_id", paths.language_of(F.concat("path", suffix)).alias("language"))


@registered(rf"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '@' ELSE '' END || {_URL_PATH} AS spec FROM pages)
SELECT page_id, CASE WHEN spec LIKE '@%' AND spec LIKE '%/%' THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) ELSE split_part(spec, '/', 1) END AS package FROM p""")
def package_name(spark, sf):
    spec = F.concat(F.when(F.col("page_id") % 2 == 0, "@").otherwise(""), F.col("path"))
    return _url_paths(spark, sf).select("page_id", paths.package_name(spec).alias("package"))


@registered("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS spec FROM pages)
SELECT page_id, spec, CASE WHEN spec IN ('/the', '/de', '/la') THEN 'standard_library' WHEN spec LIKE '/%e' THEN 'internal_resolved' WHEN spec LIKE '/%.%' OR spec LIKE '/%,%' THEN 'unresolved' WHEN length(spec) < 5 THEN 'external' ELSE 'unclassified' END AS class, count(*) AS n FROM h GROUP BY 1, 2, 3""")
def import_ladder(spark, sf):
    """Links of pages as imports, classed by the first rung that holds."""
    pages = tables(spark, sf, "pages")[0]
    spec = F.col("spec")
    rungs = [("standard_library", spec.isin("/the", "/de", "/la")), ("internal_resolved", spec.startswith("/") & spec.endswith("e")), ("unresolved", spec.startswith("/") & (spec.contains(".") | spec.contains(","))), ("external", F.length(spec) < 5)]
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("spec"))
    return rows.withColumn("class", paths.ladder(rungs, "unclassified")).groupBy("page_id", "spec", "class").agg(F.count("*").alias("n"))


@registered("""
SELECT l_linestatus AS part, count(*) AS imports_discovered, count(*) FILTER (l_returnflag = 'N') AS internal_resolved, count(*) FILTER (l_returnflag = 'R') AS external, count(*) FILTER (l_returnflag = 'A') AS unresolved,
  CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'completed_with_gaps' ELSE 'complete' END AS status FROM lineitem GROUP BY 1""")
def coverage_counts(spark, sf):
    """Order lines as imports: their counters by line status, and the status that gaps give."""
    line = tables(spark, sf, "lineitem")[0]
    rows = line.withColumn("class", paths.ladder([("internal_resolved", F.col("l_returnflag") == "N"), ("external", F.col("l_returnflag") == "R")], "unresolved"))
    return paths.coverage(rows.withColumnRenamed("l_linestatus", "part"), "part", ("internal_resolved", "external", "unresolved"))


@registered("""
WITH i AS (SELECT 'UNRESOLVED_IMPORT' AS kind, CAST(l_orderkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS import_path, l_returnflag AS reason FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT 'SKIPPED_FILE', CAST(o_orderkey AS VARCHAR), '', o_orderpriority FROM orders WHERE o_orderstatus = 'P')
SELECT kind, path, import_path, reason, CAST(row_number() OVER (PARTITION BY kind ORDER BY path, import_path, reason) - 1 AS INTEGER) AS ordinal FROM i""")
def issue_ordinals(spark, sf):
    line, orders = tables(spark, sf, "lineitem", "orders")
    a = line.where("l_returnflag = 'A'").select(F.lit("UNRESOLVED_IMPORT").alias("kind"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").cast("string").alias("import_path"), F.col("l_returnflag").alias("reason"))
    b = orders.where("o_orderstatus = 'P'").select(F.lit("SKIPPED_FILE").alias("kind"), F.col("o_orderkey").cast("string").alias("path"), F.lit("").alias("import_path"), F.col("o_orderpriority").alias("reason"))
    return paths.issue_ordinals([a, b])


def _snapshots(spark, sf):
    """A new store with one snapshot for each order status, the last one saved on the one before it: customers with such orders and their packages."""
    store, last = SnapshotStore(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}"), None
    g = held_graph(spark, sf)
    orders = tables(spark, sf, "orders")[0]
    package = g.nodes.where("kind = 'PACKAGE'")
    held = g.edges.where("kind = 'CONTAINS' and from_id like 'package:%'")
    for status in ("F", "O", "P"):
        own = orders.where(F.col("o_orderstatus") == status).select(F.format_string("file:c%d", "o_custkey").alias("id")).distinct()
        files = g.nodes.where("kind = 'FILE'").join(own, "id", "left_semi")
        edges = held.join(own.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        issues = files.where("import_count > 40").select(F.lit("UNRESOLVED_IMPORT").alias("kind"), "path", F.lit("").alias("import_path"), F.lit(status).alias("reason"))
        n = files.count()
        last = store.save(status, CodeGraph(package.unionByName(files), edges), {"issues": paths.issue_ordinals([issues])}, {"files_analyzed": n}, "complete" if status == "F" else "completed_with_gaps", last)
    return store


_SAVED = "saved AS (SELECT DISTINCT o_orderstatus AS root, 'file:c' || o_custkey AS id FROM orders)"


def _saved(spark, sf):
    """(store, scan) of the graph, just saved."""
    store = SnapshotStore(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")
    return store, store.save("demo", held_graph(spark, sf))


@registered(query(f"SELECT id, path FROM nodes JOIN parents ON child = id WHERE parent = '{PACKAGE}' ORDER BY path, id LIMIT 20 OFFSET 20"))
def stored_children_page(spark, sf):
    """A page of a package's children from the view index that was stored with the snapshot."""
    store, scan = _saved(spark, sf)
    return store.view(scan).children_page(PACKAGE, 20)[0].select("id", "path")


@registered(query("""
held AS (SELECT id, count(child) AS children FROM nodes LEFT JOIN parents ON parent = id GROUP BY id),
outs AS (SELECT from_id AS id, count(*) AS n FROM (SELECT DISTINCT kind, from_id, to_id FROM edges WHERE kind <> 'CONTAINS') GROUP BY 1),
projected AS (SELECT from_id AS id, count(*) AS n FROM pedges GROUP BY 1)
SELECT id, children, coalesce(outs.n, 0) AS out, coalesce(projected.n, 0) AS "to" FROM held LEFT JOIN outs USING (id) LEFT JOIN projected USING (id)"""))
def stored_counts(spark, sf):
    """Children, outgoing relations and projected dependencies of every node, from the stored view index."""
    store, scan = _saved(spark, sf)
    return store.view(scan).counts().select("id", "children", "out", "to")


@registered(query(f"SELECT id, name FROM nodes WHERE kind IN ('FILE', 'METHOD') AND {_MATCH.format('r#000000012')} ORDER BY name, id LIMIT 100"))
def stored_search(spark, sf):
    """A bounded search of two kinds from the search index that was stored with the snapshot."""
    store, scan = _saved(spark, sf)
    return queries.search(store.search(scan).candidates("R#000000012"), "R#000000012", ("FILE", "METHOD"), 100).select("id", "name")


@registered(query(f"SELECT id, path FROM nodes WHERE kind <> 'MODULE' AND {_MATCH.format('nation_16/cust')} ORDER BY path, id LIMIT 20 OFFSET 20"))
def stored_search_page(spark, sf):
    """A page of what holds a path's piece, from the stored search index."""
    store, scan = _saved(spark, sf)
    return queries.search_page(store.search(scan).candidates("Nation_16/Cust"), " Nation_16/Cust ", 20)[0].select("id", "path")


@registered(query(f"{_SAVED} SELECT root, CAST(row_number() OVER (ORDER BY root DESC) AS INTEGER) AS place, CASE root WHEN 'F' THEN 'complete' ELSE 'completed_with_gaps' END AS status, CAST(count(*) AS INTEGER) AS files_analyzed FROM saved GROUP BY 1"))
def snapshot_list(spark, sf):
    """All saved snapshots, newest first."""
    rows = _snapshots(spark, sf).list().select("root", "status", "files_analyzed", F.negative(F.unix_micros("created_ts")).alias("age"))
    return paths.numbered(rows, [], ["age"]).select("root", (F.col("place") + 1).cast("int").alias("place"), "status", "files_analyzed")


@registered(query(f"""{_SAVED},
issues AS (SELECT root, path, CAST(row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS INTEGER) AS ordinal FROM saved JOIN nodes USING (id) WHERE import_count > 40)
SELECT root, 'node' AS part, id, kind AS detail FROM saved JOIN nodes USING (id) UNION ALL SELECT root, 'node', n.id, n.kind FROM nodes n, (SELECT DISTINCT root FROM saved) WHERE n.kind = 'PACKAGE'
UNION ALL SELECT root, 'edge', child, parent FROM saved JOIN parents ON child = id UNION ALL SELECT root, 'issue', path, CAST(ordinal AS VARCHAR) FROM issues"""))
def snapshot_load(spark, sf):
    """What comes back of each saved snapshot: its nodes, containment and issues."""
    store, out = _snapshots(spark, sf), None
    for row in store.list().collect():  # three snapshots
        graph, parts = store.load(row.id)
        rows = graph.nodes.select(F.lit("node").alias("part"), "id", F.col("kind").alias("detail")).union(graph.edges.select(F.lit("edge"), "to_id", "from_id")).union(parts["issues"].select(F.lit("issue"), "path", F.col("ordinal").cast("string")))
        rows = rows.select(F.lit(row.root).alias("root"), "*")
        out = rows if out is None else out.union(rows)
    return out


# ---------------------------------------------------------------- imports and where they lead

_LANG = "p AS (SELECT page_id AS i, split_part(ltrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '/', 1) AS lang FROM pages)"


def _modules(spark, sf):
    """(i, lang): pages by number and the first element of their path."""
    return _url_paths(spark, sf).select(F.col("page_id").alias("i"), F.split("path", "/")[0].alias("lang"))


def _sources(path, *lines):
    return path.alias("path"), F.encode(F.concat_ws("\n", *lines, F.lit("")), "UTF-8").alias("content")


@registered(f"""
WITH {_LANG},
lines AS (
  SELECT i, lang, '.p' || (i + 1) AS import_path, CASE WHEN lang = 'es' THEN 'unresolved' WHEN EXISTS (SELECT 1 FROM p q WHERE q.i = p.i + 1 AND q.lang = p.lang) THEN 'internal_resolved' ELSE 'unresolved' END AS class, 'file:' || lang || '/p' || (i + 1) || '.py' AS target FROM p
  UNION ALL SELECT i, lang, 'os', 'standard_library', NULL FROM p
  UNION ALL SELECT i, lang, 'en.p' || (2 * i), CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.i = 2 * p.i AND q.lang = 'en') THEN 'internal_resolved' ELSE 'unresolved' END, 'file:en/p' || (2 * i) || '.py' FROM p
  UNION ALL SELECT i, lang, 'requests.x' || (i % 3), 'unclassified', NULL FROM p
  UNION ALL SELECT i, lang, 'p' || i, CASE WHEN lang = 'es' THEN 'internal_resolved' ELSE 'unclassified' END, 'file:' || lang || '/p' || i || '.py' FROM p)
SELECT lang || '/p' || i || '.py' AS path, import_path, class, CASE WHEN class = 'internal_resolved' THEN target END AS target FROM lines""")
def py_resolve(spark, sf):
    """Pages as Python modules of packages by language (of which `es` has no __init__): parsed, and their imports resolved."""
    rows = _modules(spark, sf)
    i = lambda e: F.expr(e).cast("string")
    text = (F.concat(F.lit("from . import p"), i("i + 1")), F.lit("import os"), F.concat(F.lit("import en.p"), i("2 * i")), F.concat(F.lit("import requests.x"), i("i % 3")), F.concat(F.lit("import p"), i("i")))
    files = rows.select(*_sources(F.concat("lang", F.lit("/p"), i("i"), F.lit(".py")), *text))
    init = rows.where("lang <> 'es'").select("lang").distinct().select(*_sources(F.concat("lang", F.lit("/__init__.py"))))
    facts = cut(python_facts.extract(files.union(init)))
    return python_facts.resolve(facts, python_facts.package_names(facts, "root")).select("path", "import_path", "class", "target")


@registered(f"""
WITH {_LANG},
lines AS (
  SELECT i, lang, './p' || (i + 1) AS spec, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.i = p.i + 1 AND q.lang = p.lang) THEN 'internal_resolved' ELSE 'unresolved' END AS class, 'file:' || lang || '/p' || (i + 1) || '.ts' AS target FROM p
  UNION ALL SELECT i, lang, '../en/p' || (2 * i) || '.js', CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.i = 2 * p.i AND q.lang = 'en') THEN 'internal_resolved' ELSE 'unresolved' END, 'file:en/p' || (2 * i) || '.ts' FROM p
  UNION ALL SELECT i, lang, 'node:fs', 'standard_library', NULL FROM p
  UNION ALL SELECT i, lang, '@scope/lib/x' || (i % 3), 'external', NULL FROM p
  UNION ALL SELECT i, lang, 'left-pad' || (i % 3), 'unclassified', NULL FROM p
  UNION ALL SELECT i, lang, '#own' || (i % 3), 'unresolved', NULL FROM p
  UNION ALL SELECT i, lang, '~/p' || (i + 2), CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.i = p.i + 2 AND q.lang = 'en') THEN 'internal_resolved' ELSE 'unresolved' END, 'file:en/p' || (i + 2) || '.ts' FROM p)
SELECT lang || '/p' || i || '.ts' AS path, spec, class, CASE WHEN class = 'internal_resolved' THEN target END AS target FROM lines""")
def ts_resolve(spark, sf):
    """Pages as TypeScript files: their import statements read, and resolved by candidates, an alias, runtime modules and declared packages."""
    rows = _modules(spark, sf)
    i = lambda e: F.expr(e).cast("string")
    specs = (F.concat(F.lit("./p"), i("i + 1")), F.concat(F.lit("../en/p"), i("2 * i"), F.lit(".js")), F.lit("node:fs"), F.concat(F.lit("@scope/lib/x"), i("i % 3")), F.concat(F.lit("left-pad"), i("i % 3")), F.concat(F.lit("#own"), i("i % 3")), F.concat(F.lit("~/p"), i("i + 2")))
    forms = ('import { a } from "%s";', "export * from '%s';", 'import "%s";', 'import type { B } from "%s";', 'import * as c from "%s";', 'import d from "%s";', 'export { e } from "%s";')
    files = rows.select(*_sources(F.concat("lang", F.lit("/p"), i("i"), F.lit(".ts")), *(F.format_string(form, spec) for form, spec in zip(forms, specs))))
    one = rows.groupBy().agg(F.count("*").alias("n"))
    package = one.select(*_sources(F.lit("package.json"), F.lit('{"dependencies": {"@scope/lib": "1"}}')))
    config = one.select(*_sources(F.lit("tsconfig.json"), F.lit('{"compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["en/*"]}}} // aliases')))
    facts = cut(tsjs_facts.extract(files))
    out = tsjs_facts.resolve(tsjs_facts.imports_of(facts), files.select("path"), tsjs_facts.configs_of(config), tsjs_facts.packages_of(package))
    return out.select("path", "spec", "class", "target")


@registered(f"""
WITH {_LANG},
dirs AS (SELECT DISTINCT lang, i % 7 AS d FROM p),
lines AS (
  SELECT i, lang, 'ex.com/' || lang || '/d' || (i % 9) AS import_path, CASE WHEN lang = 'es' THEN 'unclassified' WHEN (lang, i % 9) IN (SELECT (lang, d) FROM dirs) THEN 'internal_resolved' ELSE 'unresolved' END AS class,
    'package:' || lang || '/d' || (i % 9) || '#d' || (i % 9) AS target FROM p
  UNION ALL SELECT i, lang, 'net/http', 'standard_library', NULL FROM p
  UNION ALL SELECT i, lang, 'C', 'cgo', NULL FROM p
  UNION ALL SELECT i, lang, 'git.org/lib/v' || (i % 2), CASE WHEN lang = 'en' AND i % 2 = 0 THEN 'external' ELSE 'unclassified' END, NULL FROM p)
SELECT lang || '/d' || (i % 7) || '/f' || i || '.go' AS path, import_path, class, CASE WHEN class = 'internal_resolved' THEN target END AS target FROM lines""")
def go_resolve(spark, sf):
    """Pages as Go files of modules by language (`es` has none): their imports read and classed."""
    rows = _modules(spark, sf)
    i = lambda e: F.expr(e).cast("string")
    package = F.concat(F.lit("d"), i("i % 7"))
    text = (F.concat(F.lit("package "), package), F.lit('import "C"'), F.lit("import ("), F.concat(F.lit('\t"ex.com/'), "lang", F.lit("/d"), i("i % 9"), F.lit('"')), F.lit('\t"net/http"'), F.concat(F.lit('\tlib "git.org/lib/v'), i("i % 2"), F.lit('"')), F.lit(")"))
    files = rows.select(*_sources(F.concat("lang", F.lit("/"), package, F.lit("/f"), i("i"), F.lit(".go")), *text))
    modules = rows.where("lang <> 'es'").select("lang").distinct().select(*_sources(F.concat("lang", F.lit("/go.mod")), F.concat(F.lit("module ex.com/"), "lang"), F.lit("go 1.22"), F.when(F.col("lang") == "en", F.lit("require git.org/lib/v0 v0.1.0"))))
    facts = cut(go_facts.extract(files))
    return go_facts.resolve(facts, go_facts.modules_of(modules), go_facts.workspaces_of(modules)).select("path", "import_path", "class", "target")


@registered("""
SELECT 'p' || page_id || '.go' AS path, detail, CAST(line AS INTEGER) AS line FROM pages, (VALUES ('OutA', 4), ('OutB', 4), ('OutC', 5)) v(detail, line) WHERE page_id IS NOT NULL
UNION ALL SELECT 'p' || page_id || '.go', 'In' || (page_id % 3), 6 FROM pages WHERE page_id % 2 = 0""")
def go_free_references(spark, sf):
    """Pages as Go files that shadow an import in an if, a parameter and, every other one, a block: the references that the import keeps."""
    i = F.col("page_id")
    name = F.concat(F.lit("In"), (i % 3).cast("string"))
    block = F.when(i % 2 == 0, F.concat(F.lit("func h() { { dep := 1; _ = dep }; dep."), name, F.lit("() }"))).otherwise(F.concat(F.lit("func h() { dep := 1; { dep."), name, F.lit("() } }")))
    lines = (F.lit("package p"), F.lit('import dep "x.org/dep"'), F.lit("// dep.None"), F.lit("func f(n int) { if dep := dep.OutA(); n > 0 { dep.InA() } else { dep.InB() }; dep.OutB() }"), F.lit("func g(dep int) dep.OutC { return dep.InC }"), block)
    files = tables(spark, sf, "pages")[0].where("page_id is not null").select(*_sources(F.format_string("p%d.go", i), *lines))
    return go_facts.unbound(go_facts.extract(files)).select("path", "detail", "line")


# ---------------------------------------------------------------- from files to one graph

# each page is a Go file, a Python file and a TypeScript file of a package of its language; written as what a scan must find in them
_SCANNED = f"""
WITH {_LANG},
f AS (SELECT p.i, p.lang, p.lang || '/f' || p.i || '.go' AS go, p.lang || '/m' || p.i || '.py' AS py, p.lang || '/t' || p.i || '.ts' AS ts, q.i IS NOT NULL AS next, q.lang AS next_lang FROM p LEFT JOIN p q ON q.i = p.i + 1)"""


def _repository(spark, sf):
    """(path, content) of a mixed repository that the pages make up: four files for each, one module, packages by language."""
    rows = _modules(spark, sf)
    i = lambda e: F.expr(e).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    following = rows.select((F.col("i") - 1).alias("i"), F.col("lang").alias("next"))
    rows = cut(rows.join(following, "i", "left").withColumn("next", F.coalesce("next", F.lit("none"))))
    lang, after = F.col("lang"), F.col("next")
    go = rows.select(*_sources(
        text(lang, "/f", i("i"), ".go"), text("package ", lang), F.lit('import "strings"'), text('import other "ex.com/', after, '"'), F.lit("// import nothing"), text("type T", i("i"), " struct{}"),
        text("func (t *T", i("i"), ') Get() string { return strings.ToUpper("é") }'), text("func New", i("i"), "() { other.New", i("i + 1"), "() }"),
    ))
    broken = F.when(F.col("i") % 50 == 7, F.lit("def ("))
    py = rows.select(*_sources(text(lang, "/m", i("i"), ".py"), F.lit("import os"), text("from ", after, ".m", i("i + 1"), " import helper"), text("class C", i("i"), ":"), F.lit("    def run(self): pass"), F.lit("def helper(): pass"), broken))
    ts = rows.select(*_sources(text(lang, "/t", i("i"), ".ts"), text("import { run } from '../", after, "/t", i("i + 1"), "'"), text("export class K", i("i"), " { go(x: number) { return x } }"), F.lit("export const twice = (x: number) => 2 * x, limit = 3"), F.lit("require('x')")))
    other = rows.select(*_sources(text(lang, "/x", i("i"), ".rs")))
    one = rows.groupBy().agg(F.count("*").alias("n"))
    module = one.select(*_sources(F.lit("go.mod"), F.lit("module ex.com"), F.lit("go 1.22")))
    ignore = one.select(*_sources(F.lit(analyze.CONTROL), F.lit("es/*.ts")))
    init = rows.select("lang").distinct().select(*_sources(text(lang, "/__init__.py")))
    return reduce(DataFrame.union, (go, py, ts, other, module, ignore, init))


def _scanned(spark, sf):
    return analyze.analyze(_repository(spark, sf))


@registered(_SCANNED + """
SELECT 'module:.#ex.com' AS id, 'MODULE' AS kind, 'ex.com' AS name, CAST(NULL AS INTEGER) AS imports, CAST(NULL AS INTEGER) AS exports
UNION ALL SELECT DISTINCT 'package:' || lang || '#' || lang, 'PACKAGE', lang, NULL, NULL FROM f
UNION ALL SELECT 'file:' || go, 'FILE', 'f' || i || '.go', 2, 3 FROM f
UNION ALL SELECT 'struct:' || go || '#T' || i, 'STRUCT', 'T' || i, NULL, NULL FROM f
UNION ALL SELECT 'method:' || go || '#T' || i || '.Get', 'METHOD', 'T' || i || '.Get', NULL, NULL FROM f
UNION ALL SELECT 'function:' || go || '#New' || i, 'FUNCTION', 'New' || i, NULL, NULL FROM f
UNION ALL SELECT DISTINCT 'python-package:' || lang, 'PACKAGE', lang, NULL, NULL FROM f
UNION ALL SELECT DISTINCT 'file:' || lang || '/__init__.py', 'FILE', '__init__.py', 0, NULL FROM f
UNION ALL SELECT 'file:' || py, 'FILE', 'm' || i || '.py', 2, NULL FROM f WHERE i % 50 <> 7
UNION ALL SELECT 'class:' || py || '#C' || i, 'CLASS', 'C' || i, NULL, NULL FROM f WHERE i % 50 <> 7
UNION ALL SELECT 'method:' || py || '#C' || i || '.run', 'METHOD', 'C' || i || '.run', NULL, NULL FROM f WHERE i % 50 <> 7
UNION ALL SELECT 'function:' || py || '#helper', 'FUNCTION', 'helper', NULL, NULL FROM f WHERE i % 50 <> 7
UNION ALL SELECT 'file:' || ts, 'FILE', 't' || i || '.ts', 1, NULL FROM f WHERE lang <> 'es'
UNION ALL SELECT 'tsjs-declaration:' || CAST(to_json([d.kind, ts, d.name || CASE WHEN d.own THEN CAST(i AS VARCHAR) ELSE '' END || d.rest, '0']) AS VARCHAR), d.kind, d.name || CASE WHEN d.own THEN CAST(i AS VARCHAR) ELSE '' END || d.rest, NULL, NULL
  FROM f, (VALUES ('CLASS', 'K', true, ''), ('METHOD', 'K', true, '.go'), ('FUNCTION', 'twice', false, ''), ('VARIABLE', 'limit', false, '')) d(kind, name, own, rest) WHERE lang <> 'es'""")
def scanned_nodes(spark, sf):
    """The nodes of a mixed repository, from file contents to one graph."""
    return _scanned(spark, sf).graph.nodes.select("id", "kind", "name", F.col("import_count").alias("imports"), F.col("export_count").alias("exports"))


_SCANNED_EDGES = _SCANNED + """,
edges AS (
  SELECT 'IMPORTS' AS kind, 'file:' || go AS from_id, 'package:' || next_lang || '#' || next_lang AS to_id FROM f WHERE next
  UNION ALL SELECT 'USES_EXPORT', 'file:' || go, 'file:' || next_lang || '/f' || (i + 1) || '.go' FROM f WHERE next
  UNION ALL SELECT 'IMPORTS', 'file:' || py, 'file:' || next_lang || '/m' || (i + 1) || '.py' FROM f WHERE next AND i % 50 <> 7 AND (i + 1) % 50 <> 7
  UNION ALL SELECT 'IMPORTS', 'file:' || ts, 'file:' || next_lang || '/t' || (i + 1) || '.ts' FROM f WHERE next AND lang <> 'es' AND next_lang <> 'es')"""


@registered(_SCANNED_EDGES + " SELECT * FROM edges")
def scanned_edges(spark, sf):
    """Its imports and export uses."""
    return _scanned(spark, sf).graph.edges.where("kind <> 'CONTAINS'")


@registered(_SCANNED_EDGES + """,
places AS (
  SELECT e.*, go AS path, CASE e.kind WHEN 'IMPORTS' THEN 3 ELSE 7 END AS line, CASE e.kind WHEN 'IMPORTS' THEN 8 ELSE length('func New' || i || '() { ') + 1 END AS "column",
    CASE e.kind WHEN 'IMPORTS' THEN 'other "ex.com/' || next_lang || '"' ELSE 'other.New' || (i + 1) END AS snippet FROM edges e JOIN f ON e.from_id = 'file:' || go
  UNION ALL SELECT e.*, py, 2, 1, 'from ' || next_lang || '.m' || (i + 1) || ' import helper' FROM edges e JOIN f ON e.from_id = 'file:' || py
  UNION ALL SELECT e.*, ts, 1, 1, 'import { run } from ' || chr(39) || '../' || next_lang || '/t' || (i + 1) || chr(39) FROM edges e JOIN f ON e.from_id = 'file:' || ts)
SELECT CAST(row_number() OVER (ORDER BY path, line, "column", kind, to_id, snippet) - 1 AS INTEGER) AS ordinal, kind, from_id, to_id, path, CAST(line AS INTEGER) AS line, CAST("column" AS INTEGER) AS "column", CAST("column" + length(snippet) AS INTEGER) AS end_column, snippet FROM places""")
def scanned_evidence(spark, sf):
    """The occurrences behind them, in their saved order, with places and snippets."""
    return _scanned(spark, sf).evidence.select("ordinal", "edge.*", "path", "line", "column", "end_column", "snippet")


@registered(_SCANNED + """,
issues AS (
  SELECT 'UNSUPPORTED_FILE' AS kind, lang || '/x' || i || '.rs' AS path, '' AS import_path FROM f
  UNION ALL SELECT 'FAILED_FILE', py, '' FROM f WHERE i % 50 = 7
  UNION ALL SELECT 'TSJS_LIMITATION', ts, '' FROM f WHERE lang <> 'es'
  UNION ALL SELECT 'UNRESOLVED_IMPORT', go, 'ex.com/none' FROM f WHERE NOT next
  UNION ALL SELECT 'UNRESOLVED_IMPORT', py, next_lang || '.m' || (i + 1) FROM f WHERE next AND i % 50 <> 7 AND (i + 1) % 50 = 7
  UNION ALL SELECT 'UNCLASSIFIED_IMPORT', py, 'none.m' || (i + 1) FROM f WHERE NOT next AND i % 50 <> 7
  UNION ALL SELECT 'UNRESOLVED_IMPORT', ts, '../' || coalesce(next_lang, 'none') || '/t' || (i + 1) FROM f WHERE lang <> 'es' AND (NOT next OR next_lang = 'es'))
SELECT CAST(row_number() OVER (ORDER BY kind, path, import_path) - 1 AS INTEGER) AS ordinal, kind, path, import_path FROM issues""")
def scanned_issues(spark, sf):
    """Its issues in order: failed, unsupported and unresolved."""
    return _scanned(spark, sf).issues.select("ordinal", "kind", "path", "import_path")


@registered(_SCANNED_EDGES + """,
n AS (SELECT count(*) AS pages, count(*) FILTER (lang <> 'es') AS ts, count(*) FILTER (i % 50 = 7) AS broken, count(DISTINCT lang) AS langs, count(*) FILTER (NOT next) AS ends, count(*) FILTER (NOT next AND i % 50 <> 7) AS pyends,
  count(*) FILTER (next AND i % 50 <> 7 AND (i + 1) % 50 = 7) AS lost, count(*) FILTER (lang <> 'es' AND (NOT next OR next_lang = 'es')) AS tslost FROM f)
SELECT 'completed_with_gaps' AS status, CAST(3 * pages + ts + 1 + langs AS BIGINT) AS files_discovered, CAST(2 * pages + ts + langs AS BIGINT) AS supported_source_files, CAST(2 * pages + ts + langs - broken AS BIGINT) AS files_analyzed,
  CAST(pages AS BIGINT) AS files_skipped, CAST(broken AS BIGINT) AS files_failed, CAST(2 * pages + 2 * (pages - broken) + ts AS BIGINT) AS imports_discovered, (SELECT count(*) FROM edges WHERE kind = 'IMPORTS') AS internal_resolved,
  CAST(2 * pages - broken AS BIGINT) AS standard_library, CAST(ends + lost + tslost AS BIGINT) AS unresolved, CAST(pyends AS BIGINT) AS unclassified FROM n""")
def scanned_coverage(spark, sf):
    """One row of its counters and status."""
    found = _scanned(spark, sf)
    names = ("files_discovered", "supported_source_files", "files_analyzed", "files_skipped", "files_failed", "imports_discovered", "internal_resolved", "standard_library", "unresolved", "unclassified")
    return spark.createDataFrame([(found.status, *(found.counters[c] for c in names))], "status string, " + ", ".join(f"{c} long" for c in names))


# ---------------------------------------------------------------- scanning sources


@registered(rf"""
WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages)
SELECT page_id, path FROM p WHERE NOT (path LIKE 'de/%' OR path LIKE '%.html' AND path NOT LIKE 'fr/%')""")
def scan_kept(spark, sf):
    """Pages as files: a directory rule prunes `de`, a file rule is cleared below `fr`."""
    from cairn.sources.scan import scan

    rules = paths.parse_ignore("de/\n*.html\n!/fr/*.html\n")
    pages = _url_paths(spark, sf).withColumn("content", F.lit(None).cast("binary"))
    kept, _ = scan(pages, rules, "ignore")
    return kept.select("page_id", "path")


_ACTION = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'settled' WHEN 'purchase' THEN 'loaded' WHEN 'signup' THEN 'expand' ELSE 'collapse' END"


@registered(f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, {_ACTION} AS action, event_id AS k, CAST(event_id % 100 AS BIGINT) AS next, CAST(user_id % 1000 AS BIGINT) AS total FROM events),
p AS (SELECT id, arg_max(action IN ('start'), k) AS pending FROM e WHERE action <> 'expand' GROUP BY 1),
x AS (SELECT id, arg_max(action <> 'collapse', k) AS expanded FROM e WHERE action IN ('collapse', 'expand', 'loaded') GROUP BY 1),
l AS (SELECT id, arg_max(next, k) AS next, arg_max(total, k) AS total FROM e WHERE action = 'loaded' GROUP BY 1)
SELECT id, next, total, coalesce(pending, false) AS pending, coalesce(expanded, false) AS expanded FROM (SELECT DISTINCT id FROM e) LEFT JOIN p USING (id) LEFT JOIN x USING (id) LEFT JOIN l USING (id)""")
def explorer_pagination(spark, sf):
    """Every user's paged list after all its events."""
    user = F.col("user_id")
    events = tables(spark, sf, "events")[0].select(user.cast("string").alias("id"), F.expr(_ACTION).alias("action"), F.col("event_id").alias("at"), (F.col("event_id") % 100).alias("next"), (user % 1000).alias("total"))
    return pagination.paged(events)


@registered("""
WITH w AS (SELECT user_id, CAST(count(*) AS BIGINT) AS row_count, CAST(max(event_id) % 20000 AS BIGINT) AS scroll_top FROM events GROUP BY 1),
f AS (SELECT *, least(greatest(row_count - 1, 0), greatest(CAST(floor(scroll_top / 30) AS BIGINT) - 2, 0)) AS first FROM w)
SELECT user_id, first, least(row_count, first + 24) AS last, first * 30 AS before, greatest(row_count - least(row_count, first + 24), 0) * 30 AS after FROM f""")
def explorer_window(spark, sf):
    """The rows to draw of each user's list of events."""
    rows = tables(spark, sf, "events")[0].groupBy("user_id").agg(F.count("*").alias("row_count"), (F.max("event_id") % 20000).alias("scroll_top"))
    return client.explorer_window(rows).select("user_id", "first", "last", "before", "after")


@registered("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_activity(spark, sf):
    from cairn.streaming.ingest import import_activity

    return import_activity(tables(spark, sf, "events")[0]).withColumn("total", F.round("total", 4))
