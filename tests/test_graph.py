"""Graph operators on small fixtures."""

import gc
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.graph import CodeGraph, build
from cairn.operators import client, evidence, hierarchy, layers, queries, traverse, view
from cairn.operators.projection import project_packages
from cairn.schema import EDGES, EVIDENCE, NODES, GraphError
from cairn.session import few, folder, stored, sweep


def graph(spark, nodes, edges, language="go"):
    rows = [(i, k, p, i, language, c, None) for i, k, p, c in ((*n, None)[:4] for n in nodes)]
    return CodeGraph(spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, EDGES))


def packages(spark, names, imports, more=(), edges=()):
    return graph(spark, [(n, "PACKAGE", n) for n in names] + list(more), [("IMPORTS", a, b) for a, b in imports] + list(edges))


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_impact_cyclic(spark):
    g = packages(spark, "ABCDE", ["AB", "AC", "BD", "CD", "DA", "EC"], [("F", "FILE", "F")], [("CONTAINS", "D", "F")])
    affected, sub = traverse.impact(g, "D")
    assert [tuple(r) for r in affected.collect()] == [("B", 1), ("C", 1), ("A", 2), ("E", 2)]
    assert sub.nodes.count() == 5 and sub.edges.count() == 6
    with pytest.raises(GraphError):
        traverse.impact(g, "missing")


def test_path_and_dependencies(spark):
    g = packages(spark, "ABCDEF", ["AC", "DE", "CD", "DA", "AB", "BD"], (), [("CONTAINS", "A", "F")])
    assert ids(queries.dependencies(g, "A")) == ["B", "C"] and ids(queries.dependents(g, "D")) == ["B", "C"]
    assert traverse.path(g, "A", "E") == ["A", "B", "D", "E"]
    assert traverse.path(g, "A", "F") is None and traverse.path(g, "A", "A") == ["A"]


def test_projection(spark):
    files = [("a.go", "A"), ("b.go", "A"), ("d.go", "A"), ("c.go", "B")]
    nodes = [("M", "MODULE", "M")] + [(p, "PACKAGE", p) for p in "ABC"] + [(f, "FILE", f) for f, _ in files]
    edges = [("CONTAINS", "M", p) for p in "ABC"] + [("CONTAINS", p, f) for f, p in files] + [("IMPORTS", f, "B") for f in ("a.go", "b.go", "d.go")] + [("IMPORTS", "c.go", "C")]
    g = graph(spark, nodes, edges)
    hierarchy.validate(g)
    p = project_packages(g)
    assert {(r.from_id, r.to_id): len(r.sources) for r in p.sources().collect()} == {("A", "B"): 3, ("B", "C"): 1}
    assert p.graph.nodes.count() == 3 and traverse.path(p.graph, "A", "C") == ["A", "B", "C"]
    # imports of files project in Python alone
    to_file = CodeGraph(g.nodes, g.edges.union(spark.createDataFrame([("IMPORTS", "c.go", "a.go")], EDGES)))
    assert project_packages(to_file).graph.edges.count() == 2
    python = CodeGraph(g.nodes.withColumn("language", F.lit("python")), to_file.edges)
    assert project_packages(python).graph.edges.count() == 3


@pytest.mark.parametrize("edges,rule", [([("P", "f"), ("Q", "f")], "multiple containment parents"), ([("P", "Q"), ("Q", "P")], "containment cycle"), ([("M", "f")], "invalid containment"), ([("f", "P")], "invalid containment"), ([("P", "x")], "missing node")])
def test_invalid_containment(spark, edges, rule):
    g = graph(spark, [("M", "MODULE", "M"), ("P", "PACKAGE", "P"), ("Q", "PACKAGE", "Q"), ("f", "FILE", "f")], [("CONTAINS", a, b) for a, b in edges])
    assert rule in ids(hierarchy.violations(g), "rule")
    with pytest.raises(GraphError):
        hierarchy.validate(g)


def test_build_refuses(spark):
    g = packages(spark, "AB", ["AB"])
    assert build([(g.nodes, g.edges)] * 2).nodes.count() == 2
    for nodes, edges in ((g.nodes.withColumn("name", F.lit("other")), g.edges), (g.nodes, spark.createDataFrame([("IMPORTS", "A", "none")], EDGES))):
        with pytest.raises(GraphError):
            build([(g.nodes, g.edges), (nodes, edges)])


def test_hub_pages(spark):
    names = [f"f{k:03d}.py" for k in range(100)]
    g = graph(spark, [("hub.py", "FILE", "hub.py"), ("alone", "FILE", "alone")] + [(n, "FILE", f"{999 - k}") for k, n in enumerate(names)], [("IMPORTS", "hub.py", n) for n in names] + [("IMPORTS", n, "hub.py") for n in names], "python")
    p = project_packages(g)
    n = queries.neighborhood(g, p, "hub.py")
    assert (n.dependencies_total, n.dependents_total) == (100, 100) and n.graph.nodes.count() == 21 and n.graph.edges.count() == 40
    assert ids(n.dependencies)[0] == "f099.py"
    past = queries.neighborhood(g, p, "hub.py", dependency_offset=1000)
    assert past.dependencies.count() == 0 and past.dependencies_total == 100
    assert queries.neighborhood(g, p, "alone").graph.nodes.count() == 1
    for bad in (("nothing", "canonical", 0), ("hub.py", "other", 0), ("hub.py", "canonical", -1)):
        with pytest.raises(GraphError):
            queries.neighborhood(g, p, bad[0], bad[1], bad[2])


def test_search(spark):
    g = packages(spark, ["z", "a-TERM", "Term-id"], [])
    assert ids(queries.search(g.nodes, "term")) == ["Term-id", "a-TERM"]
    for limit in (-1, 0, 101):
        with pytest.raises(GraphError):
            queries.search(g.nodes, "", (), limit)
    with pytest.raises(GraphError):
        queries.search(g.nodes, "", ("NONE",))
    assert queries.client_search(g.nodes, "  ").count() == 0


def test_evidence_pages(spark):
    g = packages(spark, "ab", [], [("f", "FILE", "f")], [("CONTAINS", "a", "f"), ("IMPORTS", "f", "b")])
    p = project_packages(g)
    rows = [(("IMPORTS", "f", "b"), "f", 45 - k, 1, 45 - k, 2, "x", False, "h") for k in range(45)]
    e = spark.createDataFrame(rows, EVIDENCE)
    for scope, edge in (("canonical", ("IMPORTS", "f", "b")), ("package", ("IMPORTS", "a", "b"))):
        sizes = []
        for offset in (0, 20, 40, 60):
            page, total = evidence.select_evidence(g, p, e, edge, scope, offset)
            sizes.append(page.count())
            assert total == 45
        assert sizes == [20, 20, 5, 0]
    assert evidence.supporting_facts(g, p, ("IMPORTS", "a", "b"), "package")[1] == 1
    with pytest.raises(GraphError):
        evidence.supporting_facts(g, p, ("IMPORTS", "b", "a"), "package")


def test_views_and_counts(spark):
    nodes = [("p", "PACKAGE", "p", None), ("q", "PACKAGE", "q", None), ("e", "PACKAGE", "e", None), ("f", "FILE", "p/f", 2), ("g", "FILE", "p/g", None), ("h", "FILE", "q/h", 3), ("loose", "FILE", "loose", 1)]
    g = graph(spark, nodes, [("CONTAINS", "p", "f"), ("CONTAINS", "p", "g"), ("CONTAINS", "q", "h"), ("IMPORTS", "loose", "h"), ("IMPORTS", "f", "q"), ("USES_EXPORT", "f", "h")])
    p = project_packages(g)
    assert {r.id: r.imports for r in client.package_source_counts(g).collect()} == {"p": None, "q": 3, "e": 0}
    o = view.overview(g, p)
    assert set(ids(o.nodes)) == {"p", "q", "e", "loose", "h"} and set(ids(o.edges, "from_id")) == {"loose", "q"}
    none, opened = g.nodes.where("false"), g.nodes.where("id = 'q'")
    lines = lambda packages: {(r.source, r.source_handle, r.target, r.target_handle, r.importing_file, r.supplying_file) for r in client.import_card_lines(client.visible_graph(g, p, packages, none), g).where("target = 'p'").collect()}
    assert lines(none) == {("q", None, "p", None, "f", None)}  # into a closed card: one line
    assert lines(opened) == {("q", "h", "p", None, "f", "h")}  # into an open one: from the file whose export is used
    assert lines(g.nodes.where("id in ('p', 'q')")) == {("q", "h", "p", "f", "f", "h")}
    assert {(r.id, r.role) for r in client.file_roles(g).collect()} == {("loose", "importing"), ("f", "importing"), ("h", "supplying")}
    assert set(ids(client.reveal(g, "f"))) == {"p"}
    assert view.child_counts(g).where("id = 'e'").first().children == 0


def test_sides_beyond_the_bound(spark, monkeypatch):
    """What shows is the same whether its sides are broadcast or too large for it, by rows or by bytes."""
    g = packages(spark, "ABC", [], [(n, "FILE", n) for n in ("a1", "a2", "b1")], [("CONTAINS", "A", "a1"), ("CONTAINS", "A", "a2"), ("CONTAINS", "B", "b1"), ("IMPORTS", "a1", "B"), ("IMPORTS", "a2", "B"), ("IMPORTS", "b1", "C"), ("IMPORTS", "a2", "A")])
    opened = spark.createDataFrame([("A",)], "id string")
    seen = []
    for name, bound in ((None, 0), ("BROADCAST_ROWS", 0), ("BROADCAST_BYTES", 1)):
        with monkeypatch.context() as m:
            if name:
                m.setattr(f"cairn.session.{name}", bound)
            v = client.visible_graph(g, project_packages(g), opened, opened.where("false"))
            hinted = "broadcast" in few(g.nodes, "id")._jdf.queryExecution().logical().toString()
            seen.append((hinted, sorted((r.kind, r.source, r.target) for r in v.edges.collect()), sorted(tuple(r) for r in v.evidence.collect())))
    assert [s[0] for s in seen] == [True, False, False] and seen[0][1:] == seen[1][1:] == seen[2][1:]
    assert [e for e in seen[0][1] if e[0] == "IMPORTS"] == [("IMPORTS", "B", "C"), ("IMPORTS", "a1", "B"), ("IMPORTS", "a2", "A"), ("IMPORTS", "a2", "B")]


def test_bundle_facts(spark):
    """The facts of a route equal those of each line on its own, and are joined by all that a line names, not by its edge with a condition on the rest."""
    edges = spark.createDataFrame([("e", "IMPORTS", "A", "B", None, 9), ("x", "IMPORTS", "a1", "B", None, None)], "id string, kind string, source string, target string, projected string, supporting_count long")
    held = [("e", "IMPORTS", f"a{i}", to) for i in range(4) for to in ("b1", "b2", "B")] + [("x", "IMPORTS", "a1", "b1"), ("x", "IMPORTS", "a1", "B")]
    evidence = spark.createDataFrame(held, "edge_id string, kind string, from_id string, to_id string")
    ends = [(None, None), ("a1", None), ("a2", "b1"), (None, "b2"), ("a3", "B"), ("a0", "none"), ("none", "b1")]
    lines = [(f"{e}{i}", e, "B", f"h{i}", "A", None, *end) for e in "ex" for i, end in enumerate(ends)] + [("again", "e", "B", "h1", "A", None, "a1", None)]
    lines = spark.createDataFrame(lines, "id string, edge_id string, source string, source_handle string, target string, target_handle string, importing_file string, supplying_file string")
    windows = spark.createDataFrame([("B", f"h{i}", "visible") for i in range(7)], "card string, file string, place string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    bundles = client.bundle_routes(lines, client.VisibleGraph(edges, edges, evidence), windows)
    got = {(json.loads(r.bundle)[2], r.from_id, r.to_id) for r in bundles.facts.collect()}
    want = {(f"h{i}", a, b) for i, (file, supplier) in enumerate(ends) for edge, _, a, b in held if file in (None, a) and supplier in (None, b) or file in (None, a) and b == "B"}
    assert got == want and bundles.facts.count() == len(want)
    assert {r.source_handle: (r.members, r.facts) for r in bundles.routes.collect()} == {f"h{i}": (3 if i == 1 else 2, len([w for w in want if w[0] == f"h{i}"])) for i in range(7)}
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(before, store.executionsCount())]
    joins = [line for plan in plans for line in plan.splitlines() if line.startswith("Join condition")]
    assert joins and all(line.endswith(": None") for line in joins), joins


def test_stored_tables_go(spark):
    """A stored table stays while a plan reads it, also one that was made from it, and goes with the last."""
    root = folder(spark).removeprefix("file:")
    tables = lambda: {n for n in os.listdir(root) if n.startswith("tables-")}
    sweep(spark)
    before = tables()
    first = stored(spark.range(1000).withColumn("k", F.col("id") % 7))
    own = tables() - before
    second = first.groupBy("k").count()
    del first
    sweep(spark)
    assert own <= tables() and second.count() == 7
    del second
    for _ in range(20):
        gc.collect()
        sweep(spark)
        if not own & tables():
            break
        time.sleep(0.2)
    assert not own & tables()


def test_unused_imports(spark):
    """What supports nothing is the same whether the projection's own graph or another one is asked, and each import counts once."""
    nodes = [("p", "PACKAGE", "p"), ("q", "PACKAGE", "q"), ("f", "FILE", "f"), ("g", "FILE", "g"), ("loose", "FILE", "loose")]
    g = graph(spark, nodes, [("CONTAINS", "p", "f"), ("CONTAINS", "q", "g"), ("IMPORTS", "f", "q"), ("IMPORTS", "f", "loose"), ("IMPORTS", "loose", "q"), ("IMPORTS", "loose", "q"), ("IMPORTS", "loose", "loose")])
    want = [("f", "loose"), ("loose", "loose"), ("loose", "q")]
    for p in (project_packages(g), project_packages(g).held()):
        for asked in (g, type(g)(g.nodes, g.edges)):
            assert sorted((r.from_id, r.to_id) for r in p.unused(asked).collect()) == want
        assert [(r.from_id, r.to_id, r.source_from) for r in p.support.collect()] == [("p", "q", "f")]


def test_least_paths(spark):
    """Searches from both ends give what a search from one end gives, for 100 pairs at once, connected or not."""
    r = random.Random(4)
    names = [f"n{i:02d}" for i in range(40)]
    links = sorted({(a, b) for a, b in ((r.choice(names), r.choice(names)) for _ in range(75)) if a != b})
    edges = spark.createDataFrame(links, "from_id string, to_id string")
    pairs = [(i, r.choice(names), r.choice(names)) for i in range(99)] + [(99, "n00", "n00")]
    got = {p.pair: p.path for p in traverse.least_paths(edges, spark.createDataFrame(pairs, "pair int, from_id string, to_id string")).collect()}
    one = {(p.source, p.id): p.path for p in traverse.shortest_paths(edges, spark.createDataFrame([(n,) for n in names], "id string")).collect()}
    assert got == {i: one[a, b] for i, a, b in pairs if (a, b) in one} and 20 < len(got) < 100
    none = spark.createDataFrame([(0, "n00", "nowhere")], "pair int, from_id string, to_id string")
    assert traverse.least_paths(edges, none).count() == traverse.least_paths(edges, none.where("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_layers(spark, seed):
    """Components and longest paths of random digraphs against reachability by brute force."""
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    links = {(r.choice(names), r.choice(names)) for _ in range(28 + 8 * seed)}
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in links:
            reach[a] |= reach[b]
    component = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}
    above = lambda c: {component[a] for a, b in links if component[b] == c and component[a] != c}
    layer = lambda c: max((layer(p) + 1 for p in above(c)), default=0)
    rows = layers.layers(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(sorted(links), "from_id string, to_id string")).collect()
    assert {(x.id, x.component, x.layer) for x in rows} == {(n, component[n], layer(component[n])) for n in names}
    assert len(set(component.values())) < len(names)
