"""Ignore rules, scans, Python facts and the snapshot store."""

import json
import random
import re
import shutil
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from cairn.functions.paths import glob_pattern, language_of, package_name, parse_ignore
from cairn.graph import CodeGraph
from cairn.operators import queries
from cairn.operators.hierarchy import children_page, parents
from cairn.operators.projection import project_packages
from cairn.operators.queries import related_page
from cairn.probe import Probe
from cairn.schema import EDGES, NODES, GraphError
from cairn.sources.analyze import answered
from cairn.sources.python_facts import extract, python_graph
from cairn.sources.repository import RepositoryReader, counters, repository
from cairn.sources.scan import scan
from cairn.sources.search_index import SearchIndex, _postings, write_search_index
from cairn.sources.store import MANIFEST, SnapshotStore
from cairn.streaming import pagination
from tests.test_graph import packages


def java(pattern):
    """The Java pattern as one of Python's: the constructs used here differ only in these names."""
    for a, b in (("\\z", "\\Z"), ("(?s:.*)", "(?:.|\\n)*"), ("\\p{Digit}", "0-9"), ("\\p{Alpha}", "a-zA-Z")):
        pattern = pattern.replace(a, b)
    return re.compile(pattern)


@pytest.mark.parametrize("glob,path,hit", [
    ("*.go", "a.go", True), ("*.go", "x/a.go", True), ("a/*.go", "a/b.go", True), ("a/*.go", "a/b/c.go", False), ("a/**/c", "a/c", True),
    ("a/**/c", "a/x/y/c", True), ("a/**", "a/b/c", True), ("a/**", "a", False), ("**/x", "x", True), ("?.py", "a.py", True), ("?.py", "ab.py", False),
    ("[!a].c", "b.c", True), ("[!a].c", "a.c", False), ("[[:digit:]]x", "1x", True), ("[]]", "]", True), ("\\*", "*", True), ("\\*", "a", False), ("a?b", "a/b", False),
])
def test_globs(glob, path, hit):
    assert bool(java(glob_pattern(glob, "/" in glob)).match(path)) == hit


@pytest.mark.parametrize("bad", ["[a", "x\\", "/", "!", "[[:none:]]", "[z-a]"])
def test_bad_globs(bad):
    with pytest.raises(GraphError):
        parse_ignore(bad)


def test_scan_prunes(spark):
    rules = parse_ignore("*.go\n!keep.go\ncache/\n!cache/in.py\n")
    rows = [(p, b"") for p in ("a.go", "keep.go", "cache/in.py", "x/cache/y/z.py", "node_modules/a.py", "b.py", "control")]
    kept, gone = scan(spark.createDataFrame(rows, "path string, content binary"), rules, "control")
    assert {r.path for r in kept.collect()} == {"keep.go", "b.py"}
    assert {(r.path, r.reason) for r in gone.collect()} == {("a.go", 'control:1 pattern "*.go"'), ("cache/", 'control:3 pattern "cache/"'), ("x/cache/", 'control:3 pattern "cache/"')}


def test_names(spark):
    rows = spark.createDataFrame([("a.go",), ("x.py",), ("b.d.mts",), ("a.jsx",), ("A.RS",), ("c.GO",), (None,)], "p string").select(language_of(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["go", "python", "typescript", "javascript", "unsupported", None, None]
    rows = spark.createDataFrame([("react/x",), ("@s/p/x",), ("@s",)], "p string").select(package_name(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["react", "@s/p", "@s"]


def test_python_repository(spark):
    files = {
        "users/__init__.py": "", "users/admin/__init__.py": "", "users/models.py": "class User:\n    def name(self): pass\n\ndef make(): pass\n",
        "users/service.py": "import os\nfrom .models import User\nfrom . import admin\nimport users.models\nimport missing\nfrom users.none import x\n", "alone.py": "from .x import y\n", "broken.py": "def (",
    }
    facts = extract(spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary"))
    g, resolved = python_graph(facts, "repo")
    assert {r.id for r in g.nodes.where("kind = 'PACKAGE'").collect()} == {"python-package:users", "python-package:users/admin"}
    assert {r.id for r in g.nodes.where("kind in ('CLASS', 'METHOD', 'FUNCTION')").collect()} == {"class:users/models.py#User", "method:users/models.py#User.name", "function:users/models.py#make"}
    got = {(r.import_path, r["class"]) for r in resolved.where("path = 'users/service.py'").collect()}
    assert got == {("os", "standard_library"), (".models", "internal_resolved"), (".admin", "internal_resolved"), ("users.models", "internal_resolved"), ("missing", "unclassified"), ("users.none", "unresolved")}
    assert resolved.where("path = 'alone.py'").first()["class"] == "unresolved"
    assert {r.path for r in facts.where("fact = 'failed'").collect()} == {"broken.py"}
    assert g.edges.where("kind = 'IMPORTS'").count() == 2


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.latest() is None
    g = packages(spark, "AB", ["AB"])
    first = store.save("root", g)
    loaded, parts = store.load(first)
    assert loaded.nodes.count() == 2 and loaded.edges.count() == 1 and parts["issues"].count() == 0
    broken = type(g)(g.nodes, spark.createDataFrame([("IMPORTS", "A", "none")], EDGES))
    for args, code in (((broken,), "invalid_graph"), ((g, None, None, "failed"), "bad_request"), ((g, None, None, "complete", "other"), "scan_conflict")):
        with pytest.raises(GraphError) as e:
            store.save("root", *args)
        assert e.value.code == code
    second = store.save("root", g, expected=first)
    assert [r.id for r in store.list().collect()] == [second, first]
    with pytest.raises(GraphError):
        store.load("none")


@pytest.mark.parametrize("older", [1, 2])
def test_store_format(spark, tmp_path, monkeypatch, older):
    """Older stores are migrated when opened for writing, refused when only read, and unharmed when a migration fails; newer ones are refused."""
    root, manifest = tmp_path / "store", tmp_path / "store" / MANIFEST
    g = packages(spark, "ABC", ["AB", "AC"])
    scan = SnapshotStore(spark, str(root)).save("root", g)
    views = root / json.loads(manifest.read_text())["views"]
    manifest.unlink()
    if older == 1:  # as the first format left it
        shutil.rmtree(views)
    else:
        shutil.rmtree(views / f"search_of={scan}")
        (root / "manifest.json").write_text(json.dumps({"format": 2, "views": views.name}))
    with pytest.raises(GraphError) as e:
        SnapshotStore(spark, str(root), read_only=True)
    assert e.value.code == "unsupported_version"
    with monkeypatch.context() as m:
        m.setattr("cairn.sources.store.write_search_index", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            SnapshotStore(spark, str(root))
    assert not manifest.exists()
    store = SnapshotStore(spark, str(root))
    assert store.load(scan)[0].nodes.count() == 3 and store.view(scan).node("A")["counts"]["out"] == 2 and store.search(scan).candidates("a").count() == 3
    assert store.views != views.name and SnapshotStore(spark, str(root), read_only=True).latest() == scan
    (root / "manifest-9.json").write_text('{"format": 9}')
    for read_only in (True, False):
        with pytest.raises(GraphError):
            SnapshotStore(spark, str(root), read_only=read_only)


def test_leases(spark, tmp_path):
    """A live claim keeps others out; a dead saver's frees itself and goes to one of two; who lost it cannot publish."""
    root = str(tmp_path / "store")
    g = packages(spark, "AB", ["AB"])
    first = SnapshotStore(spark, root).save("root", g)
    dead = SnapshotStore(spark, root, lease=0.2)
    assert dead._claim(first) == 0  # and dies
    time.sleep(0.3)
    slow, fast = SnapshotStore(spark, root), SnapshotStore(spark, root)
    assert slow._claim(first) == 1
    for other in (fast, dead):
        with pytest.raises(GraphError) as e:
            other.save("root", g, expected=first)
        assert e.value.code == "scan_conflict"
    (tmp_path / "store" / "claims" / f"{first}-1").write_text("0")  # its lease has ended
    for f in (tmp_path / "store" / "claims").glob(".*.crc"):
        f.unlink()
    real = SnapshotStore._claim
    second = fast.save("root", g, expected=first)
    assert fast.latest() == second
    # a saver that is overtaken while it writes
    late = SnapshotStore(spark, root)
    late._claim = lambda name: (real(late, name), open(tmp_path / "store" / "claims" / f"{name}-1", "w").close())[0]
    with pytest.raises(GraphError):
        late.save("root", g, expected=second)
    assert fast.latest() == second


def test_view_index(spark, tmp_path):
    """Pages and counts of the stored index equal the operators'; a page's plan reads one folder and has no exchange."""
    names = [f"f{i:02d}" for i in range(45)]
    nodes = [("M", "MODULE", "M", "M", "go", None, None), ("p", "PACKAGE", "p", "p", "go", None, None), ("q", "PACKAGE", "q", "q", "go", None, None)] + [(n, "FILE", f"p/{n[::-1]}", n, "go", 1, 0) for n in names]
    edges = [("CONTAINS", "M", "p"), ("CONTAINS", "M", "q")] + [(k, *e) for n in names for k, e in (("CONTAINS", ("p", n)), ("IMPORTS", (n, "q")), ("USES_EXPORT", (n, "f00")))]
    g = CodeGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    index, projection = store.view(store.save("root", g)), project_packages(g)
    for offset in (0, 20, 40, 60):
        got, total = index.children_page("p", offset)
        want, n = children_page(g, "p", offset)
        assert got.collect() == want.select(got.columns).collect() and total == n == 45
    for node, incoming in (("p", False), ("q", True), ("q", False), ("f00", True), ("f07", False), ("M", False)):
        got, total = index.related_page(node, incoming)
        want, n = related_page(g, projection, node, incoming, 0)
        assert got.collect() == want.select(got.columns).collect() and total == n
    plan = index.children_page("p", 20)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrderedAndProject" in plan and "PartitionFilters: [isnotnull(folder" in plan
    assert index.parent("f01") == "p" and index.parent("M") is None and index.node("p")["counts"] == {"children": 45, "files": 45, "out": 0, "in": 0, "to": 1, "from": 0}
    with pytest.raises(GraphError):
        index.children_page("none")
    broken = CodeGraph(g.nodes, g.edges.union(spark.createDataFrame([("CONTAINS", "q", "f01")], EDGES)))
    with pytest.raises(GraphError):
        store.save("root", broken)
    assert store.list().count() == 1


def test_search_index(spark, tmp_path, monkeypatch):
    """Searches over the index's candidates equal those over all nodes; a rare text reads fewer files, a common or short one all."""
    monkeypatch.setattr("cairn.sources.search_index.BLOCK", 40)
    monkeypatch.setattr("cairn.sources.search_index.POSTINGS", 500)
    nodes = [("M", "MODULE", "", "Root", "go", None, None), ("long", "FILE", "x" * 5000 + "/end.go", None, "go", 1, 0), ("none", "FILE", None, "none", "go", 1, 0)]
    nodes += [(f"id{d}.{i}", "FILE", f"src/Folder{d}/Ärger{i % 7}/f{i}.go", f"ΣΑΣ{i}", "go", 1, 0) for d in range(12) for i in range(20)]
    nodes += [("function:q'1", "FUNCTION", "src/%_x.go", "Get%_", "go", None, None)]
    rows = spark.createDataFrame(nodes, NODES)
    path = str(tmp_path / "index")
    write_search_index(rows.repartition(3), path)
    index = SearchIndex(spark, path)
    assert index.folders > 2 and index.blocks > 2
    shown = lambda df: [tuple(r) for r in df.collect()]
    for text in ("FOLDER1", "ärGER3/F1", "σας1", "q'1", "t%_", "x" * 3000, "zzz", "f1", "", " folder3 ", "src/", "none"):
        found = index.candidates(text)
        assert shown(queries.search(found, text, (), 100)) == shown(queries.search(rows, text, (), 100)), text
        if text == text.strip():
            assert shown(queries.search_page(found, text, 20)[0]) == shown(queries.search_page(rows, text, 20)[0]), text
    assert shown(queries.search(index.candidates("r7/"), "r7/", ("MODULE", "FUNCTION"), 9)) == [] and shown(queries.client_search(index.candidates("f19"), "f19")) == shown(queries.client_search(rows, "f19"))
    every = len(index.nodes.inputFiles())
    assert len(index.rarest("folder7")) == 3 and index.rarest("src/") is None and index.rarest("zzz") == []
    plan = index.candidates("folder7")._jdf.queryExecution().executedPlan().toString()
    blocks = plan[plan.index("block#") :].split("PartitionFilters: [", 1)[1].split("]")[0]
    read = {r.f for r in index.candidates("folder7").select(F.input_file_name().alias("f")).distinct().collect()}
    assert "block" in blocks and 0 < len(read) < every / 2
    assert "PushedFilters: [In(gram" in index.postings.where(F.col("gram").isin("abc", "bcd"))._jdf.queryExecution().executedPlan().toString()
    write_search_index(rows.where("false"), path + "0")
    assert SearchIndex(spark, path + "0").candidates("abc").count() == SearchIndex(spark, path + "0").candidates("a").count() == 0
    with pytest.raises(GraphError):
        SearchIndex(spark, path + "1")


def test_postings_are_packed(spark, tmp_path, monkeypatch):
    """Postings lie many to a row, and are those of each text on its own: wide characters, null, short and broken texts, slices and several bases too."""
    monkeypatch.setattr("cairn.sources.search_index.BLOCK", 400)
    nodes = [(f"file:{i}", "FILE", f"src/d{i % 3}/f{i}.go", None if i % 5 == 0 else f"N\U0001f600{i % 7}\u00df\u0130", "go", 1, 0) for i in range(1500)] + [("\u03a3", "FILE", "", "ab", "go", 1, 0)]
    rows = spark.createDataFrame(nodes, NODES)
    broken = rows.limit(1).withColumn("id", F.concat(F.lit("broken"), F.unhex(F.lit("FF")).cast("string"), F.lit("tail")))
    rows = rows.union(broken).repartition(3)
    write_search_index(rows, str(tmp_path / "index"))
    index = SearchIndex(spark, str(tmp_path / "index"))
    count = {}
    for own in rows.where("id not like 'broken%'").select(F.array(*(F.lower(c) for c in ("name", "path", "id"))).alias("t")).collect():
        for gram in {t[k : k + 3] for t in own.t if t for k in range(len(t) - 2)}:
            count[gram] = count.get(gram, 0) + 1
    places = index.postings.select("gram", F.explode("rows"))
    got = {r.gram: r.n for r in index.lists.where("gram <> ''").collect()}
    added = {g: got[g] - count.get(g, 0) for g in got if got[g] != count.get(g, 0)}
    assert set(count) <= set(got) and set(added.values()) == {1} and {"bro", "rok", "oke", "ken", "tai", "ail"} <= set(added)
    assert {r.gram: r["count"] for r in places.groupBy("gram").count().collect()} == got
    assert index.postings.count() * 5 < places.count()
    for text in ("\U0001f6003\u00df", "f1499", "oken", "tail", "d2/f11"):
        assert sorted(r.id for r in queries.search(index.candidates(text), text, (), 9).collect()) == sorted(r.id for r in queries.search(rows, text, (), 9).collect()), text
    batch = pa.RecordBatch.from_pydict({"block": pa.array([1, 1, 2, 1], pa.int32()), "place": pa.array([7, 3 << 33, 8, 1 << 32]), "name": ["abc", "abcabc", "xabc", None], "path": ["", "", "", "abcd"], "id": ["", "", "", "bcd"]})
    for size in (1 << 20, 3):
        monkeypatch.setattr("cairn.sources.search_index.SLICE", size)
        found = [(r["gram"], r["node_block"], r["base"] + k) for out in _postings([batch]) for r in out.to_pylist() for k in r["rows"]]
        assert sorted(found) == sorted([("abc", 1, 7), ("abc", 1, 3 << 33), ("bca", 1, 3 << 33), ("cab", 1, 3 << 33), ("xab", 2, 8), ("abc", 2, 8), ("abc", 1, 1 << 32), ("bcd", 1, 1 << 32)])


def test_repository(spark, tmp_path):
    """Rows for plain, empty and hidden files, links and unreadable names; pushed suffixes leave other files unread."""
    for path in ("a.go", "b/empty.py", "b/.hidden.py", "b/__init__.py", "c/d/e/deep.ts", "node_modules/x.js", "noext"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("" if "empty" in path else path)
    (tmp_path / "to_file.py").symlink_to(tmp_path / "a.go")
    (tmp_path / "to_folder").symlink_to(tmp_path / "b")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nothing")
    rows = {r.path: (r.status, r.content and bytes(r.content).decode()) for r in repository(spark, str(tmp_path)).collect()}
    plain = {p: ("read", p) for p in ("a.go", "b/.hidden.py", "b/__init__.py", "c/d/e/deep.ts", "noext")}
    assert {k: v for k, v in rows.items() if v[1]} == plain and rows["b/empty.py"][0] == "read"
    assert {k for k, v in rows.items() if v[0] == "link"} == {"to_file.py", "to_folder", "gone.py"} and len(rows) == 9
    assert counters(repository(spark, str(tmp_path)), "noext") == {"discovered": 8, "skipped": 3}
    some = repository(spark, str(tmp_path)).where("suffix in ('.go', '.ts')")
    assert {r.path for r in some.collect()} == {"a.go", "c/d/e/deep.ts"}
    reader = RepositoryReader(str(tmp_path))
    assert list(reader.pushFilters([EqualTo(("suffix",), ".go"), EqualTo(("path",), "x")])) == [EqualTo(("path",), "x")]
    assert [r["path"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["a.go"]
    with pytest.raises(GraphError):
        repository(spark, str(tmp_path / "none"))


def test_answered(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "path string")
    answered(asked, asked)
    for got in ([("a",)], [("a",), ("b",), ("b",)], [("a",), ("b",), ("c",)]):
        with pytest.raises(GraphError):
            answered(asked, spark.createDataFrame(got, "path string"))


def test_pagination(spark, tmp_path):
    """The stream's last state of every id, over several batches, is the fold of all events."""
    r = random.Random(3)
    events = [(f"n{r.randrange(7)}", r.choice([*pagination.EFFECTS, "other"]), i, 100 + i, i) for i in range(120)]
    schema = "id string, action string, next long, total long, at long"
    for k in range(0, 120, 40):
        spark.createDataFrame(events[k : k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda df, _: seen.update({x.id: tuple(x) for x in df.collect()})
    pagination.paged_stream(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    fold = {x.id: tuple(x) for x in pagination.paged(spark.createDataFrame(events, schema)).collect()}
    assert {k: v for k, v in seen.items() if k in fold} == fold and len(fold) == 7
    state = (None, None, False, False)
    for i, action, cursor, total, _ in events:
        if i == "n0" and action in pagination.EFFECTS:
            waits, opens = pagination.EFFECTS[action]
            state = (cursor, total) * (action == "loaded") or state[:2], waits if waits is not None else state[2], opens if opens is not None else state[3]
            state = (*state[0], *state[1:])
    assert fold["n0"] == ("n0", *state)


def test_probe(spark):
    """Calls, times and rows of three operators, without a job of its own; a probe that is off changes nothing."""
    probe, g = Probe(), packages(spark, "ABC", ["AB", "AC"])
    sc = spark.sparkContext
    jobs = lambda name: len(sc.statusTracker().getJobIdsForGroup(name))
    frames = [probe.rows(name, f) for name, f in (("projection", project_packages(g).graph.nodes), ("parents", parents(g)), ("imports", g.imports()))]
    sc.setJobGroup("probed", "")
    for name, f in zip(("projection", "parents", "imports"), frames):
        for _ in range(2 if name == "imports" else 1):
            probe.call(name, f.count)
    sc.setJobGroup("others", "")
    with pytest.raises(GraphError):
        probe.call("refused", children_page, g, "none", 0)
    got = {x.name: (x.calls, x.rows) for x in probe.report(spark).collect()}
    assert got == {"projection": (1, 3), "parents": (1, 0), "imports": (2, 2), "refused": (1, None)}
    sc.setJobGroup("plain", "")
    for f in (project_packages(g).graph.nodes, parents(g), g.imports(), g.imports()):
        f.count()
    sc.setJobGroup("others", "")
    assert jobs("plain") == jobs("probed") > 0
    off = Probe(False)
    assert off.rows("x", g.nodes) is g.nodes and off.call("x", lambda: 1) == 1 and off.report(spark).count() == 0
