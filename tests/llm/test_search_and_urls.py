"""Neighbours by their recall and exact scores; URL rules and trust over links."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import ann, url_graph


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 700)
    monkeypatch.setattr(ann, "QUERIES", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    x[50:80] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(None, [1.0] * 24, 0), (3000, None, 0), (3020, [0.0] * 24, 0), (3040, [float("nan")] * 24, 0), (3060, [None] * 24, 0), (3080, [], 0), (3100, [1.0, 2.0], 0), rows[7], rows[40]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).toPandas()
    full = x.astype(np.float64)
    hit = 0
    for q in range(0, 2000, 20):
        s = full @ full[q]
        best = [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and own.vec_id.is_unique
        assert np.allclose(own.score, s[own.vec_id]) and list(own.vec_id) == sorted(own.vec_id, key=lambda i: (-s[i], i))
        hit += len(set(best) & set(own.vec_id))
    assert hit / 2000 >= 0.9
    assert set(got.query_id) == set(range(0, 2000, 20))
    assert list(got[got.query_id == 40].sort_values("rank").vec_id)[:20] == list(range(50, 70))
    assert ann.nearest(table.where("false"), table.where("false"), 20).count() == 0
    few = ann.nearest(table.where("vec_id < 3"), table.where("vec_id = 0"), 20).collect()
    assert [r.vec_id for r in few if r.query_id == 0 and r.vec_id != 0] and len(few) == 2


def searched(x, queries, want):
    """(entries read a query and row, mean recall of the 20 nearest among the verified) of one block."""
    project = ann._projections(x.shape[1])
    block, places, level, hit = ann.Block(ann._lifted(x), project), ann._directions(x[queries]) @ project, ann.FIRST, 0
    for i, place in zip(queries, places):
        found, level = block.candidates(place, want, level)
        assert len(found) >= want
        hit += len(np.intersect1d(found, np.argsort(-(x @ x[i]))[:20]))
    return block.read / len(queries) / len(x), hit / len(queries) / 20


@pytest.mark.parametrize("moved", [0.0, 3.0])
def test_windows_hold_few_rows(moved):
    """A query reads a few entries a row (192 a level before), fewer the more rows there are, also of vectors that share a direction."""
    x = np.random.default_rng(6).normal(size=(16000, 64)) + moved
    (small, a), (large, b) = (searched(x[:n], np.arange(0, n, n // 50), 21 + int(7 * n**0.5)) for n in (2000, 16000))
    assert large < 16 and large < 0.9 * small and min(a, b) > 0.95


def test_level_follows_no_guess():
    """The narrowest level with enough rows is found from any start; where all are asked for, the last holds them."""
    x = np.random.default_rng(7).normal(size=(300, 5)).round(1)
    x[100:200] = x[7]
    project = ann._projections(5)
    block, place = ann.Block(ann._lifted(x), project), (ann._directions(x[7:8]) @ project)[0]
    for want in (1, 50, 150, 300):
        answers = [block.candidates(place, want, guess) for guess in (0, 20, 45, len(ann.LEVELS) - 1)]
        rows, level = answers[0]
        assert all(level == other and (rows == found).all() for found, other in answers) and len(rows) >= want
        assert level == 0 or len(block.candidates(place, len(rows) + 1, 0)[0]) > len(rows) or len(rows) == 300
    assert len(rows) == 300


PAGES = [
    (1, "http://a.com/x?q#f", '<a href="http://GOOD.org/">'), (2, "https://Bad.NET/z", None), (3, "http://x.example.net/en/1", ""), (4, "http://x.example.net/en2", ""), (5, "http://example.com/de/", ""), (6, "http://de.example.com/de", ""),
    (7, "http://q.org/fr/x", "<a href='//a.com/y'>"), (8, "no host", ""), (9, None, None), (10, "http://net", ""), (11, "http://b.com/", '<A HREF = "http://bad.net/">bad</a><a href="/own">'), (11, "http://b.com/", ""), (None, "ftp://c.com", "<a href=http://b.com/>"),
]


def test_rules_and_graph(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, verdict string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_graph.judge(pages).collect()}
    assert got[(1, "a.com", "/x")] == (None, "allow")  # linked from a trusted host
    assert got[(2, "bad.net", "/z")] == ("net/", "block")
    assert got[(3, "x.example.net", "/en/1")] == ("example.net/en/", "allow") and got[(4, "x.example.net", "/en2")] == ("net/", "block")
    assert got[(5, "example.com", "/de/")] == ("example.com/de/", "block") and got[(6, "de.example.com", "/de")][0] is None
    assert got[(7, "q.org", "/fr/x")] == ("org/fr/", "allow") and got[(8, "", "")] == (None, "allow") and got[(9, "", "")] == (None, "allow")
    assert got[(10, "net", "")][0] is None
    assert got[(11, "b.com", "/")] == (None, "block")  # links to a blocked host
    assert got[(None, "c.com", "")] == (None, "block")  # links to a host that does
    assert url_graph.judge(pages).count() == len(PAGES) and url_graph.judge(pages.where("false")).count() == 0


def test_scores_against_plain_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "c", 1.0), ("d", "c", 5.0)]
    hosts = [("a", 3.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 2.0), ("d", 1.0, 0.0)]
    got = {r.host: (r.trust, r.distrust) for r in url_graph.host_scores(spark.createDataFrame(hosts, "host string, trusted double, blocked double"), spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    for k, along in ((0, True), (1, False)):
        seed = {h[0]: h[1 + k] / sum(x[1 + k] for x in hosts) for h in hosts}
        way = [(a, b, w) if along else (b, a, w) for a, b, w in edges]
        out = {h: sum(w for a, _, w in way if a == h) for h in seed}
        r = dict(seed)
        for _ in range(300):
            r = {h: (1 - url_graph.DAMPING) * seed[h] + url_graph.DAMPING * sum(r[a] * w / out[a] for a, b, w in way if b == h) for h in seed}
        assert all(abs(got[h][k] - r[h]) < 1e-5 for h in r)


def test_domains(spark):
    """A blocked domain's subdomains are distrusted, however deep; hosts of numbers have no domain."""
    hosts = [(1, "a.bad.com"), (2, "x.a.bad.com"), (3, "y.x.a.bad.com"), (4, "1.2.3.4"), (5, "z.good.com")]
    rules = (("block", "a.bad.com", "/spam"),)
    pages = [(10, "http://a.bad.com/spam/1", "")] + [(i, f"http://{h}/p", "") for i, h in hosts if i > 1]
    got = {r.page_id: r for r in url_graph.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {i: got[i].verdict for i in got} == {10: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert {i: got[i].decided for i in got} == {10: "rule", 2: "scores", 3: "scores", 4: "default", 5: "default"}
    edges = url_graph.domain_edges(spark.createDataFrame([("y.x.a.com", 2), ("x.a.com", 3), ("1.2.3.4", 1), ("com", 1), (None, 1)], "host string, n long")).collect()
    assert sorted(map(tuple, edges)) == [("x.a.com", "a.com", 5.0), ("y.x.a.com", "x.a.com", 2.0)]


def test_rules_of_one_length(spark):
    """Of fitting rules of one length the later listed one decides; very long html has its links read to the end."""
    pages = spark.createDataFrame([(1, "http://a.com/x", "<p>" * 400_000 + '<a href="http://b.com/">'), (2, "http://b.com/z", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_graph.judge(pages, (("allow", "a.com", "/x"), ("block", "a.com", "/"), ("block", "b.com", "/z"))).collect()}
    assert got == {1: ("a.com/x", "allow"), 2: ("b.com/z", "block")}
    got = {r.page_id: (r.rule, r.verdict) for r in url_graph.judge(pages, (("block", "b.com", "/z"),)).collect()}
    assert got[1] == (None, "block")  # its link stands behind a million characters


def test_neighbours_of_permuted_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 300)
    x = np.random.default_rng(4).normal(size=(900, 16)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    answers = []
    for order in (range(900), np.random.default_rng(5).permutation(900)):
        table = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>").repartition(3)
        answers.append(sorted(map(tuple, ann.nearest(table, table.where("vec_id % 20 = 0"), 20).collect())))
    assert answers[0] == answers[1] and len(answers[0]) == 45 * 20


def test_host_and_path(spark):
    row = spark.createDataFrame([("HTTP://A.b:80/P/Q?x=/y#z",), ("x://y://z/",)], "url string").select(url_graph.host_of(F.col("url")), url_graph.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in row] == [("a.b:80", "/P/Q"), ("y:", "//z/")]
