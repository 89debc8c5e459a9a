"""Centroid clusters, hard negatives and exact top-k against brute force, on odd rows too."""

import hashlib
import math

import numpy as np
import pytest

from cairn.llm import hard_negatives, impact_search, vectors
from cairn.llm.centroids import Centroids, Rotation, cluster
from cairn.llm.hard_negatives import Lists, mine, window
from cairn.llm.impact_search import Postings, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score double, cluster string, x int"


def make_rows(dim=6, n=160, seed=5):
    """Vectors with ties, copies, repeated rows, odd components, other dimensions and null columns."""
    r = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in np.round(r.normal(size=dim), 1)], int(r.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[i % 3][1], i % 2) for i in range(20)]  # a large group of copies
    rows += [rows[0], rows[50], (50, [9.0] * dim, 9)]  # repeated rows, and another of one vec_id
    rows += [(500, None, 1), (550, [1.0] * (dim - 1) + [None], 1), (600, [float("nan")] * dim, 1), (650, [math.inf] * dim, 1), (700, [1.0] * dim, None)]
    rows += [(750, [0.5] * (dim - 1), 1), (751, [0.25] * (dim - 1), 2), (752, [0.5] * (dim - 1), 1), (800, [], 1), (801, [], 1), (802, [], 2), (850, [0.0] * dim, 3), (None, [1.0] * dim, 2), (None, [2.0] * dim, 2)]
    return [(*x, 0.5, "clash", 1) for x in rows]


def ints(e):
    """The integer vector, or None where it takes no part."""
    if e is None or any(v is None or not math.isfinite(v) for v in e):
        return None
    return [math.floor(256 * float(np.float32(v))) for v in e]


def single(rows):
    """{(vec_id, dim): (label, x)} as the searches count repeated rows."""
    out = {}
    for i, e, label, *_ in rows:
        x = ints(e)
        if i is not None and x is not None:
            key = (i, len(x))
            out[key] = min(out.get(key, (label, x)), (label, x), key=lambda v: (v[0] is None, v))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(make_rows(), SCHEMA)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(impact_search, "ROWS", 40)
    monkeypatch.setattr(impact_search, "QUERIES", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)


def test_top_k(odd, small_blocks):
    got = {}
    for r in top_k(odd, odd.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    rows = {}
    for i, e, *_ in make_rows():
        x = ints(e)
        if i is not None and x is not None:
            rows[i, len(x)] = min(rows.get((i, len(x)), x), x)
    want = {}
    for (i, d), q in rows.items():
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for (j, dim), x in rows.items() if dim == d and j != i)
            want[i] = {k + 1: (j, -s) for k, (s, j) in enumerate(scored[:5])}
    assert got == {i: v for i, v in want.items() if v}
    assert set(got) >= {0, 50, 100, 150, 750, 800, 850} and len(got[750]) == 2


def test_hard_negatives(odd, small_blocks):
    got = {tuple(r) for r in mine(odd, odd.where("vec_id % 50 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}
    rows = {k: v for k, v in single([x for x in make_rows() if x[2] is not None]).items()}
    want = set()
    for (i, d), (label, q) in rows.items():
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j, own) for (j, dim), (own, x) in rows.items() if dim == d and j != i)
            for p, j, _ in [s for s in scored if s[2] == label][:5]:
                fit = [(s, m) for s, m, own in scored if own != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
                want |= {(i, j, k + 1, m, -p, -s) for k, (s, m) in enumerate(fit)}
    assert got == want and len(want) > 20 and any(w[0] == 800 for w in want)


def test_window():
    for score in range(-30, 31):
        a, b = window(score, 50, 95)
        assert [s for s in range(-40, 41) if 50 * score <= 100 * s <= 95 * score] == list(range(a, b + 1))


@pytest.mark.parametrize("scale", [1, 40, 3000])
def test_index_stops_on_proof(scale):
    """Blocks with few and many levels, ties and zeros: the exact rows, with fewer postings read than there are."""
    r = np.random.default_rng(scale)
    x = np.round(r.normal(size=(2000, 24)) * scale)
    ids = np.sort(r.choice(10**6, 2000, replace=False))
    index = Postings.build(ids, x)
    for i in range(0, 2000, 40):
        rows, scores = index.search(ids[i], x[i], 5)
        exact = x @ x[i]
        want = [j for j in np.lexsort((ids, -exact)) if j != i][:5]
        assert rows.tolist() == want and scores.tolist() == exact[want].tolist()
    if scale > 1:
        assert index.read < 0.8 * 50 * x.size and index.scored < 0.4 * 50 * len(x)


def test_threshold_algorithm_stops():
    """With one strong dimension few rows are met; the rows found are the best by brute force."""
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(3000, 8)) * [1000, 3, 3, 3, 3, 3, 3, 3])
    ids, labels = np.arange(3000), np.arange(3000) % 3
    lists = Lists.build(ids, labels, x)
    for i in range(0, 3000, 100):
        q = x[i]
        at = int(np.flatnonzero(lists.ids == i)[0])
        rows, scores = lists.positives(i, labels[i], q, 5)
        exact = lists.x @ q
        want = [j for j in np.lexsort((lists.ids, -exact)) if j != at and lists.labels[j] == labels[i]][:5]
        assert rows.tolist() == want
        (found, _), = lists.negatives(labels[i], q, [window(int(exact[at]), 50, 95)], 3)
        fit = [j for j in np.lexsort((lists.ids, -exact)) if lists.labels[j] != labels[i] and 50 * exact[at] <= 100 * exact[j] <= 95 * exact[at]][:3]
        assert found.tolist() == fit
    assert lists.scored < 0.5 * 30 * 2 * len(x)


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, ints(e)) for i, e, *_ in rows if ints(e) is not None and len(e) == dim]
    order = sorted(kept, key=lambda v: (v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest(), v[1]))
    places = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(places))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        places = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(places)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    told = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(places)}
    total = lambda rows: sum(d for _, _, d in rows)
    return sorted(((i is None, i or 0), n, d, total([f for f in found if f[1] == n]), total(found), told[n]) for i, n, d in found)


@pytest.mark.parametrize("k", [7, 400])
def test_clusters(odd, k):
    """Repeated rows start two centroids, of which the second stays empty; 400 are more than there are vectors."""
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in cluster(odd, k, 3, 6).collect())
    assert got == brute_clusters(make_rows(), k, 3, 6)


def test_bounds_rule_out_only_far_centroids():
    """Vectors along a few axes: the exact nearest centroids, with most distances never computed."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(500, 16)) * ([400] * 3 + [5] * 13))
    places = x[:40]
    _, axes = np.linalg.eigh(np.cov(x.T))
    rotation = Rotation(x.mean(0), axes[:, ::-1], 3)
    got, distance, verified = Centroids(rotation, places).assign(x, *rotation.apply(x))
    exact = ((x[:, None, :] - places[None]) ** 2).sum(2)
    assert (got == exact.argmin(1)).all() and (distance == exact.min(1)).all() and verified < 0.1 * exact.size


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, empty).count() == mine(empty, empty).count() == cluster(empty).count() == 0


def test_refuses_what_is_not_exact(spark):
    rows = spark.createDataFrame([(1, [1e6], 1, 0.5, "c", 1)], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        vectors.integer_vectors(rows).collect()
