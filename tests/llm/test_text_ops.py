"""Operators on documents against brute force, on rows with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import common, langid, lm, media, mixing, ngram_join, packing, quality, substring_dedup
from cairn.llm.ngram_join import ngram_components
from tests.llm.conftest import make_docs, words


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_word_spans_and_hashes():
    texts = [None, "", " a\tb ", "x", "Ab aB ab", "é日  ab"]
    raw, offsets = common.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = common.word_spans(raw, offsets)
    got = [[bytes(raw[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [words(t) for t in texts]
    h = common.word_hashes(raw, starts, ends, lower=True)
    assert len({int(h[i]) for i in range(first[4], first[5])}) == 1 and h[first[5] + 1] == h[first[4]]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_ngram_components(docs, none, size, percent):
    data, sets = make_docs(), {}
    for x in data:
        w = words(x[1], lower=True)
        sets.setdefault(x[0], set()).add(frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset())
    flat = [(i, s) for i, own in sets.items() for s in own if i is not None]
    parent = {i: i for i, _ in flat}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in flat:
        for j, b in flat:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = rows_of(ngram_components(docs, size, percent))
    want = sorted(((x[0], len(next(iter(sets[x[0]]))), None if x[0] is None else find(x[0])) for x in data), key=str)
    assert got == want and len({w[2] for w in want}) < len(want) - 5
    assert ngram_components(none, size, percent).count() == 0


@pytest.mark.parametrize("group", [100_000, 40])
def test_remove_repeats(docs, none, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", group)
    data = [(x[0], words(x[1])) for x in make_docs()]
    first = {}
    for i, w in data:
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in data:
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    out = substring_dedup.remove_repeats(docs)
    assert {"lang", "source", "score", "n"} <= set(out.columns)
    assert rows_of(out.select("doc_id", "n_words", "n_removed", "kept_text")) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 300
    assert substring_dedup.remove_repeats(none).count() == 0


def test_internal_nodes():
    """Against the nodes of a trie over random words: a node has two different ways on, or a suffix that ends there."""
    r = random.Random(7)
    leaves = sorted(tuple(r.choice("ab") for _ in range(5)) for _ in range(40))
    lcp = np.array([next((k for k in range(5) if a[k] != b[k]), 5) for a, b in zip(leaves, leaves[1:])])
    got = {(depth, a, b) for depth, begin, end in substring_dedup.internal_nodes(lcp) for a, b in zip(begin.tolist(), end.tolist())}
    want = set()
    for depth in range(1, 6):
        for prefix in {x[:depth] for x in leaves}:
            under = [i for i, x in enumerate(leaves) if x[:depth] == prefix]
            if len(under) > 1 and (depth == 5 or len({leaves[i][depth] for i in under}) > 1):
                want.add((depth, under[0], under[-1] + 1))
    assert got == want and len(got) > 20


def test_fragments_are_ranges_of_the_order(docs, monkeypatch):
    """Every n-gram of a fragment stands before those of the next ones in the order by count, and heads count what is before."""
    scratch = common.Scratch(docs.sparkSession)
    own = ngram_join._columns(docs).distinct()
    sets = ngram_join._profiles(own, 3).where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("d"), F.first("n").alias("n"))
    rows = ngram_join.segments_of(own, sets, 3, 1, scratch).collect()  # one per cent: hardly any set is left out
    counts = collections.Counter(g for g, _ in {tuple(r) for r in ngram_join._postings(own.where("doc_id is not null").select("text"), 3, 1).collect()})
    placed = {}
    for r in rows:
        assert list(r.grams) == sorted(r.grams, key=lambda g: (counts[g], g)) and min(counts[g] for g in r.grams) > 1
        for g in r.grams:
            assert placed.setdefault(g, r.fragment) == r.fragment
    ends = [[(counts[g], g) for g, f in placed.items() if f == k] for k in sorted(set(placed.values()))]
    assert len(ends) > 3 and all(max(a) < min(b) for a, b in zip(ends, ends[1:]))
    sizes = collections.Counter()
    for r in rows:
        sizes[r.sid] += len(r.grams)
    for r in rows:
        assert r.head == r.n - sizes[r.sid] + sum(len(q.grams) for q in rows if q.sid == r.sid and q.fragment < r.fragment)


def test_hot_ngrams(spark, monkeypatch):
    """An n-gram of nearly all sets, and posting lists in many parts: the same components and links as with none."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{base} x{i // 3} y{i // 6}" if i % 5 else f"a{i} b{i} w0 w1 w2 c{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, ngram_join.ngram_components(docs, 3, 90).collect()))
    links = {tuple(r) for r in ngram_join.ngram_links(docs, 3, 90)[0].collect()}
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 2)
    monkeypatch.setattr(ngram_join, "LIST", 3)
    old, seen = ngram_join.hot_join, []
    monkeypatch.setattr(ngram_join, "hot_join", lambda rows, counted, key, count, total: (seen.append(counted.where(F.col(count) > 2).count()), old(rows, counted, key, count, 0))[1])
    assert sorted(map(tuple, ngram_join.ngram_components(docs, 3, 90).collect())) == plain
    assert {tuple(r) for r in ngram_join.ngram_links(docs, 3, 90)[0].collect()} == links and len(links) > 50 and min(seen[:2]) > 0


def test_ngram_links(docs):
    """All links between different sets, not only those that components need."""
    links, members = ngram_join.ngram_links(docs, 3, 60)
    name = {}
    for x in make_docs():
        w = words(x[1], lower=True)
        if w and x[0] is not None:
            own = frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2)))
            name[own] = min(x[0], name.get(own, x[0]))
    first = {}
    for m in members.collect():
        first.setdefault(m.sid, []).append(m.doc_id)
    want = {frozenset((name[a], name[b])) for a in name for b in name if a != b and 100 * len(a & b) >= 60 * len(a | b)}
    got = {frozenset((min(first[r.u]), min(first[r.v]))) for r in links.collect()}
    assert got == want and len(want) > 3


def test_packing(docs, none):
    packed = packing.pack_documents(docs).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = collections.Counter()
    for x in make_docs():
        ids = tokenizer.encode(x[1] or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(packing.pieces_of(len(ids), 2048)):
            want[(x[0], k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    got = collections.Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in packed.itertuples())
    assert got == want
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert packed.sequence_id.nunique() == -(-packed.length.sum() // 2048)
    assert packing.pack_documents(none).count() == 0


def test_packing_tree(spark, monkeypatch):
    """Small groups: rounds of the tree keep sequences gapless, and for each group at most a few more than best fit over all rows at once makes."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 150)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2049, 1500)
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    out = packing.pack(pieces).toPandas()
    assert len(out) == 1500
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    at_once = packing.best_fit(np.sort(sizes)[::-1], 2048)[0].max() + 1
    assert out.sequence_id.nunique() <= at_once + 10 * 2


def test_encoder_equals_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = ["", "  ", "a  b", " a", "a ", "\n x", "x \n y", "it's 's  's", "<|endoftext|> a<|endoftext|>", " x　 y", "日本 語 12 3.5 a\tb \x1c c", "'ll we 'll", *(x[1] for x in make_docs() if x[1])]
    ids = packing.Ids(path)
    assert [np.frombuffer(ids.of(t), "<u4").tolist() for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_mixing(docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 900)
    out = mixing.mixed_sizes(docs)
    got = rows_of(out)
    assert got == rows_of(mixing.mixed_sizes(docs))
    size = {}
    for x in make_docs():
        size[x[3]] = size.get(x[3], 0) + len(words(x[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([size[s] for s in order])))
    assert math.isclose(sum(goal.values()), 1.5 * sum(size.values())) and all(goal[s] <= 2 * size[s] + 1e-9 for s in size)
    taken = out.join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 0.1 * r.g + 200 for r in taken)
    assert all(r[4] in (0, r[1], 2 * r[1]) for r in got) and len(got) == len(make_docs())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_long_documents_leave_no_gap(spark, monkeypatch):
    """Many sources with one document far longer than a block: what fits is taken, so a target is missed by less than a usual document.

    Only where the long one does not fit and no usual document is left is there nothing to fill with (or the long one alone is nearer).
    """
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 1500)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 20000)
    r = random.Random(8)
    rows = [(1000 * s + k, "w " * (6000 if k == 0 else r.randint(30, 50)), f"s{s:02}") for s in range(60) for k in range(150)]
    sources = collections.defaultdict(list)
    for x in mixing.mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert x.taken <= 2 * x.size
        sources[x.doc_id // 1000].append(x)
    close = 0
    for rows in sources.values():
        miss, passes = rows[0].target - sum(x.taken for x in rows), int(rows[0].target // rows[0].source_size)
        close += abs(miss) < 30
        assert abs(miss) < 30 or all(x.taken == (passes + 1) * x.size for x in rows if (x.size < 100) == (miss > 0))
    assert len(sources) == 60 and close > 45


def test_splitting_tree_is_exact():
    quotas = np.array([7, 0, 120, 33])
    frames = __import__("pandas").DataFrame({"id": range(9)})
    rows = next(mixing._shard_draws(quotas, 9, 5)(iter([frames])))
    for s in np.flatnonzero(quotas):
        own = rows[rows.number == s].sort_values("first")
        assert own.units.sum() == quotas[s] and list(own["first"]) == [0, *own.units.cumsum()[:-1]]
    per_shard = rows.groupby("shard").units.sum()
    assert per_shard.max() - per_shard.min() <= 1


def test_quality(spark, docs, none):
    labelled = [(i, "plain words of a text here " * (i % 7 + 1) if i % 3 else "W!! X$$$ Y### " * (i % 5 + 1)) for i in range(300)]
    frame = spark.createDataFrame(labelled, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train_quality(frame, labels)
    out = quality.score_quality(frame, model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in out if r.doc_id % 2]) > 0.95
    scored = quality.score_quality(docs, model)
    assert scored.columns[-1] == "score" and scored.columns.count("score") == 1
    assert scored.where("score between 0 and 1").count() == docs.count()
    assert quality.score_quality(none, model).count() == 0
    assert quality.train_quality(none, labels) is None and quality.score_quality(docs, None).where("score = 0.5").count() == docs.count()


def test_pairwise_identity():
    """The linear-time form equals the sum over pairs."""
    rng = np.random.default_rng(0)
    model = {"w0": np.array([0.3]), "w": rng.normal(size=9), "v": rng.normal(size=(9, 3))}
    ids, values = np.arange(9), rng.normal(size=9)
    pairs = sum(model["v"][i] @ model["v"][j] * values[i] * values[j] for i in range(9) for j in range(i))
    assert np.isclose(quality._forward(model, ids, values, np.array([0, 9]))[0][0], 0.3 + model["w"] @ values + pairs)


def test_language(spark, docs, none):
    known = [("der die das und nicht ein schönes Haus", "de"), ("the and of with this house that", "en"), ("le la les une maison très belle", "fr"), (None, "fr"), ("x", None)] * 5
    model = langid.learn(spark.createDataFrame(known, "text string, lang string"))
    asked = ["das ist nicht schön", "this and that", "une belle maison", None, "", "12 ?!"]
    out = langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["de", "en", "fr", "und", "und", "und"] and all(0 <= r.score <= 1 for r in out)
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(none)).collect()} == {"und"}


def test_filter_returns_all_languages(spark):
    """The first slice has every language that contains a trigram, however rare it is there; the cells follow the distinct trigrams."""
    texts = [("abc def", "x"), ("xyz " * 50 + "abc", "y")] + [("abc " * 200, "x")]
    model = langid.learn(spark.createDataFrame(texts, "text string, lang string"))
    assert model["languages"] == ["x", "y"] and len(model["cells"]) == langid.FEWEST
    for text, lang in texts:
        keys, _ = langid.trigrams(pa.array([text]))
        masks = langid.containing(keys, model["cells"])[:, :, 0]
        assert (masks[:, 0] >> model["languages"].index(lang) & 1).all()
    many = [(" ".join("".join(w) for w in np.random.default_rng(k).choice(list("abcdefghijklmnopqrstuvwxyz"), (4000, 3))), "xy"[k]) for k in range(2)]
    model = langid.learn(spark.createDataFrame(many, "text string, lang string"))
    distinct = len(set(langid.trigrams(pa.array([t for t, _ in many]))[0].tolist()))
    fill = (model["cells"][:, 0, 0] & 1).mean()
    assert len(model["cells"]) >= langid.ROOM * distinct and fill < 0.4


def test_language_ties(spark):
    """Of languages with equal scores the first in order wins."""
    model = langid.learn(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    out = langid.predict(spark.createDataFrame([(1, "same words"), (2, "123"), (3, None)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(out)] == [(1, "a"), (2, "und"), (3, "und")]


def test_language_model(docs, none):
    train = docs.where("doc_id is null or doc_id % 3 <> 0")
    model, counts = lm.train(train)
    got = rows_of(lm.score(docs, model, counts).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)))
    c, ends = collections.Counter(), 0
    for x in make_docs():
        if x[0] is None or x[0] % 3:
            c.update(words(x[1], lower=True))
            ends += 1
    total, distinct = sum(c.values()) + ends, len(c) + 1
    want = []
    for x in make_docs():
        w = words(x[1], lower=True)
        base = sum(math.log10((n + 1) / (total + distinct + 1)) for n in (*(c[t] for t in w), ends))
        want.append((x[0], len(w) + 1, sum(c[t] > 0 for t in w) + 1, total, round(base, 6)))
    want = sorted(want, key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want] and all(abs(g[4] - w[4]) < 1e-4 for g, w in zip(got, want))
    assert lm.score(none, model, counts).count() == 0
    empty, no_counts = lm.train(none)
    assert lm.score(docs, empty, no_counts).where("n_known = 0 and score < 0").count() == docs.count()


def test_all_training_documents_shape_the_network(spark):
    """Words that only alternate in documents behind the first 1,024 by hash: order is learnt there or nowhere."""
    r = random.Random(4)
    ranked = [x.id for x in spark.range(1600).orderBy(F.xxhash64("id"), "id").collect()]
    mixed = lambda: " ".join(r.sample(["p", "q"] * 20, 40))
    rows = [(k, mixed() if place < 1024 else " ".join(["p q"] * 20)) for place, k in enumerate(ranked)]
    model, counts = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    pair = spark.createDataFrame([(0, " ".join(["p q"] * 20)), (1, " ".join(["p p q q"] * 10))], "doc_id long, text string")
    score = {x.doc_id: x.score for x in lm.score(pair, model, counts).collect()}
    assert score[0] > score[1] + 3


def test_training_reads_every_token():
    n = 5 * lm.LANES * lm.WINDOW + 37
    stream = np.arange(n + 1)
    for start, stop in ((0, n), (0, 7), (n - 50, n + 50), (11, 11 + lm.LANES)):
        runs = list(lm.windows(stream, start, stop))
        assert set(np.concatenate([goal.ravel() for _, goal in runs])) == {i % n + 1 for i in range(start, stop)} and all((goal == ids + 1).all() for ids, goal in runs)
    assert lm.lanes_of(lm.SHARD // lm.ROUNDS)[0] > 200 and lm.lanes_of(100_000)[0] < 30
    shared = types.SimpleNamespace(value=lm.initial(np.ones(lm.VOCABULARY)))
    rows = pa.RecordBatch.from_pydict({"shard": [0, 0, 1], "ids": [np.full(k, 5, np.uint16).tobytes() for k in (3000, 41, 7)]})
    read = collections.Counter()
    for turn in range(lm.ROUNDS):
        for out in lm._fit_task(shared, turn, 1)(iter([rows])):
            read[out.column("shard")[0].as_py()] += out.column("n")[0].as_py()
    assert read == {0: 3041, 1: 7}


def test_network_gradients_and_proper_probability():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in lm.initial(rng.random(lm.VOCABULARY)).items()}
    h = rng.normal(size=(1, lm.HIDDEN))
    every = np.arange(lm.VOCABULARY)
    assert np.isclose(np.exp(lm.log_likelihood(p, np.repeat(h, len(every), 0), every)).sum(), 1)
    ids, goal = rng.integers(0, lm.VOCABULARY, (5, 3)), rng.integers(0, lm.VOCABULARY, (5, 3))
    start = np.zeros((3, lm.HIDDEN))
    _, g, _ = lm.gradients(p, ids, goal, start)
    for name, at in (("u", (3, 40)), ("x", (2, 5)), ("c", (1, 7)), ("xb", (9,)), ("e", (int(ids[1, 1]), 4)), ("w", (int(goal[2, 0]) // lm.PER_CLASS, 3, int(goal[2, 0]) % lm.PER_CLASS))):
        old, step = p[name][at], 1e-5
        p[name][at] = old + step
        up = lm.gradients(p, ids, goal, start)[0]
        p[name][at] = old - step
        down = lm.gradients(p, ids, goal, start)[0]
        p[name][at] = old
        assert np.isclose((up - down) / (2 * step), g[name][at], rtol=1e-3, atol=1e-8)


def test_state_is_carried():
    """A document's likelihood does not depend on where windows fall or which documents run beside it."""
    rng = np.random.default_rng(4)
    p = lm.initial(rng.random(lm.VOCABULARY))
    texts = [rng.integers(0, lm.VOCABULARY, n) for n in (1, 70, 3, 24, 25)]
    ends = np.cumsum([len(t) for t in texts])
    together = lm.document_log_likelihoods(p, np.concatenate(texts), ends)
    alone = [lm.document_log_likelihoods(p, t, np.array([len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)


def test_media_round_trip(docs, none):
    stored = media.store_texts(docs)
    got = rows_of(media.read_texts(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    want = []
    for x in make_docs():
        raw = (x[1] or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((x[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert got == sorted(want, key=str)
    assert media.read_texts(media.store_texts(none)).count() == 0


def test_media_bytes_and_clips(spark):
    rng = np.random.default_rng(0)
    for payload in (np.zeros(192, np.uint8), np.full(576, 255, np.uint8), rng.integers(0, 256, 192 * 40).astype(np.uint8)):
        frames = media.encode_frames(payload)
        back, fps, error = media.read_avi(media.write_avi(frames))
        assert error is None and back == frames and fps == media.FPS
        assert b"".join(f.tobytes() for f in media.decode_frames(back)) == payload.tobytes()
    scene = np.concatenate([np.full(192 * 30, 20), np.full(192 * 20, 200), np.full(192 * 25, 90)]).astype(np.uint8)
    good = media.write_avi(media.encode_frames(scene))
    videos = spark.createDataFrame([(1, good), (2, None), (3, b"junk"), (4, good[:-40]), (5, media.write_avi([b"\xff\xd8\xff\xd9"])), (6, media.write_avi([]))], "id long, media binary")
    out = media.clips(videos).collect()
    assert [(r.first_frame, r.frames) for r in sorted((r for r in out if r.id == 1), key=lambda r: r.clip)] == [(0, 30), (30, 20), (50, 25)]
    assert {r.id for r in out if r.error} == {2, 3, 4, 5} and all(r.clip is None for r in out if r.error)
