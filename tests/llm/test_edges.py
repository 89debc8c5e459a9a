"""Pipeline stages and registered results on rows with nulls, ties, repeats, long and empty texts, against brute force."""

import collections
import itertools
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import common, langid, mixing, quality
from tests.llm.conftest import make_docs, words

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, docs, none, name, stage):
    """Null ids, texts, languages, sources and sizes, repeated rows and columns with clashing names; then an empty table."""
    out = stage(spark, docs, DATA)
    rows = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in rows} <= {x[0] for x in make_docs()} and rows
    if name in ("n-gram Jaccard join", "substring dedup"):
        assert None in {r.doc_id for r in rows}  # a row without an id is in no group and is kept whole
    empty = stage(spark, none, DATA)
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_survives_no_rows(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_against_all_pairs(spark):
    """The linear-time score is the sum over all pairs of features; repeated rows score alike; metadata counts."""
    texts = [f"good words here {k}" if k % 2 else f"BAD!!! $$$ {k} <<>>" for k in range(60)] + [None, "", "x " * 5000]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)] + [(0, texts[0], len(texts[0]))], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (41, None)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    got = collections.defaultdict(set)
    for r in quality.score_quality(docs, model).collect():
        got[r.doc_id].add(r.score)
    stats, cells = quality.features(pa.array(texts, pa.string()), pa.array([len(t or "") for t in texts], pa.int64()))
    ids, values, first = quality._design(stats, cells, *(model[k] for k in ("mean", "scale", "low", "high")))
    for k in (0, 1, 7, 60, 61):
        i, x = ids[first[k] : first[k + 1]], values[first[k] : first[k + 1]]
        z = model["w0"][0] + (model["w"][i] * x).sum() + sum((model["v"][a] * model["v"][b]).sum() * xa * xb for (a, xa), (b, xb) in itertools.combinations(zip(i, x), 2))
        assert len(got[k]) == 1 and abs(next(iter(got[k])) - 1 / (1 + math.exp(-z))) < 1e-9
    assert all((min(got[k]) >= 0.5) == bool(k % 2) for k in range(40, 60))
    bare = quality.score_quality(docs.drop("n_chars"), model)
    assert bare.columns == ["doc_id", "text", "score"] and bare.count() == len(texts) + 1


def test_language_against_exact_sets(spark):
    """Every prediction is the language of the best mean share over the slices, counted with exact sets instead of the filter."""
    rng = np.random.default_rng(8)
    pools = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(80)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnop"))}
    rows = [(k, " ".join(rng.choice(pools[lang], 12)) + (" stray" if k % 9 == 0 else ""), lang) for k in range(90) for lang in [("aa", "bb", "cc")[k % 3]]]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "abc", None), (None, rows[0][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.where("doc_id is null or doc_id < 60 or doc_id >= 900")
    model = langid.learn(train)
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for d, t, lang in rows:
        if t is not None and lang is not None and (d is None or d < 60 or d >= 900):
            for key in langid.trigrams(pa.array([t]))[0].tolist():
                counts[key][lang] += 1
                total[lang] += 1
    rate = {key: {lang: n / total[lang] for lang, n in c.items()} for key, c in counts.items()}
    names = sorted(total)
    for r in langid.predict(docs, model).collect():
        keys = langid.trigrams(pa.array([r.text]))[0].tolist()
        if not keys:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = {lang: np.mean([np.mean([lang in rate.get(k, {}) and rate[k][lang] >= s * max(rate[k].values()) for s in langid.SLICES]) for k in keys]) for lang in names}
        assert abs(share[r.lang_pred] - max(share.values())) < 0.05 and abs(r.score - share[r.lang_pred]) < 0.05


def test_mix_against_plain_targets(spark, docs):
    """Targets by plain reshare; every source's taken words near its target; each row a whole number of times, at most twice; reruns agree."""
    rows = [(x[0], x[3], len(words(x[1]))) for x in make_docs()]
    sizes = collections.Counter()
    for _, source, n in rows:
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, live, rest = {}, set(order), 1.5 * sum(sizes.values())
    while live:
        over = [s for s in live if rest * weight[s] / sum(weight[x] for x in live) > 2 * sizes[s]]
        for s in over or list(live):
            target[s] = 2.0 * sizes[s] if over else rest * weight[s] / sum(weight[x] for x in live)
        if not over:
            break
        rest -= sum(target[s] for s in over)
        live -= set(over)
    got = mixing.mixed_sizes(docs.select("doc_id", "text", "source", "n")).join(docs.select("doc_id", F.col("source").alias("s")).distinct(), "doc_id", "left").collect()
    again = mixing.mixed_sizes(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)
    taken = collections.Counter()
    by_size = {round(sizes[s], 6): s for s in order}
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - target[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in order:
        # whole passes over the source, and the nearest sum that rows taken once more can have; rows alike are taken together
        whole = int(target[s] // sizes[s]) * sizes[s] if sizes[s] else 0
        alike, sums = collections.Counter((d, n) for d, x, n in rows if x == s and n), {whole}
        for (_, n), k in alike.items():
            sums |= {x + n * k for x in sums}
        nearest = min(abs(x - target[s]) for x in sums)
        assert abs(taken[s] - target[s]) <= nearest + 0.05 * sizes[s], (s, taken[s], target[s], nearest, sizes[s])


def test_folds(spark):
    """Folds follow the number's decimal text; of a null there is none."""
    rows = spark.createDataFrame([(12,), (7,), (None,)], "doc_id long").select("doc_id", quality.fold("doc_id", 3).alias("fold")).collect()
    assert {r.doc_id: r.fold for r in rows} == {12: zlib.crc32(b"12") % 3, 7: zlib.crc32(b"7") % 3, None: None}


def test_scratch_is_deleted(spark):
    scratch = common.Scratch(spark)
    kept, gone = scratch.table(spark.range(5)), scratch.table(spark.range(3))
    scratch.drop(gone)
    assert kept.count() == 5
    assert not os.path.exists(scratch.paths[gone].removeprefix("file:")) and os.path.exists(scratch.paths[kept].removeprefix("file:"))


def test_language_filter_as_a_table(docs, none):
    """A filter beyond the bound is joined to: the same fill, languages and scores, for odd rows and with clashing names."""
    train = docs.where("lang is not null")
    small, large = langid.learn(train), langid.learn(train, most_masks=0)
    assert "table" in large and "cells" in small and np.allclose(small["fill"], large["fill"]) and small["size"] == large["size"]
    asked = docs.withColumns({"h": F.lit("own"), "word": F.lit(1), "key": F.lit(2), "best": F.lit("b")})
    rows = lambda model: sorted(((r.doc_id is None, r.doc_id or 0, r.h, r.word, r.key, r.lang_pred, round(r.score, 9)) for r in langid.predict(asked, model).collect()))
    assert rows(small) == rows(large) and {r[5] for r in rows(large)} >= {"und", "en", "de"}
    assert langid.predict(none, large).count() == 0 and langid.predict(asked, large).columns == langid.predict(asked, small).columns
