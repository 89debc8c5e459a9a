"""The numbered queries' columns, their SQL, and the pipeline's stages on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from cairn.llm import common
from cairn.llm.ngram_join import ngram_components
from cairn.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
COLUMNS = {
    "op1": ["doc_id", "n_shingles", "component_id"],
    "op2": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op3": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4": ["query_id", "rank", "vec_id", "score"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7": ["doc_id", "size", "source_size", "target", "taken"],
    "op8": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["page_id", "host", "path", "rule", "verdict"],
    "op10": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "media": ["id", "clip", "first_frame", "frames", "begin_s", "end_s", "brightness", "error"],
    "op13": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    out = QUERIES[name](spark, DATA)
    assert set(COLUMNS[name.split("_")[0]]) <= set(out.columns)
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def test_pipeline(spark):
    docs = common.read(spark, DATA, "documents")
    labels = {r.doc_id: r.quality for r in common.read(spark, DATA, "labels").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(common.cut(stage(spark, seen[-1], DATA)))
    raw, good, single, passages, mixed, packed = seen
    for frame in seen[:-1]:
        assert frame.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in good.collect()}
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) > 0.95 * len(labels)
    groups = ngram_components(good, 5, 80).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in groups}
    assert passages.count() <= single.count() and {r.doc_id for r in passages.collect()} <= {r.doc_id for r in single.collect()}
    assert mixed.count() > passages.count()
    tokens = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in tokens) <= 2048
    assert packed.where("piece = 0").count() == mixed.count()


def test_media_clips(spark):
    """Every stored text has clips that cover its frames without a gap, each as long as its frames."""
    frames = {r.doc_id: r.payload_bytes // 192 for r in QUERIES["op2_media_avi_mjpeg"](spark, DATA).collect()}
    clips = {}
    for r in QUERIES["media_clips"](spark, DATA).collect():
        assert r.error is None and r.frames > 0 and r.end_s > r.begin_s
        clips.setdefault(r.id, {})[r.clip] = (r.first_frame, r.frames)
    assert set(clips) == set(frames)
    for i, own in clips.items():
        at = 0
        for k in range(len(own)):
            assert own[k][0] == at
            at += own[k][1]
        assert at == frames[i]
