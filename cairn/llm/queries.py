"""Registered queries of the numbered operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.llm import langid, lm, media, url_graph
from cairn.llm.ann import nearest
from cairn.llm.centroids import cluster
from cairn.llm.common import read
from cairn.llm.hard_negatives import mine
from cairn.llm.impact_search import top_k
from cairn.llm.mixing import mixed_sizes
from cairn.llm.ngram_join import ngram_components
from cairn.llm.packing import pack_documents
from cairn.llm.quality import fold, score_quality, train_quality
from cairn.llm.substring_dedup import remove_repeats


def op1_ngram_jaccard_join(spark, sf_dir):
    """Documents by components of links at a Jaccard similarity of 90 % of 3-word shingles. A null doc_id keeps its row, with component_id null, and links nothing."""
    return ngram_components(read(spark, sf_dir, "documents"), size=3, percent=90)


def op2_media_avi_mjpeg(spark, sf_dir):
    """Every text stored as a motion-JPEG AVI, read back, with what its bytes and frames give. A null doc_id keeps its row."""
    return media.read_texts(media.store_texts(read(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark, sf_dir):
    """All documents' pieces packed into sequences of at most 2048 tokens. A null doc_id keeps its rows; repeated rows are packed each for itself."""
    return pack_documents(read(spark, sf_dir, "documents"))


def op4_collision_neighbours(spark, sf_dir):
    """The 20 nearest found of every vector whose vec_id is divisible by 20. Rows with a null vec_id take no part; repeated rows count once."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def op5_quality_factorisation(spark, sf_dir):
    """Every document's quality score, learnt from labels outside the fold that is held out. A null doc_id has no fold: held_out is null, its row is scored and never learnt from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train_quality(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    out = score_quality(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark, sf_dir):
    """Every document without the words of 50-word windows that also start in a smaller doc_id. A row with a null doc_id is kept whole and removes nothing."""
    kept = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_source_mix(spark, sf_dir):
    """Every document's share of a mix of all sources. Rows alike in doc_id, source and text have the same share each; a null doc_id keeps its row."""
    return mixed_sizes(read(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    """Every document's language, learnt outside the fold that is held out. A null doc_id has no fold: held_out is null, its row is judged and never learnt from."""
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(fold("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_url_filter(spark, sf_dir):
    """Every page's verdict, by rules and else by its host's scores. A null page_id keeps its row."""
    return url_graph.judge(read(spark, sf_dir, "pages"))


def op10_lm_score(spark, sf_dir):
    """Every document's log10 probability, by counts and by the network, learnt outside the fold that is held out. A null doc_id has no fold: held_out is null, its row is scored and never learnt from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm.train(docs.where(fold("doc_id", 7) != 2))
    out = lm.score(docs, model, counts)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_centroid_clusters(spark, sf_dir):
    """Every vector of 64 components in one of 40 clusters after five rounds. A null vec_id keeps its row; every row of a repeated vec_id is a vector."""
    return cluster(read(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, salt="2:")


def op12_hard_negatives(spark, sf_dir):
    """The hard negatives of every vector whose vec_id is divisible by 50, with the stated noise in the labels. Rows with a null vec_id take no part; repeated rows count once."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", noisy)
    return mine(rows, rows.where("vec_id % 50 = 0"), positives=5, negatives=3, low=50, high=95)


def op13_exact_top_k(spark, sf_dir):
    """The five largest integer inner products of every vector whose vec_id is divisible by 50. Rows with a null vec_id take no part; repeated rows count once."""
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def media_clips(spark, sf_dir):
    """The timed clips of every text stored as a motion-JPEG AVI. A null doc_id keeps its rows."""
    stored = media.store_texts(read(spark, sf_dir, "documents"))
    return media.clips(stored.select(F.col("doc_id").alias("id"), "media"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_media_avi_mjpeg, op3_best_fit_packing, op4_collision_neighbours, op5_quality_factorisation,
    op6_substring_dedup, op7_source_mix, op8_language_id, op9_url_filter, op10_lm_score,
    op11_centroid_clusters, op12_hard_negatives, op13_exact_top_k,
    media_clips,
)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"
_INTEGERS = "list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE)))"  # as doubles, exact


def _clusters_sql(k: int, rounds: int) -> str:
    """Each round as two statements: the nearest centroid of every vector, and the floors of the means."""
    steps = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_INTEGERS} AS x FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INTEGER) AS cluster, x FROM v QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"d{i} AS (SELECT v.r, c.cluster, {square} AS d FROM v, c{i} c), a{i} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(cluster, (d, cluster)) AS cluster FROM d{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT a.cluster, j, floor(sum(v.x[j]) / count(*)) AS m FROM a{i} a JOIN v USING (r), range(1, 65) t(j) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT cluster, list(m ORDER BY j) AS x FROM s{i} GROUP BY 1) n USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT v.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda m: CAST(m AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE_SQL = {
    "op11_centroid_clusters": _clusters_sql(40, 5),
    "op12_hard_negatives": f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS} AS x FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_WHOLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
""",
    "op13_exact_top_k": f"""
WITH v AS MATERIALIZED (SELECT vec_id, {_INTEGERS} AS x FROM embeddings WHERE vec_id IS NOT NULL AND {_WHOLE})
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x) QUALIFY rank <= 5
""",
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 90 * (a.n + b.n - o)),
sym AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, sym.v FROM r JOIN sym ON sym.u = r.seen)
SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, list_transform(range(1, len(ws) - 48), lambda i: array_to_string(ws[i : i + 49], ' ')) AS wins FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS s FROM k),
m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY 1),
f AS (SELECT doc_id, s FROM w JOIN m USING (win) WHERE doc_id > least),
v AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
c AS (SELECT v.doc_id, v.word, v.i, max(CASE WHEN f.s IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY v.doc_id ORDER BY v.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM v LEFT JOIN f ON f.doc_id = v.doc_id AND f.s = v.i),
t AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
""",
}
