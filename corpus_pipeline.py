"""Corpus pipeline: quality, near duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns rows with the columns of documents; the last one returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.llm import common
from cairn.llm.mixing import mixed_documents
from cairn.llm.ngram_join import ngram_components
from cairn.llm.packing import pack_documents
from cairn.llm.quality import score_quality, train_quality
from cairn.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs, sf_dir):
    """Rows that the quality classifier accepts (score 0.5 or more); it is fitted on the labelled rows of docs.

    Null and empty texts are scored as empty ones, rows with a null doc_id like others, repeated
    rows each; without labels all are kept. An empty table stays empty, and columns beyond those
    of documents are left out (as in every stage).
    """
    docs = docs.select(COLUMNS)
    model = train_quality(docs, common.read(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("score >= 0.5").select(COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of documents that five-word n-grams link at a similarity of 0.8 or more: the least doc_id's.

    Of repeated rows of one doc_id the least text stays. Texts without words, and rows with a null
    doc_id, are in no group and all stay.
    """
    docs = docs.select(COLUMNS)
    groups = ngram_components(docs, size=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(COLUMNS)
    # repeated rows of a kept doc_id: few, so their texts alone are compared
    again = groups.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    again = common.cut(again)
    if again.isEmpty():
        return kept
    single = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return kept.join(again, "doc_id", "left_anti").select(COLUMNS).union(single.select(COLUMNS))


def repeated_passages(spark, docs, sf_dir):
    """Rows without the passages of 50 words or more that documents with a smaller doc_id have; texts that lose all words go.

    Texts that lose nothing stay as they are; a null text becomes an empty one and stays. A row with
    a null doc_id is kept whole and removes nothing; repeated rows do not remove each other.
    """
    out = remove_repeats(docs.select(COLUMNS), as_is=True).where("n_removed = 0 or n_removed < n_words")
    out = out.withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mix(spark, docs, sf_dir):
    """Rows mixed to the sources' targets: each as often as the mix takes it.

    Null sources are one source, the last. A text without words, null or empty, has size 0 and adds
    nothing to a target. Repeated rows and rows with a null doc_id are rows of their own.
    """
    return mixed_documents(docs.select(COLUMNS))


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of all rows packed into sequences of at most 2048 tokens.

    A null or empty text is its closing token alone. Rows with a null doc_id and repeated rows are
    packed each for itself; only texts of over 2048 tokens are cut.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mixing", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Training, graph components and packing are beyond one SQL statement; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on documents, each written as Parquet in the cluster's shared folder, read again by the next and then deleted."""
    folder = f"{common.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.delete(spark, f"{folder}/{k - 1}")  # what has read it is written
    return docs
