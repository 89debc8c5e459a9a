"""What the scan of one language gives: a graph, evidence, issues and the counted imports and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.graph import CodeGraph, source_hash


@dataclass(frozen=True)
class Fragment:
    """graph; evidence (the columns of schema.EVIDENCE); issues(kind, path, import_path, reason); imports(path, class); files(path, failed)."""

    graph: CodeGraph
    evidence: DataFrame
    issues: DataFrame
    imports: DataFrame
    files: DataFrame


def issues_of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "path", "import_path", "reason")


def evidence_of(rows: DataFrame, kind: str, target: Column, files: DataFrame) -> DataFrame:
    """One occurrence for each of rows(path and place): the edge from its file, its place and the hash of the file as read."""
    hashes = files.select("path", source_hash(F.col("content")).alias("hash"))
    edge = F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("file:"), "path").alias("from_id"), target.alias("to_id"))
    return rows.join(hashes, "path").select(edge.alias("edge"), "path", "line", "column", "end_line", "end_column", "snippet", "truncated", "hash")
