"""From files to one graph with evidence, issues, exclusions and coverage, and on to a saved snapshot."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import issue_ordinals, language_of, numbered, parse_ignore
from cairn.graph import CodeGraph, build
from cairn.schema import COUNTERS, EVIDENCE, GraphError
from cairn.session import cut
from cairn.sources import go_facts, python_facts, tsjs_facts
from cairn.sources.repository import repository
from cairn.sources.scan import repository_files, scan
from cairn.sources.store import SnapshotStore

CONTROL = ".cairnignore"
ANALYZED = ("go", "python", "typescript", "javascript")
#: How occurrences are ordered when they are saved.
EVIDENCE_ORDER = ["path", "line", "column", "edge.kind", "edge.to_id", "snippet"]


@dataclass(frozen=True)
class Analysis:
    """graph; evidence and issues with their ordinals; exclusions(path, reason); counters by name; status."""

    graph: CodeGraph
    evidence: DataFrame
    issues: DataFrame
    exclusions: DataFrame
    counters: dict[str, int]
    status: str


def load_rules(files: DataFrame, control: str = CONTROL):
    """The ignore rules of the control file at the root; none without it. It must be UTF-8 text without NUL."""
    row = files.where(F.col("path") == control).select("content").first()
    if row is None:
        return []
    try:
        text = bytes(row.content).decode()
    except UnicodeDecodeError as e:
        raise GraphError("invalid_pattern", f"{control}: not valid UTF-8") from e
    if "\0" in text:
        raise GraphError("invalid_pattern", f"{control}: contains NUL")
    return parse_ignore(text, control)


def sorted_evidence(evidence: DataFrame) -> DataFrame:
    """Occurrences with their ordinal: by path, place, kind, target and snippet."""
    keys = evidence.withColumns({"k0": F.col("edge.kind"), "k1": F.col("edge.to_id")})
    order = ["path", "line", "column", "k0", "k1", "snippet"]
    return numbered(keys, [], order).withColumn("ordinal", F.col("place").cast("int")).drop("place", "k0", "k1")


def answered(asked: DataFrame, files: DataFrame) -> None:
    """Refuse an analysis of which the files(path, ..) are not exactly the asked(path), each once."""
    rows = asked.select("path", F.lit(1).alias("asked"), F.lit(0).alias("got")).union(files.select("path", F.lit(0), F.lit(1)))
    odd = rows.groupBy("path").agg(F.sum("asked").alias("asked"), F.sum("got").alias("got")).where("asked <> 1 or got <> 1").first()
    if odd:
        raise GraphError("analysis_failed", f"{odd.path}: asked {odd.asked} times, answered {odd.got} times")


def analyze(files: DataFrame, root_name: str = "root", control: str = CONTROL) -> Analysis:
    """Everything about files(path, content, and status if there): ignore rules, the three languages' facts, resolution and coverage.

    Files of another status than `read` (links, unreadable ones) are discovered and skipped. Each
    analyzed file must come back exactly once, as parsed or failed. Fragments are joined with their
    conflicts and dangling edges refused. The status has gaps if there is any issue; exclusions
    are none.
    """
    kept, exclusions = scan(files, load_rules(files, control), control)
    every = cut(kept)
    gone = every.where(F.col("status") != "read") if "status" in every.columns else every.where("false").withColumn("status", F.lit("read"))
    kept = every.where(F.col("status") == "read").drop("status") if "status" in every.columns else every
    fragments = (go_facts.go_fragment(kept, cut(go_facts.extract(kept))), python_facts.python_fragment(kept, root_name, cut(python_facts.extract(kept.where("language = 'python'")))), tsjs_facts.tsjs_fragment(kept, cut(tsjs_facts.extract(kept))))
    graph = build([(cut(f.graph.nodes), cut(f.graph.edges)) for f in fragments])
    union = lambda name: reduce(DataFrame.unionByName, (getattr(f, name) for f in fragments))
    unsupported = kept.where(language_of(F.col("path")) == "unsupported")
    odd = unsupported.select(F.lit("UNSUPPORTED_FILE").alias("kind"), "path", F.lit("").alias("import_path"), F.lit("no analyzer for this source language").alias("reason"))
    answered(kept.where(F.col("language").isin(*ANALYZED)), union("files"))
    reason = F.when(F.col("status") == "link", "not a regular file").otherwise("file could not be read")
    skipped = gone.select(F.lit("SKIPPED_FILE").alias("kind"), "path", F.lit("").alias("import_path"), reason.alias("reason"))
    issues = issue_ordinals([union("issues"), odd, skipped], [])
    evidence = sorted_evidence(union("evidence").select(*(c.split()[0] for c in _columns(EVIDENCE))))
    by_class = {r["class"]: r["n"] for r in union("imports").groupBy("class").agg(F.count("*").alias("n")).collect()}  # seven classes
    by_file = union("files").agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("failed")).first()
    seen = kept.agg(F.count("*").alias("n"), F.count_if(F.col("language").isin(*ANALYZED)).alias("supported"), F.count_if(F.col("language") == "unsupported").alias("odd")).first()
    counters = {c: 0 for c in COUNTERS} | {k: v for k, v in by_class.items() if k in COUNTERS}
    lost = gone.count()
    counters |= {"files_discovered": seen.n + lost, "supported_source_files": seen.supported, "files_analyzed": by_file.ok, "files_failed": by_file.failed, "files_skipped": seen.odd + lost, "imports_discovered": sum(by_class.values())}
    return Analysis(graph, evidence, issues, exclusions, counters, "complete" if issues.isEmpty() else "completed_with_gaps")


def _columns(schema: str) -> list[str]:
    """The columns of a schema, whose structs hold no spaces behind commas."""
    return schema.split(", ")


def scan_to_snapshot(spark: SparkSession, root: str, store: SnapshotStore, expected: str | None = None) -> str:
    """Scan a folder and publish the result; the id of the new snapshot.

    A folder of the local (or a shared) file system is listed and read by tasks, anything else by
    Spark's reader of files.
    """
    files = repository(spark, root).select("path", "content", "status") if os.path.isdir(root) else repository_files(spark, root)
    found = analyze(files, root.rstrip("/").rpartition("/")[2])
    parts = {"evidence": found.evidence, "issues": found.issues, "exclusions": found.exclusions}
    return store.save(root, found.graph, parts, found.counters, found.status, expected)


def report(found: Analysis) -> DataFrame:
    """(part, line) of a plain text listing of nodes, edges, exclusions and issues, each in order."""
    g, e = found.graph, F.concat_ws(" ", "path", "import_path", "reason")
    nodes = g.nodes.select(F.lit(0).alias("k"), F.lit("node").alias("part"), F.concat_ws(" ", "kind", "id", "path", "name").alias("line"))
    edges = g.edges.select(F.lit(1), F.lit("edge"), F.concat_ws(" ", "kind", "from_id", "to_id"))
    gone = found.exclusions.select(F.lit(2), F.lit("exclusion"), F.concat_ws(" ", "path", "reason"))
    rows = nodes.union(edges).union(gone).union(found.issues.select(F.lit(3), F.lit("issue"), F.concat(F.col("kind"), F.lit(" "), e)))
    return rows.orderBy("k", "line").select("part", "line")
