"""Immutable snapshots as Parquet: one partition by scan in every table, published by its row in `snapshots`.

A snapshot's tables and view index are written first and its `snapshots` row last; readers see
only scans that have one, so a save that fails or loses executors leaves nothing visible.

A manifest names the store's format and the folder of its indexes: views for pages, and searches
(see view_index and search_index). Format 1 had neither, format 2 no searches, format 3 a posting
for each row: such a store is migrated when it is opened for writing. The indexes of all its snapshots go to a new folder, and
the manifest that names it, a file of its own for each format, is put in place by one rename, so
a migration that fails leaves the old store as it was.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.graph import CodeGraph, lost_ends, node_conflicts
from cairn.schema import COUNTERS, EDGES, EVIDENCE, EXCLUSIONS, ISSUES, NODES, SNAPSHOTS, STATUSES, GraphError
from cairn.sources.search_index import SearchIndex, write_search_index
from cairn.sources.view_index import ViewIndex, write_index

SCHEMAS = {"nodes": NODES, "edges": EDGES, "evidence": "ordinal int, " + EVIDENCE, "issues": "ordinal int, " + ISSUES, "exclusions": EXCLUSIONS}


FORMAT = 4
MANIFEST = f"manifest-{FORMAT}.json"
#: Seconds after which a saver's claim may be taken over.
LEASE = 3600.0


class SnapshotStore:
    """Snapshots under a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, lease: float = LEASE):
        """A store that is only read must be there and of this format, and refuses to save. One of a newer format is refused."""
        self.spark, self.root, self.read_only, self.lease = spark, root.rstrip("/"), read_only, lease
        manifest = self._manifest()
        if read_only and manifest["format"] is None:
            raise GraphError("not_found", f"no store in {root}")
        if manifest["format"] not in (None, *range(1, FORMAT + 1)) or (read_only and manifest["format"] != FORMAT):
            raise GraphError("unsupported_version", f"the store has format {manifest['format']}, not {FORMAT}")
        if manifest["format"] != FORMAT:
            manifest = self._migrate()
        self.views = manifest["views"]

    def _manifest(self) -> dict:
        """The manifest of the newest format that is there; without one, format 1 where snapshots are, else none."""
        system, where = self._path("")
        names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
        formats = {int(m[1] or 2): n for n in names if (m := re.fullmatch(r"manifest(?:-(\d+))?\.json", n))}
        if formats:
            return json.loads(self._text(formats[max(formats)]))
        return {"format": 1 if "snapshots" in names else None}

    def _text(self, name: str) -> str:
        system, where = self._path(name)
        stream = system.open(where)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return text

    def _write(self, name: str, text: str) -> bool:
        """Create a file that is not there, whole; False where it is."""
        system, where = self._path(name)
        _, draft = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = system.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not system.exists(where) and system.rename(draft, where)
        if not done:
            system.delete(draft, False)
        return done

    def _migrate(self) -> dict:
        """From an older format (or an empty folder) to this one: indexes of all snapshots in a new folder, then the manifest."""
        manifest = {"format": FORMAT, "views": f"views-{uuid.uuid4().hex}"}
        for row in self._read("snapshots", SNAPSHOTS).select("id").toLocalIterator():
            self._write_indexes(row.id, manifest["views"])
        if not self._write(MANIFEST, json.dumps(manifest)):
            return json.loads(self._text(MANIFEST))  # another writer was first
        return manifest

    def _write_indexes(self, scan: str, views: str) -> None:
        graph, _ = self._graph(scan)
        write_index(graph, f"{self.root}/{views}/scan_id={scan}")
        write_search_index(graph.nodes, f"{self.root}/{views}/search_of={scan}")

    def _path(self, name: str):
        """(file system, path) of a file or folder of the store."""
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(sc._jsc.hadoopConfiguration()), where

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.root}/{table}"
        system, where = self._path(table)
        there = system.exists(where)
        # columns that older snapshots lack are null
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def list(self) -> DataFrame:
        """All snapshots, newest first, ties by id downwards."""
        return self._read("snapshots", SNAPSHOTS).orderBy(F.desc("created_ts"), F.desc("id"))

    def latest(self) -> str | None:
        row = self.list().select("id").first()
        return row.id if row else None

    def save(self, source: str, graph: CodeGraph, parts: dict[str, DataFrame] | None = None, counters: dict[str, int] | None = None, status: str = "complete", expected: str | None = None) -> str:
        """Publish a scan and return its id.

        parts may hold evidence, issues and exclusions. expected, if given, must be the latest
        snapshot's id, and of several savers that expect the same one only the first goes on (see
        _claim). Refused: other statuses, edges of which an end is no node, conflicting nodes, and
        graphs that break containment.
        """
        if self.read_only:
            raise GraphError("bad_request", "the store is read only")
        if status not in STATUSES:
            raise GraphError("bad_request", f"status {status} cannot be saved")
        if row := lost_ends(graph.nodes, graph.edges).first() or node_conflicts(graph.nodes).first():
            raise GraphError("invalid_graph", f"not saved: {row.asDict()}")
        if expected is not None:
            if (self.latest() or "") != expected:
                raise GraphError("scan_conflict", "another snapshot was saved meanwhile")
            fence = self._claim(expected or "none")
        scan, now = uuid.uuid4().hex, datetime.now(UTC)
        frames = {"nodes": graph.nodes, "edges": graph.edges, **(parts or {})}
        for name, frame in frames.items():
            columns = self.spark.createDataFrame([], SCHEMAS[name]).columns
            frame.select(columns).withColumn("scan_id", F.lit(scan)).write.mode("append").option("compression", "zstd").partitionBy("scan_id").parquet(f"{self.root}/{name}")
        self._write_indexes(scan, self.views)
        if expected is not None and (self._last_claim(expected or "none") != fence or (self.latest() or "") != expected):
            raise GraphError("scan_conflict", "the claim was taken over")
        row = (scan, source, now.isoformat(timespec="microseconds").replace("+00:00", "Z"), now, status, *((counters or {}).get(c, 0) for c in COUNTERS))
        self.spark.createDataFrame([row], SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")
        return scan

    def _claims(self, name: str) -> list[int]:
        system, where = self._path("claims")
        names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
        return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{name}-") and n.rpartition("-")[2].isdigit())

    def _last_claim(self, name: str) -> int | None:
        return max(self._claims(name), default=None)

    def _expires(self, name: str) -> float:
        """When a claim's lease ends; one that is being written counts from its file's time."""
        system, where = self._path(name)
        return float(self._text(name) or system.getFileStatus(where).getModificationTime() / 1000 + self.lease)

    def _claim(self, name: str) -> int:
        """The fencing number of this saver's claim on the place behind a snapshot.

        A claim is a file that holds when it expires; the file system lets one saver create it. An
        expired one is taken over by creating the next number, which one later saver can do as well. Before it
        publishes, a saver whose number is no longer the last gives up.
        """
        last = self._last_claim(name)
        if last is not None and self._expires(f"claims/{name}-{last}") > time.time():
            raise GraphError("scan_conflict", "another snapshot is being saved")
        fence = 0 if last is None else last + 1
        system, where = self._path(f"claims/{name}-{fence}")
        try:
            stream = system.create(where, False)  # fails where another saver has created it
        except Exception as e:
            if not system.exists(where):
                raise
            raise GraphError("scan_conflict", "another snapshot is being saved") from e
        stream.write(bytearray(str(time.time() + self.lease).encode()))
        stream.close()
        return fence

    def view(self, scan: str) -> ViewIndex:
        """The stored view index of a published snapshot."""
        self._published(scan)
        return ViewIndex(self.spark, f"{self.root}/{self.views}/scan_id={scan}")

    def search(self, scan: str) -> SearchIndex:
        """The stored search index of a published snapshot."""
        self._published(scan)
        return SearchIndex(self.spark, f"{self.root}/{self.views}/search_of={scan}")

    def _published(self, scan: str) -> None:
        if self._read("snapshots", SNAPSHOTS).where(F.col("id") == scan).isEmpty():
            raise GraphError("not_found", f"snapshot {scan} not found")

    def load(self, scan: str) -> tuple[CodeGraph, dict[str, DataFrame]]:
        """(graph, evidence, issues and exclusions) of a published snapshot; only its partitions are read."""
        self._published(scan)
        return self._graph(scan)

    def _graph(self, scan: str) -> tuple[CodeGraph, dict[str, DataFrame]]:
        own = {n: self._read(n, s + ", scan_id string").where(F.col("scan_id") == scan).drop("scan_id") for n, s in SCHEMAS.items()}
        return CodeGraph(own.pop("nodes"), own.pop("edges")), own
