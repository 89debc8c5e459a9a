"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "cairn.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a local one is made only for a local master without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df):
    """The same rows from a reliable checkpoint: lineage ends here, and a lost executor costs no more than its tasks."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Stored tables: (application, weak reference to what every plan that reads one holds, path).
_stored: list[tuple] = []


def stored(df):
    """The same rows from a compressed table in the shared folder, for many rows: lineage ends here too, and the table goes when no plan reads it any more."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # all plans on the table share its list of files
    files = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    sweep(spark)
    _stored.append((spark.sparkContext.applicationId, spark._jvm.java.lang.ref.WeakReference(files), path))
    return out


def sweep(spark) -> None:
    """Delete the stored tables that no plan reads any more, and have the driver let go of consumed shuffles."""
    spark._jvm.System.gc()  # else both stay until the driver happens to collect its garbage
    app = spark.sparkContext.applicationId
    for entry in [e for e in _stored if e[0] != app or e[1].get() is None]:
        _stored.remove(entry)
        if entry[0] == app:
            delete(spark, entry[2])


def delete(spark, path: str) -> None:
    """Remove a folder of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of text and rows that a broadcast side may hold.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 1 << 18


def few(df, *texts):
    """The rows, to be broadcast if they and their texts are few; df should be cheap to read, as it is counted."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found.rows <= BROADCAST_ROWS and found.bytes <= BROADCAST_BYTES else df
