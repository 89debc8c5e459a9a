"""Repository scans: files with content under a folder, without built-in and ignored paths."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import Rule, ignore_matches, language_of
from cairn.schema import SKIPPED_DIRECTORIES, GraphError


def repository_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files under root, a folder, without those in built-in skipped folders; paths are relative to it.

    The driver lists names and sizes; tasks read the contents. Spark's readers leave out empty
    files and names that begin with `_` or `.`: the latter (as `__init__.py`) are read one by one.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isDirectory():
        raise GraphError("bad_request", f"{root} is no folder")
    base = system.getFileStatus(where).getPath().toUri().getPath().rstrip("/") + "/"
    listed, plain, odd = system.listFiles(where, True), [], []
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toUri().getPath().removeprefix(base)
        if set(path.split("/")[:-1]) & set(SKIPPED_DIRECTORIES):
            continue
        if status.getLen() == 0:
            odd.append((path, b""))
        elif path.rpartition("/")[2][0] in "_.":
            stream = system.open(status.getPath())
            odd.append((path, bytes(stream.readAllBytes())))
            stream.close()
        else:
            plain.append(re.sub(r"([{}\[\]*?\\])", r"\\\1", status.getPath().toString()))  # names, not patterns
    out = spark.createDataFrame(odd, "path string, content binary")
    if plain:
        files = spark.read.format("binaryFile").load(plain)
        out = out.union(files.select(F.regexp_replace("path", "^.*?" + "\\Q" + base + "\\E", "").alias("path"), "content"))
    return out


def scan(files: DataFrame, rules: list[Rule], control: str) -> tuple[DataFrame, DataFrame]:
    """(files kept: path, content, language; exclusions: path, reason) of files(path, content).

    Paths below a built-in directory are left out without a word. A rule that excludes a directory
    prunes all below it, whatever later rules say, and is reported once as `directory/`.
    """
    parts = F.split("path", "/")
    files = files.where((F.col("path") != control) & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(d) for d in SKIPPED_DIRECTORIES))))
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("p"), (k < F.size(parts)).alias("dir")))).alias("a"))
    entries = ignore_matches(above.select(F.col("path").alias("file"), F.col("a.p").alias("path"), F.col("a.k").alias("k"), F.col("a.dir").alias("dir")), rules).where("line is not null")
    first = entries.groupBy("file").agg(F.min(F.struct("k", "path", "dir", "line", "pattern")).alias("e")).select("file", "e.*")
    kept = files.join(first.select(F.col("file").alias("path")), "path", "left_anti").withColumn("language", language_of(F.col("path")))
    reason = F.format_string(control + ':%d pattern "%s"', "line", "pattern")
    return kept, first.select(F.concat("path", F.when(F.col("dir"), "/").otherwise("")).alias("path"), reason.alias("reason")).distinct()
