"""Python facts: declarations and imports by the standard parser, resolution by joins."""

from __future__ import annotations

import ast
import io
import sys
import tokenize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph
from cairn.session import cut
from cairn.sources.fragment import Fragment, evidence_of, issues_of

FACTS = "path string, fact string, name string, module string, level int, line int, column int, end_line int, end_column int, snippet string, truncated boolean"
SNIPPET = 8192


def _place(lines: list[str], node) -> tuple:
    """Line and UTF-16 column of both ends, 1-based, the end exclusive, the source between (SNIPPET characters at most) and whether it is cut."""
    before = lambda row, at: lines[row - 1].encode()[:at].decode(errors="ignore")
    start, stop = before(node.lineno, node.col_offset), before(node.end_lineno, node.end_col_offset)
    units = lambda text: len(text.encode("utf-16-le")) // 2 + 1
    text = "\n".join([*lines[node.lineno - 1 : node.end_lineno - 1], stop])[len(start) :]
    return node.lineno, units(start), node.end_lineno, units(stop), text[:SNIPPET], len(text) > SNIPPET


def facts_of(path: str, content: bytes) -> list[tuple]:
    """Rows of FACTS for one file; a file that does not parse gives one `failed` row."""
    try:
        encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
        text = content.decode(encoding)
        tree = ast.parse(text)
    except (SyntaxError, UnicodeError, ValueError) as e:
        return [(path, "failed", None, str(e), None, getattr(e, "lineno", None), None, None, None, None, None)]
    lines, rows = text.split("\n"), [(path, "parsed", None, None, None, None, None, None, None, None, None)]
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, functions):
            rows.append((path, "FUNCTION", node.name, None, None, *_place(lines, node)))
        elif isinstance(node, ast.ClassDef):
            rows.append((path, "CLASS", node.name, None, None, *_place(lines, node)))
            rows += [(path, "METHOD", f"{node.name}.{m.name}", None, None, *_place(lines, m)) for m in node.body if isinstance(m, functions)]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            rows += [(path, "import", None, a.name, 0, *_place(lines, node)) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            names = [None] if node.module else [a.name for a in node.names]
            rows += [(path, "import", n, node.module, node.level, *_place(lines, node)) for n in names]
    return rows


def extract(files: DataFrame) -> DataFrame:
    """FACTS of files(path, content)."""

    def run(frames):
        for frame in frames:
            rows = [r for path, content in zip(frame["path"], frame["content"]) for r in facts_of(path, bytes(content))]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])
            yield out.astype({c: "Int32" for c in ("level", "line", "column", "end_line", "end_column")})

    return files.select("path", "content").mapInPandas(run, FACTS)


def _directory(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def package_names(facts: DataFrame, root_name: str) -> DataFrame:
    """(dir, name): directories whose __init__.py parsed, with the dotted chain of those above without a gap."""
    dirs = facts.where("fact = 'parsed' and (path = '__init__.py' or path like '%/__init__.py')").select(_directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.where("dir <> ''").select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts"))
    above = above.withColumn("prefix", F.array_join(F.slice("parts", 1, F.col("k")), "/"))
    gap = above.join(dirs.select(F.col("dir").alias("prefix"), F.lit(True).alias("is")), "prefix", "left").where("is is null")
    last = gap.groupBy("dir").agg(F.max("k").alias("gap"))
    named = dirs.join(last, "dir", "left").withColumn("gap", F.coalesce("gap", F.lit(0)))
    whole = F.array_join(F.slice(parts, F.col("gap") + 1, F.size(parts) - F.col("gap")), ".")
    return named.select("dir", F.when(F.col("dir") == "", F.lit(root_name)).otherwise(whole).alias("name"))


def resolve(facts: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports with class (internal_resolved, standard_library, unresolved, unclassified), target and reason; the first rung that holds decides."""
    files = facts.where("fact = 'parsed'").select("path", _directory(F.col("path")).alias("dir"), F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.py$", "").alias("stem"))
    owned = files.join(packages, "dir", "left")
    module = owned.where("stem <> '__init__'").select(F.when(F.col("name").isNull(), F.col("stem")).otherwise(F.concat_ws(".", "name", "stem")).alias("dotted"), F.concat(F.lit("file:"), "path").alias("target"))
    index = module.union(packages.select("name", F.concat(F.lit("python-package:"), "dir"))).groupBy("dotted").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    roots = index.select(F.split("dotted", "\\.")[0].alias("root")).distinct().withColumn("known", F.lit(True))
    rows = facts.where("fact = 'import'").join(owned.select("path", F.col("name").alias("package")), "path", "left")
    context = F.split("package", "\\.")
    base = F.when(F.col("package").isNotNull() & (F.col("level") <= F.size(context)), F.array_join(F.slice(context, 1, F.size(context) - F.col("level") + 1), "."))
    suffix = F.coalesce("module", "name")
    wanted = F.when(F.col("level") == 0, F.col("module")).otherwise(F.when(base.isNotNull(), F.concat_ws(".", base, suffix)))
    rows = rows.withColumn("dotted", wanted).join(index, "dotted", "left").withColumn("root", F.when(F.col("level") == 0, F.split("module", "\\.")[0]))
    standard = F.coalesce(F.col("root").isin(*sorted(sys.stdlib_module_names)), F.lit(False))
    n = F.coalesce(F.size("targets"), F.lit(0))
    rows = rows.join(roots, "root", "left")
    reason = F.when((F.col("level") > 0) & F.col("dotted").isNull(), "relative import has no proven classic package context").when((n == 1) & standard, "repository module conflicts with a standard-library name; runtime search order is unknown").when(n == 1, None).when(n > 1, "multiple repository targets have this module identity").when(standard, None).when((F.col("level") > 0) | F.col("known"), "module is absent from the proven package structure")
    kind = F.when((F.col("level") > 0) & F.col("dotted").isNull(), "unresolved").when((n == 1) & standard, "unresolved").when(n == 1, "internal_resolved").when(n > 1, "unresolved").when(standard, "standard_library").when((F.col("level") > 0) | F.col("known"), "unresolved").otherwise("unclassified")
    display = F.concat(F.expr("repeat('.', level)"), F.coalesce("module", F.lit("")), F.coalesce("name", F.lit("")))
    return rows.select("path", display.alias("import_path"), kind.alias("class"), F.when(kind == "internal_resolved", F.col("targets")[0]).alias("target"), reason.alias("reason"), "line", "column", "end_line", "end_column", "snippet", "truncated")


def python_graph(facts: DataFrame, root_name: str) -> tuple[CodeGraph, DataFrame]:
    """(graph, resolved imports): packages, files and declarations with their containment and imports."""
    packages = cut(package_names(facts, root_name))
    resolved = cut(resolve(facts, packages))
    files = facts.where("fact = 'parsed'").select("path")
    counts = facts.where("fact = 'import'").groupBy("path").agg(F.count("*").cast("int").alias("n"))
    none = F.lit(None).cast("int")
    py = F.lit("python")
    package = packages.select(F.concat(F.lit("python-package:"), "dir").alias("id"), F.lit("PACKAGE").alias("kind"), F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("path"), "name", py.alias("language"), none.alias("import_count"), none.alias("export_count"))
    file = files.join(counts, "path", "left").select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("FILE").alias("kind"), "path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), py.alias("language"), F.coalesce("n", F.lit(0)).alias("import_count"), none.alias("export_count"))
    declared = facts.where("fact in ('FUNCTION', 'CLASS', 'METHOD')")
    again = declared.groupBy("path", "fact", "name").agg(F.count("*").alias("k"))
    declared = declared.join(again, ["path", "fact", "name"])
    ident = F.concat(F.lower("fact"), F.lit(":"), "path", F.lit("#"), "name", F.when(F.col("k") > 1, F.concat(F.lit("@"), "line")).otherwise(""))
    declaration = declared.select(ident.alias("id"), F.col("fact").alias("kind"), "path", "name", py.alias("language"), none.alias("import_count"), none.alias("export_count"))
    nodes = package.unionByName(file).unionByName(declaration).select(NODE_COLUMNS)
    edge = lambda f, kind, a, b: f.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"))
    outer = packages.select(F.col("dir").alias("up"))
    nested = packages.where("dir <> ''").withColumn("up", _directory(F.col("dir"))).join(outer, "up", "left_semi")
    held = edge(nested, "CONTAINS", F.concat(F.lit("python-package:"), "up"), F.concat(F.lit("python-package:"), "dir"))
    inside = files.withColumn("dir", _directory(F.col("path"))).join(packages, "dir", "left_semi")
    held = held.union(edge(inside, "CONTAINS", F.concat(F.lit("python-package:"), "dir"), F.concat(F.lit("file:"), "path")))
    held = held.union(edge(declared, "CONTAINS", F.concat(F.lit("file:"), "path"), ident))
    used = edge(resolved.where("target is not null"), "IMPORTS", F.concat(F.lit("file:"), "path"), F.col("target"))
    return CodeGraph(nodes, held.union(used).distinct().select(EDGE_COLUMNS)), resolved


def python_fragment(files: DataFrame, root_name: str, facts: DataFrame | None = None) -> Fragment:
    """Packages, files and declarations of the .py files of files(path, content), with containment, imports, evidence, issues and import counts."""
    facts = extract(files.where(F.col("path").endswith(".py"))) if facts is None else facts
    graph, resolved = python_graph(facts, root_name)
    failed = facts.where("fact = 'failed'").select("path", F.lit("").alias("import_path"), F.col("module").alias("reason"))
    issues = issues_of(failed, "FAILED_FILE").union(issues_of(resolved.where("class = 'unresolved'"), "UNRESOLVED_IMPORT"))
    open_ones = resolved.where("class = 'unclassified'").withColumn("reason", F.lit("no proven repository target or standard-library classification"))
    issues = issues.union(issues_of(open_ones, "UNCLASSIFIED_IMPORT"))
    evidence = evidence_of(resolved.where("target is not null"), "IMPORTS", F.col("target"), files)
    return Fragment(graph, evidence, issues, resolved.select("path", "class"), facts.where("fact in ('parsed', 'failed')").select("path", (F.col("fact") == "failed").alias("failed")))
