"""TypeScript and JavaScript facts: extraction by file, then configuration, packages and imports by joins."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.paths import ladder, language_of, package_name, suffix_of
from cairn.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph
from cairn.schema import TSJS_SUFFIXES
from cairn.session import cut
from cairn.sources import tsjs_syntax
from cairn.sources.fragment import Fragment, evidence_of, issues_of
from cairn.sources.go_facts import clean, directory, nearest_above

# Modules that come with the runtime, and the source suffixes that stand behind emitted ones.
BUILTIN = ("assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib")
BEHIND = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
CONFIG = "dir string, rank int, base string, aliases array<struct<key:string,targets:array<string>>>, invalid boolean, reason string"
PACKAGE = "dir string, names array<string>, reason string"
DECLARED = ("FUNCTION", "CLASS", "METHOD", "INTERFACE", "TYPE", "VARIABLE", "ENUM")


def extract(files: DataFrame) -> DataFrame:
    """Facts of the TypeScript and JavaScript files of files(path, content): see tsjs_syntax."""
    columns = [c.split()[0] for c in tsjs_syntax.FACTS.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [(i, *r) for path, content in zip(frame["path"], frame["content"]) for i, r in enumerate(tsjs_syntax.facts_of(path, bytes(content)))]
            out = pd.DataFrame(rows, columns=["at", *columns])
            yield out.astype({c: "Int32" for c in ("at", "line", "column", "end_line", "end_column")})

    return files.where(suffix_of(F.col("path")).isin(*TSJS_SUFFIXES)).select("path", "content").mapInPandas(run, "at int, " + tsjs_syntax.FACTS)


def _config(content: bytes) -> tuple:
    """(base, aliases, invalid, reason) of a tsconfig or jsconfig file; comments and trailing commas are allowed."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", content.decode(errors="replace"), flags=re.S)
    try:
        value = json.loads(re.sub(r",(?=\s*[}\]])", "", text) or "{}")
        options = value.get("compilerOptions") or {}
        base, paths = options.get("baseUrl") or "", options.get("paths") or {}
        aliases = [(str(k), [str(t) for t in v]) for k, v in paths.items()]
    except (ValueError, AttributeError, TypeError) as e:
        return "", [], True, f"invalid configuration: {e}"
    if any(k in value for k in ("references",)) or any(k in options for k in ("rootDirs", "moduleSuffixes")):
        return base, [], True, "project references, rootDirs and moduleSuffixes resolution are unsupported"
    if "extends" in value:
        return base, [], True, "configuration extends is unsupported"
    odd = lambda t, key: t.startswith("/") or "\\" in t or t.count("*") > 1 or ("*" in t and "*" not in key)
    if base.startswith("/") or "\\" in base or any(k.count("*") > 1 or any(odd(t, k) for t in v) for k, v in aliases):
        return base, [], True, "complex configuration alias is unsupported"
    return base, aliases, False, None


def _package(content: bytes) -> tuple:
    """(declared names, reason) of a package.json file."""
    try:
        value = json.loads(content.decode(errors="replace"))
        names = sorted({n for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for n in (value.get(k) or {}).keys()})
    except ValueError as e:
        return [], f"package metadata: {e}"
    except AttributeError:
        return [], "invalid package metadata"
    return names, "package workspaces are not resolved" if value.get("workspaces") is not None else None


def _read(files: DataFrame, names: tuple[str, ...], read, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]

    def run(frames):
        for frame in frames:
            rows = [(p.rpartition("/")[0] or ".", *read(p.rpartition("/")[2], bytes(c))) for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=columns)

    return files.where(F.regexp_extract("path", "([^/]*)$", 1).isin(*names)).select("path", "content").mapInPandas(run, schema)


def configs_of(files: DataFrame) -> DataFrame:
    """CONFIG of each folder: its tsconfig.json, else its jsconfig.json."""
    named = ("tsconfig.json", "jsconfig.json")

    def read(name, content):
        base, aliases, invalid, reason = _config(content)
        return named.index(name), base, [{"key": k, "targets": t} for k, t in aliases], invalid, reason

    rows = _read(files, named, read, CONFIG)
    return rows.groupBy("dir").agg(F.min_by(F.struct("base", "aliases", "invalid", "reason"), "rank").alias("c")).select("dir", "c.*")


def packages_of(files: DataFrame) -> DataFrame:
    """PACKAGE of each folder with a package.json."""
    return _read(files, ("package.json",), lambda _, content: _package(content), PACKAGE)


def candidates(base):
    """Groups of paths that a specifier's path may stand for, as (rank, path): the first group with files decides."""
    suffix = suffix_of(base)
    stem = F.regexp_replace(base, r"\.[^./]*$", "")
    group = lambda rank, paths: F.transform(paths, lambda p: F.struct(F.lit(rank).alias("rank"), p.alias("candidate")))
    none = F.array().cast("array<string>")
    source = none
    for emitted, behind in BEHIND.items():
        source = F.when(suffix == emitted, F.array(*(F.concat(stem, F.lit(s)) for s in behind))).otherwise(source)
    ends = lambda end: F.when(suffix == "", F.array(*(F.concat(base, F.lit(end + s)) for s in TSJS_SUFFIXES))).otherwise(none)
    return F.concat(group(0, source), group(1, F.array(base)), group(2, ends("")), group(3, ends("/index")))


def resolve(imports: DataFrame, files: DataFrame, configs: DataFrame, packages: DataFrame) -> DataFrame:
    """imports(path, spec, ..) with class, target and reason, for the source files(path) and the configurations and packages by folder.

    Modules of the runtime come first. Relative specifiers lead to the file's folder, others by an
    exact alias, the longest wildcard prefix or the base folder; two wildcards of one length are
    ambiguous. One file found is the target. What leads nowhere local may be a declared package.

    Only a file's folder and the specifier decide, so each pair of them is resolved once.
    """
    asking = imports.withColumns({"_dir": directory("path"), "_spec": F.col("spec")})
    rows = asking.select(F.col("_dir").alias("dir"), "spec").distinct()
    rows = nearest_above(nearest_above(rows, configs, "config"), packages, "package")
    spec, c = F.col("spec"), F.col("config")
    relative = spec.rlike(r"\A\.\.?/")
    head, tail = lambda k: F.split(k, r"\*", 2)[0], lambda k: F.split(k, r"\*", 2)[1]
    wild = lambda k: k.contains("*")
    fits = lambda a: F.when(wild(a["key"]), spec.startswith(head(a["key"])) & spec.endswith(tail(a["key"])) & (F.length(spec) >= F.length(head(a["key"])) + F.length(tail(a["key"])))).otherwise(a["key"] == spec)
    matching = F.filter(F.coalesce(c["aliases"], F.array().cast("array<struct<key:string,targets:array<string>>>")), fits)
    rank = lambda a: F.struct(F.when(wild(a["key"]), 1).otherwise(0).alias("wild"), F.negative(F.length(head(a["key"]))).alias("short"), a["key"].alias("key"), a["targets"].alias("targets"))
    rows = rows.withColumns({"relative": relative, "matching": F.sort_array(F.transform(matching, rank))})
    best, second = F.get("matching", F.lit(0)), F.get("matching", F.lit(1))
    tied = F.coalesce((best["wild"] == 1) & (second["short"] == best["short"]), F.lit(False))
    star = F.when(best["wild"] == 1, spec.substr(F.length(head(best["key"])) + 1, F.length(spec) - F.length(head(best["key"])) - F.length(tail(best["key"])))).otherwise("")
    root = F.concat_ws("/", c["dir"], c["base"])
    aliased = F.transform(best["targets"], lambda t: F.concat_ws("/", root, F.replace(t, F.lit("*"), star)))
    bases = F.when(relative, F.array(F.concat_ws("/", "dir", spec))).when(best.isNotNull(), aliased).when(c["base"] != "", F.array(F.concat_ws("/", root, spec))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"alias": best.isNotNull(), "tied": tied, "bases": F.array_distinct(F.transform(bases, clean))})
    asked = rows.select("dir", "spec", F.explode("bases").alias("base")).where("base is not null")
    choice = asked.select("base").distinct().select("base", F.explode(candidates(F.col("base"))).alias("c")).select("base", "c.*")
    found = choice.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    first = found.groupBy("base").agg(F.min("rank").alias("rank"))
    found = found.join(first, ["base", "rank"]).groupBy("base").agg(F.collect_set("candidate").alias("hits"))
    targets = asked.join(found, "base").select("dir", "spec", F.explode("hits").alias("hit")).groupBy("dir", "spec").agg(F.sort_array(F.collect_set("hit")).alias("targets"))
    rows = rows.join(targets, ["dir", "spec"], "left").withColumn("n", F.coalesce(F.size("targets"), F.lit(0)))
    declared = F.coalesce(F.array_contains("package.names", package_name(spec)), F.lit(False))
    builtin = F.regexp_replace(spec, "^node:", "")
    local = F.col("relative") | F.col("alias")
    rungs = [
        ("standard_library", F.regexp_extract(builtin, "^([^/]*)", 1).isin(*BUILTIN), None),
        ("unresolved", F.coalesce(c["invalid"], F.lit(False)), "resolution unavailable for unsupported configuration"),
        ("unresolved", ~F.col("relative") & (spec.rlike(r"\A[/#]") | spec.contains(":")), "unsupported absolute, package-import or URL specifier"),
        ("unresolved", F.col("tied"), "ambiguous matching alias patterns"),
        ("unresolved", F.col("alias") & (F.size("bases") == 0), "alias has no source targets"),
        ("internal_resolved", F.col("n") == 1, None),
        ("unresolved", F.col("n") > 1, "ambiguous scanned source targets"),
        ("unresolved", local, "no uniquely resolved scanned source target (missing, excluded or unsupported asset)"),
        ("external", declared, None),
    ]
    kind = ladder([(k, F.coalesce(h, F.lit(False))) for k, h, _ in rungs], "unclassified")
    reason = ladder([(r, F.coalesce(h, F.lit(False))) for _, h, r in rungs], "no proven local target, builtin or declared package")
    target = F.when(kind == "internal_resolved", F.concat(F.lit("file:"), F.col("targets")[0]))
    rows = rows.select(F.col("dir").alias("_d"), F.col("spec").alias("_s"), kind.alias("class"), target.alias("target"), reason.alias("reason"))
    decided = asking.join(rows, F.col("_dir").eqNullSafe(F.col("_d")) & F.col("_spec").eqNullSafe(F.col("_s")))
    return decided.select(*imports.columns, "class", "target", "reason")


def imports_of(facts: DataFrame) -> DataFrame:
    """(path, spec and place) of the static imports and re-exports."""
    return facts.where("fact = 'import'").select("path", F.col("name").alias("spec"), "line", "column", "end_line", "end_column", "snippet", "truncated")


def tsjs_fragment(files: DataFrame, facts: DataFrame | None = None) -> Fragment:
    """Files and declarations of files(path, content), with containment, imports, evidence, issues and import counts."""
    facts = extract(files) if facts is None else facts
    parsed = facts.where("fact = 'parsed'").select("path")
    configs, packages = configs_of(files), packages_of(files)
    configs, packages = cut(configs), cut(packages)
    resolved = cut(resolve(imports_of(facts), parsed, configs, packages))
    language, none = language_of(F.col("path")).alias("language"), F.lit(None).cast("int")
    counts = facts.where("fact = 'import'").groupBy("path").agg(F.count("*").cast("int").alias("n"))
    file_id = F.concat(F.lit("file:"), "path")
    node = lambda rows, i, kind, name, a=none: rows.select(i.alias("id"), kind.alias("kind"), "path", name.alias("name"), language, a.alias("import_count"), none.alias("export_count"))
    again = F.row_number().over(Window.partitionBy("path", "fact", "name").orderBy("at")) - 1  # a file's declarations of one name
    declared = facts.where(F.col("fact").isin(*DECLARED)).withColumn("again", again)
    own = F.concat(F.lit("tsjs-declaration:"), F.to_json(F.array("fact", "path", "name", F.col("again").cast("string"))))
    nodes = node(parsed.join(counts, "path", "left"), file_id, F.lit("FILE"), F.regexp_extract("path", "([^/]*)$", 1), F.coalesce("n", F.lit(0))).union(node(declared, own, F.col("fact"), F.col("name")))
    edge = lambda rows, kind, a, b: rows.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"))
    edges = edge(declared, "CONTAINS", file_id, own).union(edge(resolved.where("target is not null"), "IMPORTS", file_id, F.col("target")).distinct())
    plain = lambda rows, reason: rows.select("path", F.lit("").alias("import_path"), reason.alias("reason"))
    placed = parsed.withColumn("dir", directory("path"))
    told = nearest_above(nearest_above(placed, configs, "config"), packages, "package").select("path", F.explode(F.array_compact(F.array("config.reason", "package.reason"))).alias("detail"))
    limits = facts.where("fact = 'limitation'").select("path", "detail").union(told)
    named = resolved.withColumnRenamed("spec", "import_path")
    issues = issues_of(plain(facts.where("fact = 'failed'"), F.col("detail")), "FAILED_FILE").union(issues_of(plain(limits, F.col("detail")), "TSJS_LIMITATION"))
    issues = issues.union(issues_of(named.where("class = 'unresolved'"), "UNRESOLVED_IMPORT")).union(issues_of(named.where("class = 'unclassified'"), "UNCLASSIFIED_IMPORT"))
    evidence = evidence_of(resolved.where("target is not null"), "IMPORTS", F.col("target"), files)
    return Fragment(CodeGraph(nodes.select(NODE_COLUMNS), edges.select(EDGE_COLUMNS)), evidence, issues, resolved.select("path", "class"), facts.where("fact in ('parsed', 'failed')").select("path", (F.col("fact") == "failed").alias("failed")))
