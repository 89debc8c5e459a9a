"""Go facts: extraction by file, then modules, packages, imports and export uses by joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.paths import ladder
from cairn.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph
from cairn.session import cut
from cairn.sources import go_syntax
from cairn.sources.fragment import Fragment, evidence_of, issues_of

# The first path elements of the standard library.
STANDARD = (
    "archive", "bufio", "builtin", "bytes", "cmp", "compress", "container", "context", "crypto", "database", "debug", "embed", "encoding", "errors", "expvar", "flag", "fmt", "go", "hash", "html", "image", "index", "io", "iter", "log",
    "maps", "math", "mime", "net", "os", "path", "plugin", "reflect", "regexp", "runtime", "slices", "sort", "strconv", "strings", "structs", "sync", "syscall", "testing", "text", "time", "unicode", "unique", "unsafe", "weak",
)
MODULES = "dir string, path string, requires array<string>, replaced array<string>, targets array<string>, excluded array<string>"
DECLARED = ("FUNCTION", "METHOD", "STRUCT", "INTERFACE", "TYPE", "VARIABLE", "CONSTANT")


def directory(path: str):
    """The folder of a path, `.` at the root."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def _by_file(files: DataFrame, read, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [r for path, content in zip(frame["path"], frame["content"]) for r in read(path, bytes(content))]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int32" for c in columns if c in ("line", "column", "end_line", "end_column")})

    return files.select("path", "content").mapInPandas(run, schema)


def extract(files: DataFrame) -> DataFrame:
    """Facts of the .go files of files(path, content): see go_syntax."""
    return _by_file(files.where(F.col("path").endswith(".go")), go_syntax.facts_of, go_syntax.FACTS)


def _manifests(files: DataFrame, name: str) -> DataFrame:
    def read(path, content):
        m = go_syntax.module_of(content)
        yield path.rpartition("/")[0] or ".", m["path"], m["requires"], m["replaced"], m["targets"], m["excluded"], m["uses"]

    return _by_file(files.where(F.regexp_extract("path", "([^/]*)$", 1) == name), read, MODULES + ", uses array<string>")


def modules_of(files: DataFrame) -> DataFrame:
    """MODULES of the go.mod files; path is null where there is no module line."""
    return _manifests(files, "go.mod").drop("uses")


def workspaces_of(files: DataFrame) -> DataFrame:
    """(dir, uses) of the go.work files: uses are folders from the root."""
    rows = _manifests(files, "go.work").select("dir", "uses")
    return rows.select("dir", F.transform("uses", lambda u: clean(F.concat_ws("/", F.col("dir"), u))).alias("uses"))


def clean(path):
    """A path without `.` elements and with `..` taken back, `.` for the root; null where it leaves the root."""
    step = lambda acc, e: F.when(acc.isNull() | (e == ".") | (e == ""), acc).when(e == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))).otherwise(F.array_append(acc, e))
    out = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(out == "", ".").otherwise(out)


def within(path, prefix):
    """Whether a path is the prefix or below it."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def prefixes(path):
    """All that a path is or is below, at element boundaries, from short to long."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def nearest_above(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """rows(dir, ...) with `name`: the row of places(dir, ...) of the nearest folder at or above, as a struct; null without one."""
    parts = F.split("dir", "/")
    up = F.when(F.col("dir") == ".", F.array(F.struct(F.lit(0).alias("k"), F.lit(".").alias("above")))).otherwise(
        F.concat(F.array(F.struct(F.lit(0).alias("k"), F.lit(".").alias("above"))), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("above"))))
    )
    above = rows.select("dir").distinct().select("dir", F.explode(up).alias("a")).select("dir", "a.k", "a.above")
    found = above.join(places.select(F.col("dir").alias("above"), F.struct(*places.columns).alias("place")), "above")
    return rows.join(found.groupBy("dir").agg(F.max_by("place", "k").alias(name)), "dir", "left")


def _longest(array, path):
    """The longest element of an array that is the path or a prefix of it; null without one."""
    return F.aggregate(F.filter(F.coalesce(array, F.array().cast("array<string>")), lambda r: within(path, r)), F.lit(None).cast("string"), lambda a, r: F.when(a.isNull() | (F.length(r) > F.length(a)), r).otherwise(a))


def _below(base, rest):
    return F.when(rest == "", base).when(base == ".", rest).otherwise(F.concat(base, F.lit("/"), rest))


def resolve(facts: DataFrame, modules: DataFrame, workspaces: DataFrame, standard: DataFrame | None = None) -> DataFrame:
    """Imports with class, target (a package id), reason, alias and place; the first rung that holds decides.

    An import leads to a folder of its own module, of a module that a replacement in its module
    names, or of one that the workspace uses; a longer requirement or replacement shadows the own
    module's folders. One analyzed package there that is no test package is the target. The
    standard library is standard(path), the packages of a toolchain's list; without one, all that
    begins with one of its first path elements.
    """
    known = modules.where("path is not null")
    package = facts.where("fact = 'parsed'").select("path", directory("path").alias("dir"), F.col("name").alias("package"))
    package = nearest_above(package, known, "own")
    packages = package.where("own is not null and not endswith(package, '_test')").groupBy("dir").agg(F.sort_array(F.collect_set("package")).alias("packages"))
    rows = facts.where("fact = 'import'").withColumnRenamed("name", "alias").join(package.select("path", "dir", "own"), "path")
    literal = F.col("detail")
    rows = rows.withColumn("import_path", F.when(literal.startswith("`"), F.regexp_replace(literal, "`", "")).when(literal.contains("\\"), F.lit(None)).otherwise(F.expr("substring(detail, 2, length(detail) - 2)")))
    rows = nearest_above(rows.drop("dir").withColumn("dir", F.coalesce("own.dir", F.lit("."))), workspaces, "work")
    path, own = F.col("import_path"), F.col("own")
    included = F.coalesce(F.array_contains("work.uses", F.col("own.dir")), F.lit(False))
    active = F.col("work").isNotNull()
    usable = own.isNotNull() & (~active | included)
    shadow = F.greatest(F.length(_longest(own["requires"], path)), F.length(_longest(own["replaced"], path)))
    inside = F.coalesce(within(path, own["path"]), F.lit(False))
    shadowed = F.coalesce(shadow > F.length(own["path"]), F.lit(False))
    old = _longest(own["replaced"], path)
    target = F.element_at(own["targets"], F.array_position(own["replaced"], old).cast("int"))
    rest = lambda whole, prefix: F.regexp_replace(F.expr("substring(import_path, 1)").substr(F.length(prefix) + 1, F.length(whole)), "^/", "")
    by_module = F.when(inside & ~shadowed, _below(own["dir"], rest(path, own["path"])))
    by_replacement = F.when(target.rlike(r"\A\.\.?(/|\z)"), _below(clean(F.concat_ws("/", own["dir"], target)), rest(path, old)))
    rows = rows.withColumns({"import_path": path, "active": active, "included": included, "inside": inside, "shadowed": shadowed, "lookup": F.when(usable, F.coalesce(by_replacement, by_module))})
    # a workspace's other modules, by the longest of their paths
    used = workspaces.select(F.col("dir").alias("work_dir"), F.explode("uses").alias("dir")).join(known.select("dir", F.col("path").alias("module")), "dir").select("work_dir", F.col("dir").alias("used_dir"), "module")
    asked = rows.where("active and included and lookup is null and import_path is not null").select(F.col("work.dir").alias("work_dir"), "import_path").distinct()
    asked = asked.withColumn("module", F.explode(prefixes(F.col("import_path"))))
    found = asked.join(used, ["work_dir", "module"]).groupBy("work_dir", "import_path").agg(F.max_by(F.struct("used_dir", "module"), F.length("module")).alias("u"))
    rows = rows.withColumn("work_dir", F.col("work.dir")).join(found, ["work_dir", "import_path"], "left")
    rows = rows.withColumn("lookup", F.coalesce("lookup", F.when(F.col("u").isNotNull(), _below(F.col("u.used_dir"), rest(F.col("import_path"), F.col("u.module"))))))
    # a folder of another module below is not the own module's
    owner = nearest_above(rows.select(F.col("lookup").alias("dir")).where("dir is not null").distinct(), known, "m").select(F.col("dir").alias("lookup"), F.col("m.dir").alias("lookup_module"))
    rows = rows.join(owner, "lookup", "left").join(packages.withColumnRenamed("dir", "lookup"), "lookup", "left")
    foreign = F.col("inside") & ~F.col("shadowed") & (F.coalesce("lookup_module", F.lit("")) != F.coalesce("own.dir", F.lit(""))) & ~F.col("active")
    n = F.when(foreign, F.lit(0)).otherwise(F.coalesce(F.size("packages"), F.lit(0)))
    longest = _longest(F.col("own.requires"), F.col("import_path"))
    external = longest.isNotNull() & ~F.coalesce(F.array_contains("own.replaced", longest) | F.array_contains("own.excluded", longest), F.lit(False))
    scanned = known.select(F.col("path").alias("module")).distinct()
    above = rows.select("import_path").distinct().withColumn("module", F.explode(prefixes(F.col("import_path"))))
    match = above.join(scanned, "module").select("import_path", F.lit(True).alias("matches")).distinct()
    rows = rows.join(match, "import_path", "left")
    if standard is None:
        known_standard = F.split("import_path", "/")[0].isin(*STANDARD)
    else:
        listed = standard.select(F.col("path").alias("import_path"), F.lit(True).alias("listed")).distinct()
        rows, known_standard = rows.join(listed, "import_path", "left"), F.coalesce("listed", F.lit(False))
    rungs = [
        ("unresolved", F.col("import_path").isNull(), "invalid import path literal"),
        ("cgo", F.col("import_path") == "C", None),
        ("standard_library", known_standard, None),
        ("unclassified", F.col("own").isNull(), "repository module path unavailable"),
        ("internal_resolved", n == 1, None),
        ("unresolved", n > 1, "multiple local packages match"),
        ("unresolved", F.col("inside") & ~F.col("shadowed") & F.col("active") & ~F.col("included"), "source module is not included in active Go workspace"),
        ("unresolved", F.col("inside") & ~F.col("shadowed"), "same-module package not found or could not be analyzed"),
        ("unresolved", F.col("lookup").isNotNull(), "local package not found or could not be analyzed"),
        ("unclassified", external & F.col("active") & ~F.col("included"), "source module is not included in active Go workspace"),
        ("unclassified", external & F.col("active"), "Go workspace may override the declared dependency"),
        ("external", external, None),
        ("unclassified", F.coalesce("matches", F.lit(False)), "matching scanned module has no proven local resolution"),
    ]
    kind = ladder([(c, F.coalesce(h, F.lit(False))) for c, h, _ in rungs], "unclassified")
    reason = ladder([(r, F.coalesce(h, F.lit(False))) for _, h, r in rungs], "no evidence of a standard-library, repository, or external dependency")
    place = ["line", "column", "end_line", "end_column", "snippet", "truncated"]
    target_id = F.when(F.col("class") == "internal_resolved", F.concat(F.lit("package:"), "lookup", F.lit("#"), F.col("packages")[0]))
    rows = rows.withColumns({"class": kind, "reason": reason})
    return rows.select("path", F.coalesce("import_path", "detail").alias("import_path"), "class", target_id.alias("target"), "reason", "alias", *place)


def unbound(facts: DataFrame) -> DataFrame:
    """The references whose name no local binding takes.

    A sweep over the places of a file and name: each binding's interval counts one up where it
    begins and one down where it ends, so a reference is free where the sum is zero. Every row is
    sorted once, however many bindings and references of a name a file has.
    """
    place = ["line", "column", "end_line", "end_column", "snippet", "truncated"]
    used = facts.where("fact = 'reference'").select("path", "name", "detail", *place, F.lit(0).alias("step"))
    held = facts.where("fact = 'binding'").join(used.select("path", "name").distinct(), ["path", "name"], "left_semi")
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(["detail", *place[2:]], ("string", "int", "int", "string", "boolean"))]
    at = lambda line, column, step: held.select("path", "name", none[0], F.col(line).alias("line"), F.col(column).alias("column"), *none[1:], F.lit(step).alias("step"))
    # an interval holds from its begin to before its end
    order = Window.partitionBy("path", "name").orderBy("line", "column", F.col("step") == 0).rowsBetween(Window.unboundedPreceding, 0)
    rows = used.union(at("line", "column", 1)).union(at("end_line", "end_column", -1)).withColumn("open", F.sum("step").over(order))
    return rows.where("step = 0 and open = 0").select("path", "name", "detail", *place)


def export_uses(facts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses: path, provider and place of each reference to one analyzed export; issues of those without a single provider).

    A reference's name is an import's alias, or the name of the package that it leads to, and is
    not bound locally. Imports are a file's, and hold before names of the package. Names that two
    imports of a file have are left out, and exports of test files and methods. Dot and blank
    imports bind no name.
    """
    place = ["line", "column", "end_line", "end_column", "snippet", "truncated"]
    package = facts.where("fact = 'parsed'").select("path", F.concat(F.lit("package:"), directory("path"), F.lit("#"), "name").alias("package"))
    public = facts.where(F.col("fact").isin(*DECLARED) & (F.col("fact") != "METHOD") & ~F.col("path").endswith("_test.go") & F.col("name").rlike(r"\A\p{Lu}"))
    providers = public.join(package, "path").groupBy("package", F.col("name").alias("export")).agg(F.collect_list(F.concat(F.lit("file:"), "path")).alias("providers"))
    name = F.coalesce("alias", F.regexp_extract("target", "#(.*)$", 1))
    bound = resolved.where("target is not null").select("path", name.alias("alias"), "import_path", "target").where("alias not in ('.', '_')")
    single = bound.groupBy("path", "alias").agg(F.count("*").alias("k"), F.first("import_path").alias("import_path"), F.first("target").alias("package")).where("k = 1").drop("k")
    used = unbound(facts).select("path", F.col("name").alias("alias"), F.col("detail").alias("export"), *place)
    used = used.join(single, ["path", "alias"]).join(providers, ["package", "export"], "left")
    one = F.coalesce(F.size("providers") == 1, F.lit(False))
    lost = used.where(~one).select("path", "import_path", F.format_string("qualified reference %s.%s has no unique exported declaration in analyzed files", "alias", "export").alias("reason")).distinct()
    return used.where(one).select("path", F.col("providers")[0].alias("provider"), *place), issues_of(lost, "UNRESOLVED_EXPORT_SOURCE")


def go_fragment(files: DataFrame, facts: DataFrame | None = None) -> Fragment:
    """Modules, packages, files and declarations of files(path, content), with containment, imports, export uses, evidence, issues and import counts."""
    facts = extract(files) if facts is None else facts
    modules, workspaces = modules_of(files), workspaces_of(files)
    modules, workspaces, resolved = cut(modules), cut(workspaces), cut(resolve(facts, modules, workspaces))
    uses, lost = (cut(rows) for rows in export_uses(facts, resolved))
    go, none = F.lit("go").alias("language"), F.lit(None).cast("int")
    parsed = nearest_above(facts.where("fact = 'parsed'").select("path", directory("path").alias("dir"), F.col("name").alias("package")), modules.where("path is not null"), "own")
    package_id = F.concat(F.lit("package:"), "dir", F.lit("#"), "package")
    module_id = F.concat(F.lit("module:"), F.col("own.dir"), F.lit("#"), F.col("own.path"))
    file_id = F.concat(F.lit("file:"), "path")
    own = facts.where(F.col("fact").isin(*DECLARED)).select("path", "fact", "name", F.coalesce("detail", "name").alias("identity")).distinct()
    public = F.element_at(F.split("name", r"\."), -1).rlike(r"\A\p{Lu}")
    listed = facts.where(F.col("fact").isin(*DECLARED)).groupBy("path").agg(F.count_if(public).cast("int").alias("exports"))
    imported = facts.where("fact = 'import'").groupBy("path").agg(F.count("*").cast("int").alias("imports"))
    declared_id = F.concat(F.lower("fact"), F.lit(":"), "path", F.lit("#"), "identity")
    node = lambda rows, i, kind, path, name, a=none, b=none: rows.select(i.alias("id"), kind.alias("kind"), path.alias("path"), name.alias("name"), go, a.alias("import_count"), b.alias("export_count"))
    nodes = node(modules.where("path is not null"), F.concat(F.lit("module:"), "dir", F.lit("#"), "path"), F.lit("MODULE"), F.col("dir"), F.col("path"))
    nodes = nodes.union(node(parsed, package_id, F.lit("PACKAGE"), F.col("dir"), F.col("package")))
    counted = parsed.join(imported, "path", "left").join(listed, "path", "left")
    nodes = nodes.union(node(counted, file_id, F.lit("FILE"), F.col("path"), F.regexp_extract("path", "([^/]*)$", 1), F.coalesce("imports", F.lit(0)), F.coalesce("exports", F.lit(0))))
    nodes = nodes.union(node(own, declared_id, F.col("fact"), F.col("path"), F.col("name"))).distinct()
    edge = lambda rows, kind, a, b: rows.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"))
    edges = edge(parsed.where("own is not null"), "CONTAINS", module_id, package_id).union(edge(parsed, "CONTAINS", package_id, file_id)).union(edge(own, "CONTAINS", file_id, declared_id))
    edges = edges.union(edge(resolved.where("target is not null"), "IMPORTS", file_id, F.col("target"))).union(edge(uses, "USES_EXPORT", file_id, F.col("provider"))).distinct()
    evidence = evidence_of(resolved.where("target is not null"), "IMPORTS", F.col("target"), files).union(evidence_of(uses, "USES_EXPORT", F.col("provider"), files))
    failed = issues_of(facts.where("fact = 'failed'").select("path", F.lit("").alias("import_path"), F.col("detail").alias("reason")), "FAILED_FILE")
    issues = failed.union(issues_of(resolved.where("class = 'unresolved'"), "UNRESOLVED_IMPORT")).union(issues_of(resolved.where("class = 'unclassified'"), "UNCLASSIFIED_IMPORT")).union(lost)
    nameless = modules.where("path is null").select(_below(F.col("dir"), F.lit("go.mod")).alias("path"), F.lit("").alias("import_path"), F.lit("module path unavailable").alias("reason"))
    some = modules.agg(F.count("*").alias("all"), F.count("path").alias("named"))
    outside = parsed.where("own is null").join(some.where("named > 0"), how="inner").select("path", F.lit("").alias("import_path"), F.lit("no enclosing go.mod; internal imports cannot be resolved").alias("reason"))
    nowhere = facts.agg(F.count("*").alias("n")).where("n > 0").join(some.where("all = 0"), how="inner").select(F.lit(".").alias("path"), F.lit("").alias("import_path"), F.lit("no go.mod found; internal imports cannot be resolved").alias("reason"))
    issues = issues.union(issues_of(nameless.union(outside).union(nowhere), "MODULE_ERROR"))
    return Fragment(CodeGraph(nodes.select(NODE_COLUMNS), edges.select(EDGE_COLUMNS)), evidence, issues, resolved.select("path", "class"), facts.where("fact in ('parsed', 'failed')").select("path", (F.col("fact") == "failed").alias("failed")))
