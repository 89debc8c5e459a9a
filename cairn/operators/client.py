"""Relational operators of the map: counts, roles, visible graph, lines, bundles and labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.graph import EDGE_COLUMNS, CodeGraph, is_declaration, role_of
from cairn.operators.hierarchy import ancestors, parents
from cairn.operators.projection import Projection
from cairn.operators.queries import Neighborhood
from cairn.session import cut, few, stored


def fact_key(kind, from_id, to_id):
    return F.concat(kind, F.lit(":"), from_id, F.lit("->"), to_id)


def _file_packages(graph: CodeGraph) -> DataFrame:
    """(file, package) of files directly in a package."""
    files = graph.nodes.where("kind = 'FILE'").select(F.col("id").alias("child"))
    packages = graph.nodes.where("kind = 'PACKAGE'").select(F.col("id").alias("parent"))
    return parents(graph).join(files, "child", "left_semi").join(packages, "parent", "left_semi").select(F.col("child").alias("file"), F.col("parent").alias("package"))


def package_source_counts(graph: CodeGraph, known_files: DataFrame | None = None) -> DataFrame:
    """(id, imports, exports) of every package: sums over its files, null where one is unknown, 0 without files.

    Both are null where known_files(id, files) tells of more files than the graph has.
    """
    files = _file_packages(graph).join(graph.nodes.select(F.col("id").alias("file"), "import_count", "export_count"), "file")
    known = lambda c: F.when(F.count("*") == F.count(c), F.sum(c))
    sums = files.groupBy(F.col("package").alias("id")).agg(F.count("*").alias("some"), known("import_count").alias("i"), known("export_count").alias("e"))
    out = graph.nodes.where("kind = 'PACKAGE'").select("id").join(sums, "id", "left")
    out = out.join(known_files.select("id", "files"), "id", "left") if known_files is not None else out.withColumn("files", F.lit(None).cast("long"))
    partly = F.coalesce(F.coalesce("some", F.lit(0)) < F.col("files"), F.lit(False))
    whole = lambda c: F.when(~partly, F.when(F.col("some").isNull(), F.lit(0)).otherwise(F.col(c))).cast("long")
    return out.select("id", whole("i").alias("imports"), whole("e").alias("exports"))


def file_roles(graph: CodeGraph) -> DataFrame:
    """(id, role): files that import, and files that supply by being imported or used."""
    files = graph.nodes.where("kind = 'FILE'").select("id")
    importing = graph.imports().select(F.col("from_id").alias("id"), F.lit("importing").alias("role"))
    supplied = graph.imports().select(F.col("to_id").alias("id")).join(files, "id", "left_semi")
    used = graph.edges.where("kind = 'USES_EXPORT'").select(F.col("to_id").alias("id"))
    return importing.union(supplied.union(used).select("id", F.lit("supplying"))).distinct()


def connected_packages(projection: Projection, package: str) -> DataFrame:
    """(id): the package and its projected neighbours in either direction."""
    e = projection.graph.edges
    near = e.where(F.col("from_id") == package).select(F.col("to_id").alias("id")).union(e.where(F.col("to_id") == package).select("from_id"))
    return near.union(projection.graph.nodes.where(F.col("id") == package).select("id")).distinct()


def export_uses(graph: CodeGraph) -> DataFrame:
    """(importer, package, provider): the files whose exports an importer uses, each with what contains it."""
    used = graph.edges.where("kind = 'USES_EXPORT'").select(F.col("from_id").alias("importer"), F.col("to_id").alias("provider"))
    return used.join(parents(graph).select(F.col("child").alias("provider"), F.col("parent").alias("package")), "provider").select("importer", "package", "provider").distinct()


def export_use_index(graph: CodeGraph) -> DataFrame:
    """(importer, package, providers): the files of each package that an importer uses exports of, by id."""
    return export_uses(graph).groupBy("importer", "package").agg(F.sort_array(F.collect_set("provider")).alias("providers"))


def _role(language: Column, kind: Column) -> Column:
    """A node's role; nodes of saved graphs without languages count as Go ones."""
    return role_of(F.coalesce(F.nullif(language, F.lit("")), F.lit("go")), kind)


def _is_module(language: Column, role: Column) -> Column:
    """Source files that are modules of their own."""
    return (role == "SOURCE") & F.coalesce(language.isin("python", "typescript", "javascript"), F.lit(False))


def present(graph: CodeGraph, counts: DataFrame | None = None) -> DataFrame:
    """Every node with its labels: one row of id and the columns of a presentation.

    counts(id, imports, exports) are the sums of packages. Files of Python and TypeScript or
    JavaScript are modules, named after their package in Python.
    """
    up = graph.nodes.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"), F.col("language").alias("parent_language"), F.col("name").alias("parent_name"))
    rows = graph.nodes.join(parents(graph).withColumnRenamed("child", "id"), "id", "left").join(up, "parent", "left")
    rows = rows.join(counts.select("id", F.col("imports").alias("i"), F.col("exports").alias("e")), "id", "left") if counts is not None else rows.withColumns({"i": F.lit(None).cast("long"), "e": F.lit(None).cast("long")})
    kind, language, name = F.col("kind"), F.col("language"), F.col("name")
    role = _role(language, kind)
    container, source = F.coalesce(role == "CONTAINER", F.lit(False)), F.coalesce(role == "SOURCE", F.lit(False))
    python = F.coalesce(language == "python", F.lit(False))
    own = F.coalesce(language.isin("python", "typescript", "javascript"), F.lit(False))
    module = source & own
    stem = F.regexp_replace(name, r"\.(py|tsx?|mts|cts|jsx?|mjs|cjs)$", "")
    inside = F.coalesce((F.col("parent_language") == "python") & (F.col("parent_kind") == "PACKAGE"), F.lit(False))
    module_name = F.when(inside & (name == "__init__.py"), F.col("parent_name")).when(inside, F.concat_ws(".", "parent_name", stem)).otherwise(stem)
    alone = F.col("parent_kind").isNull()
    pick = lambda *cases: _cases(cases)
    return rows.select(
        "id",
        pick((module, F.lit("module")), (None, F.lower(kind))).alias("display_kind"),
        pick((module, module_name), (None, name)).alias("display_name"),
        pick((module, stem), (container & python, F.element_at(F.split(name, r"\."), -1)), (container, F.col("path")), (None, name)).alias("row_name"),
        pick((module, module_name), (container & ~python, F.col("path")), (None, name)).alias("card_name"),
        pick((container, F.concat(F.lit("package "), name)), (module, F.lit("module")), (None, F.lit(None))).alias("secondary_label"),
        pick((container & python, F.lit("module")), (container, F.lit("file")), (source, F.lit("declaration")), (None, F.lit("package"))).alias("child_label"),
        pick((container & python, F.lit("Modules")), (container, F.lit("Files")), (module, F.lit("Module")), (None, F.lit("Files"))).alias("row_group_label"),
        pick((container, F.lit("container")), (source, F.lit("source")), (None, F.lit(None))).alias("expansion"),
        (container | (module & alone)).alias("primary_card"),
        pick((container, F.lit("packages")), (module & alone, F.lit("modules")), (None, F.lit(None))).alias("explorer_section"),
        pick((module, F.lit("M")), (source, F.lit("F")), (container, F.lit(None)), (None, F.lit("\u00b7"))).alias("row_mark"),
        pick((source, F.col("import_count")), (None, F.col("i"))).cast("long").alias("imports"),
        pick((own, F.lit(None)), (source, F.col("export_count")), (None, F.col("e"))).cast("long").alias("exports"),
    )


def _cases(cases) -> Column:
    """The value of the first case that holds; the last one has no condition."""
    out = cases[-1][1]
    for condition, value in reversed(cases[:-1]):
        out = F.when(condition, value).otherwise(out)
    return out


@dataclass(frozen=True)
class VisibleGraph:
    """What shows in a state of expansion.

    nodes: the graph's columns with parent_id, child_count and expanded. edges(id, kind, source,
    target, projected, supporting_count): projected is the key of the package edge that an edge
    stands for or belongs to. evidence(edge_id, kind, from_id, to_id): the facts behind each edge.
    """

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame

    def held(self) -> VisibleGraph:
        """The same with its edges and evidence in tables, for those that read them several times."""
        return VisibleGraph(self.nodes, stored(self.edges), stored(self.evidence))


def visible_graph(
    graph: CodeGraph, projection: Projection, expanded_packages: DataFrame, expanded_files: DataFrame, kinds: tuple[str, ...] = (),
    child_counts: DataFrame | None = None, file_counts: DataFrame | None = None, totals: DataFrame | None = None,
) -> VisibleGraph:
    """The visible graph for expanded_packages(id), expanded_files(id) and the kinds of declarations shown (none by default).

    Packages show, and modules that nothing contains; an expanded package shows its files, an
    expanded shown file its declarations. What is shown inside something has a CONTAINS edge.
    A projected import is one edge while its importing package is closed; an open package's
    files that show have an edge each to the imported package. Imports that are not projected
    run between what contains their ends, from the file itself where it shows. Only edges with
    both ends in view are kept. child_counts(id, children), file_counts(id, files) and
    totals(relation, total) replace what a partly loaded graph cannot count.
    """
    pair = stored(parents(graph))
    role = _role(F.col("language"), F.col("kind"))
    nodes = graph.nodes.join(pair.select(F.col("child").alias("id"), F.col("parent").alias("parent_id")), "id", "left").withColumn("role", role)
    open_packages = expanded_packages.select("id").distinct().withColumn("open", F.lit(True))
    open_files = expanded_files.select("id").distinct().withColumn("open", F.lit(True))
    packages = nodes.where("role = 'CONTAINER'").drop("parent_id").join(open_packages, "id", "left").withColumn("parent_id", F.lit(None).cast("string"))
    shown = packages.where("open").select(F.col("id").alias("parent_id"))
    files = nodes.where("role = 'SOURCE'")
    alone = files.where(F.col("parent_id").isNull() & _is_module(F.col("language"), F.col("role")))
    files = files.join(shown, "parent_id", "left_semi").unionByName(alone).join(open_files, "id", "left")
    within = files.where("open").select(F.col("id").alias("parent_id"))
    declared = nodes.where(is_declaration(F.col("kind")) & F.col("kind").isin(*kinds)).join(within, "parent_id", "left_semi").withColumn("open", F.lit(False))
    rows = packages.unionByName(files).unionByName(declared)
    own = pair.join(nodes.select(F.col("id").alias("child"), (F.col("role") == "SOURCE").alias("source")), "child").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("all_children"), F.count_if("source").alias("own_files"))
    rows = rows.join(own, "id", "left")
    told = lambda counts, name: counts.select("id", F.col(name).alias(f"told_{name}")) if counts is not None else None
    for counts, name in ((child_counts, "children"), (file_counts, "files")):
        extra = told(counts, name)
        rows = rows.join(extra, "id", "left") if extra is not None else rows.withColumn(f"told_{name}", F.lit(None).cast("long"))
    count = F.when(F.col("role") == "CONTAINER", F.coalesce("told_files", "own_files")).otherwise(F.coalesce("told_children", "all_children"))
    view = stored(rows.select(*graph.nodes.columns, "parent_id", F.coalesce(count, F.lit(0)).alias("child_count"), F.coalesce("open", F.lit(False)).alias("expanded")))

    ids = few(view.select("id"), "id")
    none, no_count = F.lit(None).cast("string"), F.lit(None).cast("long")
    held = view.where("parent_id is not null").select(fact_key(F.lit("CONTAINS"), F.col("parent_id"), F.col("id")).alias("id"), F.lit("CONTAINS").alias("kind"), F.col("parent_id").alias("source"), F.col("id").alias("target"), none.alias("projected"), no_count.alias("supporting_count"))
    seen = lambda rows, column: rows.join(ids.withColumnRenamed("id", column), column, "left_semi")
    # what shows and what is open is decided for each package edge, before its support is joined
    pairs = seen(seen(projection.support.select("from_id", "to_id").distinct(), "from_id"), "to_id").join(few(open_packages, "id").withColumnRenamed("id", "from_id"), "from_id", "left")
    pairs = cut(pairs.withColumn("projected", fact_key(F.lit("IMPORTS"), F.col("from_id"), F.col("to_id"))))
    support = projection.support.join(few(pairs, "from_id", "to_id", "projected"), ["from_id", "to_id"])
    folded = support.where("open is null")
    lifted = pairs.where("open is null").select("projected", F.col("from_id").alias("source"), F.col("to_id").alias("target"))
    lifted = lifted.join(totals.select(F.col("relation").alias("projected"), F.col("total").alias("supporting_count")), "projected", "left") if totals is not None else lifted.withColumn("supporting_count", no_count)
    lifted = lifted.select(F.col("projected").alias("id"), F.lit("IMPORTS").alias("kind"), "source", "target", "projected", "supporting_count")
    facts = seen(support.where("open and source_kind = 'IMPORTS'"), "source_from")
    if projection.of is not graph:
        imports = graph.imports().select(F.col("from_id").alias("source_from"), F.col("to_id").alias("source_to"))
        facts = facts.join(imports, ["source_from", "source_to"], "left_semi")
    facts = facts.withColumn("edge_id", fact_key(F.col("source_kind"), F.col("source_from"), F.col("source_to")))
    apart = facts.select(F.col("edge_id").alias("id"), F.lit("IMPORTS").alias("kind"), F.col("source_from").alias("source"), F.col("to_id").alias("target"), "projected", no_count.alias("supporting_count"))

    other = projection.unused(graph)
    up = lambda c: pair.select(F.col("child").alias(c), F.col("parent").alias(f"{c}_parent"))
    kind = graph.nodes.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    other = other.join(up("from_id"), "from_id", "left").join(up("to_id"), "to_id", "left").join(kind, "to_id", "left")
    other = other.withColumns({"above": F.coalesce("from_id_parent", "from_id"), "target": F.when(F.col("to_kind") == "FILE", F.coalesce("to_id_parent", "to_id")).otherwise(F.col("to_id"))})
    other = seen(seen(other, "above"), "target").join(ids.select(F.col("id").alias("from_id"), F.lit(True).alias("shows")), "from_id", "left")
    other = other.withColumn("edge_id", fact_key(F.col("kind"), F.col("from_id"), F.col("to_id")))
    stray = other.select(F.col("edge_id").alias("id"), "kind", F.when(F.col("shows"), F.col("from_id")).otherwise(F.col("above")).alias("source"), "target", none.alias("projected"), no_count.alias("supporting_count"))

    fact = lambda key: (key.alias("edge_id"), F.col("source_kind").alias("kind"), F.col("source_from").alias("from_id"), F.col("source_to").alias("to_id"))
    # the support of a closed package's edges has no row twice
    evidence = folded.select(*fact(F.col("projected"))).union(facts.select(*fact(F.col("edge_id"))).union(other.select("edge_id", "kind", "from_id", "to_id")).distinct())
    return VisibleGraph(view, held.union(lifted).union(apart).union(stray).distinct(), evidence)


#: What names a drawn route: two lines with the same are painted once.
ROUTE = ["edge_id", "source", "source_handle", "target", "target_handle"]


def import_card_lines(visible: VisibleGraph, graph: CodeGraph) -> DataFrame:
    """(id, *ROUTE, importing_file, supplying_file): the lines that draw the visible imports, from dependency to importer.

    An edge into a closed card whose facts name no file is one line. Else it has a line for each
    importer and each file that the importer imports directly, or whose exports it uses of that
    package, or one line without a supplier. Handles name the rows of open cards. The evidence is
    read several times (see VisibleGraph.held).
    """
    card = visible.nodes.select("id", "kind", "parent_id", "expanded")
    named = lambda prefix: card.select(*(F.col(c).alias(f"{prefix}_{c}") for c in card.columns))
    edges = visible.edges.where("kind = 'IMPORTS'").select(F.col("id").alias("edge_id"), F.col("source").alias("from"), F.col("target").alias("dependency"))
    edges = edges.join(named("s"), F.col("from") == F.col("s_id"), "left")
    edges = edges.withColumn("package", F.when(F.col("s_kind") == "FILE", F.coalesce("s_parent_id", "from")).otherwise(F.col("from")))
    edges = edges.join(named("t"), F.col("dependency") == F.col("t_id"), "left").join(named("p"), F.col("package") == F.col("p_id"), "left")
    is_open = lambda c: F.coalesce(F.col(c), F.lit(False))
    edges = edges.select("edge_id", "from", "dependency", "package", is_open("t_expanded").alias("supplies"), is_open("p_expanded").alias("takes"))
    reached = visible.evidence.select("to_id").distinct()
    files = few(graph.nodes.where("kind = 'FILE'").select(F.col("id").alias("to_id")).join(reached, "to_id", "left_semi"), "to_id").withColumn("direct", F.lit(True))
    facts = visible.evidence.join(files, "to_id", "left").select("edge_id", F.col("from_id").alias("importer"), F.when(F.col("direct"), F.col("to_id")).alias("provider"))
    known = facts.groupBy("edge_id").agg(F.min("importer").alias("one"), (F.min("importer") != F.max("importer")).alias("several"), F.count("provider").alias("named"))
    edges = stored(edges.join(known, "edge_id", "left"))
    whole = ~F.col("supplies") & (F.coalesce("named", F.lit(0)) == 0)
    only = F.when(~F.coalesce("several", F.lit(False)), F.coalesce("one", "from"))
    none = F.lit(None).cast("string")
    single = edges.where(whole).select(
        F.col("edge_id").alias("id"), "edge_id", F.col("dependency").alias("source"), none.alias("source_handle"), F.col("package").alias("target"),
        F.when(F.col("takes"), only).alias("target_handle"), F.when(F.col("one").isNotNull(), only).alias("importing_file"), none.alias("supplying_file"),
    )
    split = edges.where(~whole).withColumn("unknown", F.col("one").isNull()).drop("named", "several", "one")
    named = facts.where("provider is not null").distinct()
    unnamed = facts.where("provider is null").select("edge_id", "importer").distinct().join(named, ["edge_id", "importer"], "left_anti")
    alone = split.where("unknown").withColumn("importer", F.col("from"))  # no fact is known
    used = export_uses(graph).select("importer", F.col("package").alias("dependency"), "provider")
    by_use = split.join(unnamed, "edge_id").unionByName(alone).join(used, ["importer", "dependency"], "left")
    lines = split.join(named, "edge_id").unionByName(by_use)
    return single.union(
        lines.select(
            F.to_json(F.array("edge_id", "importer", "provider")).alias("id"), "edge_id", F.col("dependency").alias("source"), F.when(F.col("supplies"), F.col("provider")).alias("source_handle"),
            F.col("package").alias("target"), F.when(F.col("takes"), F.col("importer")).alias("target_handle"), F.col("importer").alias("importing_file"), F.col("provider").alias("supplying_file"),
        )
    )


def occluded(lines: DataFrame) -> DataFrame:
    """All but the last line, by importer and supplier, of each route."""
    last = Window.partitionBy(*ROUTE).orderBy(F.desc("importing_file"), F.desc("supplying_file"))
    return lines.withColumn("r", F.row_number().over(last)).where("r > 1").drop("r")


#: Ends of routes at rows that are scrolled out of a card. Fixed values.
ABOVE, BELOW = "window:above", "window:below"


@dataclass(frozen=True)
class Bundles:
    """routes(id, kind, source, source_handle, target, target_handle, edge_id, importing_file, supplying_file, members, facts, unloaded), members(bundle, line) and facts(bundle, kind, from_id, to_id)."""

    routes: DataFrame
    members: DataFrame
    facts: DataFrame


def _facts_of(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of (bundle, *held): the facts that each line stands for, namely its edge's from its importing file, if it has one, to its supplying file, if it has one, or to its edge's target.

    Joins are by all that a line names, since an edge may have as many lines as facts.
    """
    file, supplier = F.col("importing_file").isNotNull(), F.col("supplying_file").isNotNull()
    to_files = held.join(few(rows.select(F.col("supplying_file").alias("to_id")).where("to_id is not null").distinct(), "to_id"), "to_id", "left_semi")
    to_targets = held.join(few(rows.where(supplier).select(F.col("edge_target").alias("to_id")).distinct(), "to_id"), "to_id", "left_semi")
    out = []
    for which, own in ((file, [F.col("importing_file").alias("from_id")]), (~file, [])):
        for has, far, side in ((~supplier, [], held), (supplier, [F.col("supplying_file").alias("to_id")], to_files), (supplier, [F.col("edge_target").alias("to_id")], to_targets)):
            lines = rows.where(which & has).select("bundle", "edge_id", *own, *far)
            lines = lines if own else few(lines.distinct(), "bundle", "edge_id")
            out.append(few(side, "edge_id", "fact_kind", "from_id", "to_id").join(lines, [c for c in lines.columns if c != "bundle"]))
    return reduce(DataFrame.unionByName, out)


def bundle_routes(lines: DataFrame, visible: VisibleGraph, windows: DataFrame) -> Bundles:
    """Lines with the same ends in view as one route, for windows(card, file, place: above, visible or below).

    A handle whose row is in no window ends below. The least line of a route lends it its edge and
    files. facts are those that its lines stand for; unloaded is how many more its package edges
    are known to have, each edge counted once.
    """

    def end(side):
        w = windows.select(F.col("card").alias(side), F.col("file").alias(f"{side}_handle"), F.col("place").alias(f"{side}_place"))
        seen = F.when(F.col(f"{side}_place") == "above", ABOVE).when(F.col(f"{side}_place") == "visible", F.col(f"{side}_handle")).otherwise(F.lit(BELOW))
        return w, F.when(F.col(f"{side}_handle").isNotNull(), seen)

    (from_window, from_end), (to_window, to_end) = end("source"), end("target")
    edges = visible.edges.select(F.col("id").alias("edge_id"), "kind", F.col("target").alias("edge_target"), "projected", "supporting_count")
    rows = lines.join(from_window, ["source", "source_handle"], "left").join(to_window, ["target", "target_handle"], "left")
    rows = rows.withColumns({"source_handle": from_end, "target_handle": to_end}).join(edges, "edge_id")
    rows = stored(rows.withColumn("bundle", F.to_json(F.array("kind", "source", "source_handle", "target", "target_handle"))))
    held = visible.evidence.withColumnRenamed("kind", "fact_kind")
    facts = stored(_facts_of(rows, held).select("bundle", F.col("fact_kind").alias("kind"), "from_id", "to_id").distinct())
    loaded = held.groupBy("edge_id").agg(F.count("*").alias("n"))
    missing = rows.select("bundle", "projected", "supporting_count", "edge_id").distinct().join(loaded, "edge_id", "left")
    missing = missing.withColumn("rest", F.col("supporting_count") - F.coalesce("n", F.lit(0))).where("projected is not null and rest > 0")
    missing = missing.groupBy("bundle", "projected").agg(F.max("rest").alias("rest")).groupBy("bundle").agg(F.sum("rest").alias("unloaded"))
    first = F.min(F.struct("id", "edge_id", "importing_file", "supplying_file")).alias("least")
    routes = rows.groupBy("bundle", "kind", "source", "source_handle", "target", "target_handle").agg(first, F.count("*").alias("members"))
    routes = routes.join(facts.groupBy("bundle").agg(F.count("*").alias("facts")), "bundle", "left").join(missing, "bundle", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    routes = routes.select(F.col("bundle").alias("id"), "kind", "source", "source_handle", "target", "target_handle", "least.edge_id", "least.importing_file", "least.supplying_file", "members", zero("facts"), zero("unloaded"))
    return Bundles(routes, rows.select("bundle", F.col("id").alias("line")), facts)


def row_windows(rows: DataFrame, first: int, last: int) -> DataFrame:
    """(card, file, place) of rows(card, file, at): the rows of each card from place first to last, exclusive, are visible, the others above or below."""
    place = F.when(F.col("at") < first, "above").when(F.col("at") < last, "visible").otherwise("below")
    return rows.select("card", "file", place.alias("place"))


def connected_handles(windows: DataFrame, connected: DataFrame) -> DataFrame:
    """(card, handle): the visible rows of windows that are in connected(file), and one handle for all those above or below."""
    handle = F.when(F.col("place") == "above", ABOVE).when(F.col("place") == "below", BELOW).otherwise(F.col("file"))
    return windows.join(connected.select("file").distinct(), "file", "left_semi").select("card", handle.alias("handle")).distinct()


def reveal(graph: CodeGraph, node_id: str) -> DataFrame:
    """(id, kind, part): what must be open for a node to show, part of packages or files, and under kinds its own if it is a declaration."""
    node = graph.nodes.where(F.col("id") == node_id).select("id", "kind")
    above = ancestors(graph, node.select("id")).where(F.col("id") != node_id)
    held = graph.nodes.join(above, "id", "left_semi").where("kind in ('PACKAGE', 'FILE')").select("id", "kind", F.when(F.col("kind") == "FILE", "files").otherwise("packages").alias("part"))
    return held.union(node.where(is_declaration(F.col("kind"))).select("id", "kind", F.lit("kinds")))


def explorer_tree(graph: CodeGraph, visible: VisibleGraph) -> DataFrame:
    """(id, parent, section): each visible node below its parent if that shows, else in the section that its labels name; others are left out."""
    shown = visible.nodes.select("id")
    rows = shown.join(parents(graph).withColumnRenamed("child", "id"), "id", "left").join(shown.select(F.col("id").alias("parent"), F.lit(True).alias("inside")), "parent", "left")
    rows = rows.join(present(graph).select("id", "explorer_section"), "id")
    under = F.when(F.col("inside"), F.col("parent"))
    return rows.select("id", under.alias("parent"), F.when(under.isNull(), F.col("explorer_section")).alias("section")).where("parent is not null or section is not null")


def explorer_roots(graph: CodeGraph) -> DataFrame:
    """(id): packages that lie in no package, and files in nothing."""
    up = graph.nodes.where("kind = 'PACKAGE'").select(F.col("id").alias("parent"), F.lit(True).alias("nested"))
    rows = graph.nodes.select("id", "kind").join(parents(graph).withColumnRenamed("child", "id"), "id", "left").join(up, "parent", "left")
    return rows.where("(kind = 'PACKAGE' and nested is null) or (kind = 'FILE' and parent is null)").select("id").distinct()


def flatten_explorer(graph: CodeGraph, roots: DataFrame, expanded: DataFrame, kinds: tuple[str, ...] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(id, depth, sort_path, more): the tree below roots(id) in pre-order, descending only into expanded(id); siblings by path and id.

    kinds are the declarations listed (all by default). pages(id, next, total) tells how many
    children of a node are loaded: an expanded node with more has a row behind them, of its id
    and with how many are missing in `more`; other rows have none there.
    """
    listed = graph.nodes if kinds is None else graph.nodes.where(~is_declaration(F.col("kind")) | F.col("kind").isin(*kinds))
    key = listed.select(F.col("id").alias("child"), F.concat_ws("\x01", "path", "id").alias("key"))
    pair = parents(graph)
    opened_ids = expanded.select("id").distinct()
    level = cut(roots.select(F.col("id").alias("child")).distinct().join(key, "child").select(F.col("child").alias("id"), F.lit(0).alias("depth"), F.array("key").alias("sort_path")))
    out = level
    while True:
        opened = level.join(opened_ids, "id", "left_semi").select(F.col("id").alias("parent"), F.col("depth").alias("d"), F.col("sort_path").alias("sp"))
        level = opened.join(pair, "parent").join(key, "child").select(F.col("child").alias("id"), (F.col("d") + 1).alias("depth"), F.concat("sp", F.array("key")).alias("sort_path"))
        level = cut(level)
        if level.isEmpty():
            break
        out = out.union(level)
    none = F.lit(None).cast("long")
    rows = out.withColumn("more", none)
    if pages is not None:
        missing = out.join(opened_ids, "id", "left_semi").join(pages.where("next < total"), "id")
        behind = F.concat("sort_path", F.array(F.lit("\U0010ffff")))  # sorts behind all children
        rows = rows.union(missing.select("id", F.col("depth") + 1, behind, (F.col("total") - F.col("next")).cast("long")))
    return rows.orderBy("sort_path")


def neighborhood_graph(near: Neighborhood, projection: Projection, scope: str) -> VisibleGraph:
    """A neighbourhood as a visible graph: each edge stands for the facts behind it in package scope, else for itself."""
    none = F.lit(None).cast("string")
    nodes = near.graph.nodes.select("*", none.alias("parent_id"), F.lit(0).cast("long").alias("child_count"), F.lit(False).alias("expanded"))
    key = fact_key(F.col("kind"), F.col("from_id"), F.col("to_id"))
    edges = near.graph.edges.select(key.alias("id"), "kind", F.col("from_id").alias("source"), F.col("to_id").alias("target"), (key if scope == "package" else none).alias("projected"), F.lit(None).cast("long").alias("supporting_count"))
    own = near.graph.edges.select(key.alias("edge_id"), "kind", "from_id", "to_id")
    if scope == "package":
        facts = projection.support.join(near.graph.edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_semi")
        facts = facts.select(fact_key(F.lit("IMPORTS"), F.col("from_id"), F.col("to_id")).alias("edge_id"), F.col("source_kind").alias("kind"), F.col("source_from").alias("from_id"), F.col("source_to").alias("to_id"))
        own = facts.union(own.join(facts.select("edge_id").distinct(), "edge_id", "left_anti"))
    return VisibleGraph(nodes, edges, own)


def merge_graphs(batches: list[CodeGraph]) -> CodeGraph:
    """Nodes of all batches, the last one's where several have them, and the edges of all."""
    edges = reduce(DataFrame.union, (g.edges.select(EDGE_COLUMNS) for g in batches))
    return CodeGraph(merge_nodes([g.nodes for g in batches]), edges.distinct())


def merge_projections(batches: list[Projection]) -> Projection:
    """The projections of parts of a graph as one: their edges and all that supports them."""
    return Projection(merge_graphs([p.graph for p in batches]), reduce(DataFrame.unionByName, (p.support for p in batches)).distinct())


def merge_nodes(batches: list[DataFrame]) -> DataFrame:
    """Nodes of all batches, keyed by id; the last batch that has a node wins."""
    rows = None
    for k, batch in enumerate(batches):
        part = batch.select(F.lit(k).alias("batch"), *batch.columns)
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c not in ("batch", "id")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "batch").alias("n")).select("id", "n.*")


#: A row's height, rows shown before the first visible one, and rows of a window.
ROW_HEIGHT, ROWS_BEFORE, WINDOW_ROWS = 30, 2, 24


def explorer_window(rows: DataFrame, height: int = ROW_HEIGHT) -> DataFrame:
    """rows(row_count, scroll_top, ..) with first and last of the rows to draw, and the space before and after them."""
    n = F.col("row_count")
    first = F.least(F.greatest(n - 1, F.lit(0)), F.greatest(F.floor(F.col("scroll_top") / height) - ROWS_BEFORE, F.lit(0)))
    out = rows.withColumn("first", first).withColumn("last", F.least(n, F.col("first") + WINDOW_ROWS))
    return out.withColumns({"before": F.col("first") * height, "after": F.greatest(n - F.col("last"), F.lit(0)) * height})
