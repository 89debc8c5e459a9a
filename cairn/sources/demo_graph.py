"""A code graph read out of the star-schema tables.

Regions are modules, nations packages, customers and suppliers files, orders declarations.
A customer's file imports the packages (style "G") or the files (style "P") of the suppliers
of its order lines; each line is one occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each import occurrence: from_id, supplier, nation and the order line's columns."""
    line, orders, supplier = tables(spark, sf_dir, "lineitem", "orders", "supplier")
    rows = line.join(orders.select("o_orderkey", "o_custkey"), line.l_orderkey == F.col("o_orderkey")).join(supplier.select("s_suppkey", "s_nationkey"), line.l_suppkey == F.col("s_suppkey"))
    return rows.withColumns({"from_id": F.format_string("file:c%d", "o_custkey"), "package": F.format_string("package:%d", "s_nationkey"), "provider": F.format_string("file:s%d", "s_suppkey")})


def demo_nodes(spark: SparkSession, sf_dir: str, style: str = "G") -> DataFrame:
    region, nation, customer, supplier, orders = tables(spark, sf_dir, "region", "nation", "customer", "supplier", "orders")
    language = "python" if style == "P" else "go"
    none = F.lit(None).cast("int")

    def node(rows, node_id, kind, path, name, count=none):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select(node_id.alias("id"), kind.alias("kind"), path.alias("path"), name.alias("name"), F.lit(language).alias("language"), count.alias("import_count"), none.alias("export_count"))

    counts = occurrences(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"))
    n = nation.select("n_nationkey", "n_name")
    files = customer.join(n, customer.c_nationkey == n.n_nationkey).join(counts, customer.c_custkey == counts.o_custkey, "left")
    path = F.concat_ws("/", "n_name", "c_name")
    status = F.when(F.col("o_orderstatus") == "F", "FUNCTION").when(F.col("o_orderstatus") == "O", "METHOD").otherwise("STRUCT")
    declared = orders.join(files.select("c_custkey", "n_name", "c_name"), orders.o_custkey == F.col("c_custkey"))
    s = supplier.join(n, supplier.s_nationkey == n.n_nationkey)
    parts = [
        node(region, F.format_string("module:%d", "r_regionkey"), "MODULE", F.col("r_name"), F.col("r_name")),
        node(nation, F.format_string("package:%d", "n_nationkey"), "PACKAGE", F.col("n_name"), F.col("n_name")),
        node(files, F.format_string("file:c%d", "c_custkey"), "FILE", path, F.col("c_name"), F.col("n")),
        node(s, F.format_string("file:s%d", "s_suppkey"), "FILE", F.concat_ws("/", "n_name", "s_name"), F.col("s_name")),
        node(declared, F.format_string("function:o%d", "o_orderkey"), status, path, F.format_string("order%d", "o_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(NODE_COLUMNS)


def demo_edges(spark: SparkSession, sf_dir: str, style: str = "G") -> DataFrame:
    nation, customer, supplier, orders = tables(spark, sf_dir, "nation", "customer", "supplier", "orders")
    rows = occurrences(spark, sf_dir)

    def edge(frame, kind, a, b):
        return frame.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"))

    fmt = F.format_string
    held = edge(nation, "CONTAINS", fmt("module:%d", "n_regionkey"), fmt("package:%d", "n_nationkey"))
    held = held.union(edge(customer, "CONTAINS", fmt("package:%d", "c_nationkey"), fmt("file:c%d", "c_custkey")))
    held = held.union(edge(supplier, "CONTAINS", fmt("package:%d", "s_nationkey"), fmt("file:s%d", "s_suppkey")))
    held = held.union(edge(orders, "CONTAINS", fmt("file:c%d", "o_custkey"), fmt("function:o%d", "o_orderkey")))
    # distinct by numbers, before they are written out
    file, supplier = fmt("file:c%d", "o_custkey"), rows.select("o_custkey", "s_suppkey").distinct()
    uses = edge(supplier, "USES_EXPORT", file, fmt("file:s%d", "s_suppkey"))
    if style == "G":
        uses = uses.union(edge(rows.select("o_custkey", "s_nationkey").distinct(), "IMPORTS", file, fmt("package:%d", "s_nationkey")))
    else:
        uses = uses.union(edge(supplier, "IMPORTS", file, fmt("file:s%d", "s_suppkey")))
    return held.union(uses).select(EDGE_COLUMNS)


def demo_graph(spark: SparkSession, sf_dir: str, style: str = "G") -> CodeGraph:
    return CodeGraph(demo_nodes(spark, sf_dir, style), demo_edges(spark, sf_dir, style))


def demo_evidence(spark: SparkSession, sf_dir: str, style: str = "G") -> DataFrame:
    """One occurrence for each order line: edge, path, line, column and snippet; all its numbers break ties."""
    nation, customer = tables(spark, sf_dir, "nation", "customer")
    path = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.concat_ws("/", "n_name", "c_name").alias("path"))
    rows = occurrences(spark, sf_dir).join(path, F.col("o_custkey") == F.col("c_custkey"))
    edge = F.struct(F.lit("IMPORTS").alias("kind"), "from_id", F.col("package" if style == "G" else "provider").alias("to_id"))
    return rows.select(edge.alias("edge"), "path", F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("int").alias("column"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("snippet"), F.col("l_orderkey").alias("tie"), F.col("l_quantity").alias("tie2"), F.col("l_extendedprice").alias("tie3"))


def part_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Parts as files; a part imports the one on the next line of an order."""
    line, part = tables(spark, sf_dir, "lineitem", "part")
    name = F.format_string("file:p%d", "p_partkey")
    none = F.lit(None).cast("int")
    nodes = part.select(name.alias("id"), F.lit("FILE").alias("kind"), F.col("p_name").alias("path"), F.col("p_name").alias("name"), F.lit("python").alias("language"), none.alias("import_count"), none.alias("export_count"))
    own = line.select("l_orderkey", "l_linenumber", F.format_string("file:p%d", "l_partkey").alias("from_id"))
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.format_string("file:p%d", "l_partkey").alias("to_id"))
    edges = own.join(after, ["l_orderkey", "l_linenumber"]).select(F.lit("IMPORTS").alias("kind"), "from_id", "to_id").distinct()
    return CodeGraph(nodes, edges)
