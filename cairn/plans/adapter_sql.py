"""The star-schema graph of sources.demo_graph as common table expressions, for the oracle SQL."""

from __future__ import annotations


def adapter(style: str = "G") -> str:
    """CTEs occ, nodes, edges, parents, imports, support and pedges (without WITH)."""
    target = "'package:' || s_nationkey" if style == "G" else "'file:s' || s_suppkey"
    language = "go" if style == "G" else "python"
    return f"""
occ AS (SELECT l.*, o_custkey, s_suppkey, s_nationkey, 'file:c' || o_custkey AS from_id, 'package:' || s_nationkey AS package, 'file:s' || s_suppkey AS provider, {target} AS target
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
counts AS (SELECT o_custkey AS ck, CAST(count(*) AS INTEGER) AS n FROM occ GROUP BY 1),
nodes AS (
  SELECT 'module:' || r_regionkey AS id, 'MODULE' AS kind, r_name AS path, r_name AS name, '{language}' AS language, CAST(NULL AS INTEGER) AS import_count, CAST(NULL AS INTEGER) AS export_count FROM region
  UNION ALL SELECT 'package:' || n_nationkey, 'PACKAGE', n_name, n_name, '{language}', NULL, NULL FROM nation
  UNION ALL SELECT 'file:c' || c_custkey, 'FILE', n_name || '/' || c_name, c_name, '{language}', n, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN counts ON ck = c_custkey
  UNION ALL SELECT 'file:s' || s_suppkey, 'FILE', n_name || '/' || s_name, s_name, '{language}', NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'function:o' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'METHOD' ELSE 'STRUCT' END, n_name || '/' || c_name, 'order' || o_orderkey, '{language}', NULL, NULL
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT 'CONTAINS' AS kind, 'module:' || n_regionkey AS from_id, 'package:' || n_nationkey AS to_id FROM nation
  UNION ALL SELECT 'CONTAINS', 'package:' || c_nationkey, 'file:c' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'package:' || s_nationkey, 'file:s' || s_suppkey FROM supplier
  UNION ALL SELECT 'CONTAINS', 'file:c' || o_custkey, 'function:o' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'IMPORTS', from_id, target FROM occ
  UNION ALL SELECT DISTINCT 'USES_EXPORT', from_id, provider FROM occ),
parents AS (SELECT DISTINCT to_id AS child, from_id AS parent FROM edges WHERE kind = 'CONTAINS'),
imports AS (SELECT * FROM edges WHERE kind = 'IMPORTS'),
owner AS (SELECT child AS file, parent AS package FROM parents JOIN nodes f ON f.id = child AND f.kind = 'FILE' JOIN nodes p ON p.id = parent AND p.kind = 'PACKAGE'),
targets AS (SELECT id, id AS package FROM nodes WHERE kind = 'PACKAGE' UNION ALL SELECT file, package FROM owner WHERE '{language}' = 'python'),
support AS (SELECT DISTINCT o.package AS from_id, t.package AS to_id, i.kind AS source_kind, i.from_id AS source_from, i.to_id AS source_to FROM imports i JOIN owner o ON o.file = i.from_id JOIN targets t ON t.id = i.to_id),
pedges AS (SELECT DISTINCT 'IMPORTS' AS kind, from_id, to_id FROM support)"""


def query(body: str, style: str = "G") -> str:
    return f"WITH RECURSIVE {adapter(style).strip()}{', ' + body.strip() if body.lstrip().split(None, 1)[0].lower() != 'select' else ' ' + body.strip()}"
