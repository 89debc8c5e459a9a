"""Schemas and closed vocabularies of the code graph."""

from __future__ import annotations

NODES = "id string, kind string, path string, name string, language string, import_count int, export_count int"
EDGES = "kind string, from_id string, to_id string"
EDGE = "struct<kind:string,from_id:string,to_id:string>"
EVIDENCE = f"edge {EDGE}, path string, line int, column int, end_line int, end_column int, snippet string, truncated boolean, hash string"
ISSUES = "kind string, path string, import_path string, reason string"
EXCLUSIONS = "path string, reason string"
COUNTERS = (
    "files_discovered", "supported_source_files", "files_analyzed", "files_skipped", "files_failed", "imports_discovered",
    "internal_resolved", "standard_library", "external", "unresolved", "cgo", "unclassified",
)
SNAPSHOTS = "id string, root string, created_at string, created_ts timestamp, status string, " + ", ".join(f"{c} int" for c in COUNTERS)

# Kinds, roles and suffixes that results must carry as they are.
DECLARATIONS = ("FUNCTION", "CLASS", "METHOD", "STRUCT", "INTERFACE", "TYPE", "VARIABLE", "CONSTANT", "ENUM")
NODE_KINDS = ("MODULE", "PACKAGE", "FILE", *DECLARATIONS)
EDGE_KINDS = ("CONTAINS", "IMPORTS", "USES_EXPORT")
ROLE_DECLARATIONS = {
    "go": ("FUNCTION", "METHOD", "STRUCT", "INTERFACE", "TYPE", "VARIABLE", "CONSTANT"),
    "typescript": ("FUNCTION", "CLASS", "METHOD", "INTERFACE", "TYPE", "VARIABLE", "ENUM"),
    "javascript": ("FUNCTION", "CLASS", "METHOD", "INTERFACE", "TYPE", "VARIABLE", "ENUM"),
    "python": ("FUNCTION", "CLASS", "METHOD"),
}
ROLES = {
    "go": {"MODULE": "ROOT", "PACKAGE": "CONTAINER", "FILE": "SOURCE"},
    "typescript": {"FILE": "SOURCE"},
    "javascript": {"FILE": "SOURCE"},
    "python": {"PACKAGE": "CONTAINER", "FILE": "SOURCE"},
}
LEGAL_CONTAINMENT = (("MODULE", "PACKAGE"), ("PACKAGE", "FILE"), ("PACKAGE", "PACKAGE"), *(("FILE", d) for d in DECLARATIONS))
STATUSES = ("complete", "completed_with_gaps")
TSJS_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
UNSUPPORTED_SUFFIXES = (".rs", ".java", ".rb", ".c", ".cpp", ".cs", ".php", ".swift", ".kt")
SKIPPED_DIRECTORIES = (".git", ".hg", ".svn", ".next", "bin", "build", "dist", "node_modules", "vendor")
PAGE = 20


class GraphError(ValueError):
    """A refused request or an invalid graph; code names the kind of failure."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
