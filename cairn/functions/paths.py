"""Path rules and classification: ignore patterns, languages, package names, ladders, coverage and issues."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.schema import TSJS_SUFFIXES, UNSUPPORTED_SUFFIXES, GraphError
from cairn.session import cut

# POSIX classes and their names in Java's patterns.
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


@dataclass(frozen=True)
class Rule:
    """An ignore rule: its line, source text, whether it clears, holds for directories only, and its Java pattern."""

    line: int
    text: str
    negated: bool
    directory: bool
    pattern: str


def _class(body: str, where: str) -> str:
    """A bracket expression's body as a Java class that never matches a separator."""
    negated = body[:1] in ("!", "^")
    body = body[1:] if negated else body
    out, i = "", 0
    while i < len(body):
        if body.startswith("[:", i):
            end = body.find(":]", i)
            name = body[i + 2 : end] if end > 0 else ""
            if name not in POSIX:
                raise GraphError("invalid_pattern", f"{where}: unknown class [:{name}:]")
            out, i = out + "\\p{" + POSIX[name] + "}", end + 2
            continue
        if body[i] == "\\":
            i += 1
        c = body[i : i + 1]
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            d = body[i + 2 :][:1]
            if d < c:
                raise GraphError("invalid_pattern", f"{where}: reversed range")
            out, i = out + f"{re.escape(c)}-{re.escape(d)}", i + 3
        else:
            out, i = out + ("\\" + c if not c.isalnum() else c), i + 1
    return f"[^/{out}]" if negated else f"(?!/)[{out}]"


def glob_pattern(glob: str, anchored: bool, where: str = "pattern") -> str:
    """A Java pattern for a whole relative path: `*`, `?` and classes stay in one element, `**` crosses elements."""
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(glob):
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/"):
            if glob.startswith("**/", i):
                out, i = out + "(?:[^/]+/)*", i + 3
                continue
            if i + 2 == len(glob):
                out, i = out + "(?s:.*)", i + 2
                continue
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            start = i + 1 + (glob[i + 1 : i + 2] in ("!", "^"))
            end = start + (glob[start : start + 1] == "]")
            while end < len(glob) and glob[end] != "]":
                end = glob.find(":]", end) + 2 if glob.startswith("[:", end) and ":]" in glob[end:] else end + 1 + (glob[end] == "\\")
            if end >= len(glob) or "/" in glob[i:end]:  # elements are split before classes are read
                raise GraphError("invalid_pattern", f"{where}: unclosed class")
            out, i = out + _class(glob[i + 1 : end], where), end
        elif c == "\\":
            if i + 1 == len(glob):
                raise GraphError("invalid_pattern", f"{where}: trailing backslash")
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return rf"\A{out}\z"


def parse_ignore(content: str, name: str = "ignore file") -> list[Rule]:
    """Rules in order. Later rules win; `!` clears; a slash at the front or inside anchors; one at the end means directories."""
    rules = []
    for number, line in enumerate(content.removeprefix("﻿").split("\n"), 1):
        line = line.removesuffix("\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        text = line
        negated = line.startswith("!")
        line = line[1:] if negated else line
        directory = line.endswith("/")
        line = line.rstrip("/") if directory else line
        anchored = "/" in line
        line = line.removeprefix("/")
        where = f"{name}:{number}"
        if not line:
            raise GraphError("invalid_pattern", f"{where}: empty pattern")
        rules.append(Rule(number, text, negated, directory, glob_pattern(line, anchored, where)))
    return rules


def ignore_matches(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """entries(path, and dir if there) with line and pattern of the rule that excludes each, null where none does.

    The rules are one file's, so they are one expression: later ones stand outside.
    """
    is_dir = F.col("dir") if "dir" in entries.columns else F.lit(False)
    line = F.lit(None).cast("int")
    for r in rules:
        hit = F.col("path").rlike(r.pattern)
        line = F.when(hit & is_dir if r.directory else hit, F.lit(None).cast("int") if r.negated else F.lit(r.line)).otherwise(line)
    texts = F.create_map(*(x for r in rules for x in (F.lit(r.line), F.lit(r.text)))) if rules else None
    out = entries.withColumn("line", line)
    return out.withColumn("pattern", texts[F.col("line")] if rules else F.lit(None).cast("string"))


def suffix_of(path: Column) -> Column:
    """The last element's part from its last dot on; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def language_of(path: Column) -> Column:
    """go, python, typescript or javascript by suffix; `unsupported` for known others (any case); else null."""
    suffix = suffix_of(path)
    return (
        F.when(suffix == ".go", "go")
        .when(suffix == ".py", "python")
        .when(suffix.isin(*TSJS_SUFFIXES[:4]), "typescript")
        .when(suffix.isin(*TSJS_SUFFIXES[4:]), "javascript")
        .when(F.lower(suffix).isin(*UNSUPPORTED_SUFFIXES), "unsupported")
    )


def package_name(spec: Column) -> Column:
    """A specifier's package: its first element, or the first two of a scoped one."""
    return F.regexp_extract(spec, r"\A(@[^/]+/[^/]+|[^/]+)", 1)


def ladder(rungs: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rung that holds."""
    out = F.lit(otherwise)
    for name, holds in reversed(rungs):
        out = F.when(holds, name).otherwise(out)
    return out


def coverage(rows: DataFrame, key: str, classes: tuple[str, ...], gap: str = "unresolved") -> DataFrame:
    """Counters of rows(class) by key, with the status that follows from gaps."""
    counted = rows.groupBy(key).agg(F.count("*").alias("imports_discovered"), *(F.count_if(F.col("class") == c).alias(c) for c in classes))
    return counted.withColumn("status", F.when(F.col(gap) > 0, "completed_with_gaps").otherwise("complete"))


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with `place`, from 0 within each key in the given order.

    The rows are sorted by ranges; a key that spans several ranges counts on from the ranges
    before, of which there is one row each. No key is gathered in one task.
    """
    at = F.shiftright("at", 33).alias("range")  # the partition's number stands above the row's
    placed = cut(rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(*key, at).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*(key or [F.lit(0)])).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    out = placed.withColumn("range", at).alias("p").join(ranges.alias("r"), [F.col("p.range") == F.col("r.range"), *same])
    return out.select(*(f"p.{c}" for c in rows.columns), (F.col("p.at") - F.col("r.first") + F.col("r.ahead")).alias("place"))


def issue_ordinals(sources: list[DataFrame], key: tuple[str, ...] | list[str] = ("kind",)) -> DataFrame:
    """All issues with their ordinal within the key (without one, over all), by kind, path, import and reason."""
    order = [c for c in ("kind", "path", "import_path", "reason") if c not in key]
    rows = numbered(reduce(DataFrame.unionByName, sources), list(key), order)
    return rows.withColumn("ordinal", F.col("place").cast("int")).drop("place")
