"""Opt-in measurement of operators: calls, time and rows by name, without further jobs."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Probe:
    """Times of calls, and rows that pass observed frames; a probe that is off changes nothing."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.spent, self.seen = enabled, {}, []

    @contextmanager
    def timed(self, name: str):
        """Count one call of an operation and its time, whether it succeeds or not."""
        began = time.perf_counter()
        try:
            yield
        finally:
            if self.enabled:
                self.spent.setdefault(name, []).append(1000 * (time.perf_counter() - began))

    def call(self, name: str, operation: Callable, *arguments, **named):
        with self.timed(name):
            return operation(*arguments, **named)

    def rows(self, name: str, df: DataFrame) -> DataFrame:
        """The same rows, counted by the action that computes them."""
        if not self.enabled:
            return df
        seen = Observation()
        self.seen.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def reset(self) -> None:
        self.spent, self.seen = {}, []

    def report(self, spark: SparkSession) -> DataFrame:
        """(name, calls, total_ms, most_ms, rows); rows are of observed frames whose action has run, and null without one."""
        rows = {}
        for name, seen in self.seen:
            if (n := seen.get["n"] if seen._jo.future().isCompleted() else None) is not None:
                rows[name] = rows.get(name, 0) + n
        names = sorted({*self.spent, *rows})
        told = [(n, len(self.spent.get(n, [])), float(sum(self.spent.get(n, []))), float(max(self.spent.get(n, [0]))), rows.get(n)) for n in names]
        return spark.createDataFrame(told, "name string, calls int, total_ms double, most_ms double, rows long")
