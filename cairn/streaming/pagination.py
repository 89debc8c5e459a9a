"""The state of paged lists from their events: as a fold of a table, and as a stateful stream.

An event is (id, action, next, total, at): start and settled of a request, collapse and expand of
a node, and loaded, which brings the cursor (next, total). A node's state is its last cursor,
whether a request is pending and whether it is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "next long, total long, pending boolean, expanded boolean"
#: What each action makes of pending and expanded; None leaves it.
EFFECTS = {"start": (True, None), "settled": (False, None), "collapse": (False, False), "expand": (None, True), "loaded": (False, True)}


def paged(events: DataFrame) -> DataFrame:
    """(id, next, total, pending, expanded): the state of every id after all its events in the order of `at`.

    Each part of the state is what the last event that sets it says, so one aggregation folds them
    with partial results; no id's events are gathered. Ties of `at` go to the greater action name.
    """
    order = F.struct("at", "action")
    last = lambda value, when: F.max_by(value, F.when(when, order))
    of = lambda k: F.when(F.col("action").isin(*(a for a, e in EFFECTS.items() if e[k])), True).otherwise(False)
    sets = lambda k: F.col("action").isin(*(a for a, e in EFFECTS.items() if e[k] is not None))
    state = [last(c, F.col("action") == "loaded").alias(c) for c in ("next", "total")]
    state += [F.coalesce(last(of(k), sets(k)), F.lit(False)).alias(name) for k, name in enumerate(("pending", "expanded"))]
    return events.where(F.col("action").isin(*EFFECTS)).groupBy("id").agg(*state)


class Pagination(StatefulProcessor):
    """One value of state for each id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("page", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        page = self.state.get() if self.state.exists() else (None, None, False, False)
        after, total, pending, expanded = page
        for frame in rows:
            for row in frame.sort_values(["at", "action"]).itertuples():
                if row.action not in EFFECTS:
                    continue
                waits, opens = EFFECTS[row.action]
                pending = pending if waits is None else waits
                expanded = expanded if opens is None else opens
                if row.action == "loaded":
                    after, total = int(row.next), int(row.total)
        self.state.update((after, total, pending, expanded))
        yield pd.DataFrame({"id": [key[0]], "next": pd.array([after], "Int64"), "total": pd.array([total], "Int64"), "pending": [pending], "expanded": [expanded]})

    def close(self) -> None:
        pass


def paged_stream(events: DataFrame) -> DataFrame:
    """The same from a stream, for every id that a batch of events names (update mode).

    Events of an id must arrive in the order of `at` from batch to batch; within a batch they are
    sorted. State is one row an id, in the state store (RocksDB).
    """
    return events.groupBy("id").transformWithStateInPandas(Pagination(), outputStructType="id string, " + STATE, outputMode="Update", timeMode="None")
