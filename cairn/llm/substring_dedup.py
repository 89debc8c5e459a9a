"""Removal of long passages repeated across documents, by prefix-partitioned suffix trees.

A suffix starts at a word; its first `window` words (50) decide, so trees are cut off at that
depth. Suffixes are split among groups by variable-length prefixes: twenty words at first,
forty and then fifty wherever a prefix has more suffixes than a task should hold. A group's
suffixes are sorted by the fingerprints of their steps (20, 20 and 10 words); the longest
common prefixes of neighbours, in words at the steps' ends, give the subtree's internal nodes.
A node at depth `window` is a repeat, and every leaf below it that is not in its first document
marks a window to remove; windows that follow each other make up one maximal passage. A prefix
that is still oversized at full depth is one node and needs only the least document of its
suffixes.

Only suffixes that can repeat are made. Every window has an anchor, the least fingerprint of
its 20-word runs; equal windows have equal anchors, so windows whose anchor is in one document
alone are left out. Documents with one and the same word sequence are one unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import U, cut, map_text, mix, table, text_bytes, windows_of, word_hashes, word_spans

#: Words of a window, of an anchor, and of the steps in which prefixes grow to a window.
WINDOW, ANCHOR, STEPS = 50, 20, (20, 20, 10)
#: Suffixes that a subtree's task should hold (about 60 bytes each).
GROUP_ROWS = 100_000
TASK_ROWS = 1_000_000
#: Numbers that a broadcast side may hold (16 MB); with more, texts are shuffled to the join.
BROADCAST_NUMBERS = 2_000_000


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _units(text: pa.Array):
    """(first word of each text, fingerprints of words, anchors of windows, sequence ids)."""
    raw, offsets = text_bytes(text)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    anchors = _least_of(windows_of(words, ANCHOR), WINDOW - ANCHOR + 1) if len(words) >= WINDOW else np.zeros(0, np.uint64)
    # the id of a sequence: words weighted by odd powers of their place, summed
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    weighted = mix(words + mix(place.astype(np.uint64) + U(1)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted)])
    sid = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * U(0x9FB21C651E98DF25))
    return first, words, anchors, sid


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _profile(batch):
    first, _, anchors, sid = _units(batch.column("text"))
    own = [np.unique(anchors[a : max(a, b - WINDOW + 1)]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), _longs(sid), pa.array(own, pa.list_(pa.int64()))],
        names=["doc_id", "n_words", "sid", "anchors"],
    )


def _suffixes(batch):
    """Rows (sid, d, s, c0..): the windows that have one of the given anchors, as fingerprints of their steps."""
    first, words, anchors, sid = _units(batch.column("text"))
    steps = [windows_of(words, n) for n in STEPS]
    before = np.cumsum(STEPS) - STEPS
    wanted = batch.column("sid").to_pylist()
    ids = batch.column("doc_id").to_pylist()
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b - a < WINDOW or sid[i].view(np.int64) != wanted[i]:
            continue
        shared = np.asarray(batch.column("shared")[i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
        at = np.flatnonzero(np.isin(anchors[a : b - WINDOW + 1], shared))
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), wanted[i]), pa.int64()), pa.array(np.full(len(at), ids[i]), pa.int64()), pa.array(at, pa.int32()), *(_longs(x[a + at + n]) for x, n in zip(steps, before))],
                names=["sid", "d", "s", *(f"c{k}" for k in range(len(STEPS)))],
            )


def internal_nodes(lcp: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, first leaves, ends) of a subtree's internal nodes, by depth, from the longest common prefixes of neighbouring leaves.

    A node at a depth is a longest run of leaves whose neighbours share at least so much, if
    two of them share no more.
    """
    out = []
    for depth in np.unique(lcp[lcp > 0]).tolist():
        inside = np.concatenate([[False], lcp >= depth, [False]]).astype(np.int8)
        begin, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1) + 1
        exact = np.concatenate([[0], np.cumsum(lcp == depth)])
        own = exact[end - 1] > exact[begin]
        out.append((depth, begin[own], end[own]))
    return out


def _subtrees(group: pa.Table) -> pa.Table:
    """The windows of one group below a deep node whose first document is another one."""
    labels = [group.column(f"c{k}").to_numpy() for k in range(len(STEPS))]
    order = np.lexsort(labels[::-1])
    lcp, common = np.zeros(max(0, len(order) - 1), np.int64), np.ones(max(0, len(order) - 1), bool)
    for label, words in zip(labels, STEPS):
        common &= label[order[1:]] == label[order[:-1]]
        lcp[common] += words
    d = group.column("d").to_numpy()[order]
    late = [np.zeros(0, np.int64)]
    for depth, begin, end in internal_nodes(lcp):
        if depth >= WINDOW:
            own = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(int((end - begin).sum()))  # the leaves of all nodes
            least = np.minimum.reduceat(d[own], np.cumsum(end - begin) - (end - begin)) if len(begin) else np.zeros(0, np.int64)
            late.append(own[d[own] > np.repeat(least, end - begin)])
    late = order[np.concatenate(late)]
    return pa.table({"sid": group.column("sid").to_numpy()[late], "s": group.column("s").to_numpy()[late].astype(np.int32)})


def _repeated_windows(suffixes: DataFrame) -> DataFrame:
    """(sid, s) of the windows that also start in a unit of a smaller document."""
    spark = suffixes.sparkSession
    depth = len(STEPS)
    rest, ready, n = suffixes.withColumn("prefix", F.xxhash64("c0")), [], suffixes.count()
    for k in range(1, depth + 1):
        large = cut(rest.groupBy("prefix").agg(F.count("*").alias("k"), F.min("d").alias("least")).where(F.col("k") > GROUP_ROWS))
        many = large.count()
        if not many:
            ready.append(rest)
            rest = None
            break
        # a prefix with over GROUP_ROWS suffixes: at most one for every GROUP_ROWS rows
        large = F.broadcast(large) if 3 * many <= BROADCAST_NUMBERS else large
        ready.append(rest.join(large, "prefix", "left_anti"))
        rest = rest.join(large, "prefix")
        if k < depth:
            rest = rest.drop("k", "least").withColumn("prefix", F.xxhash64("prefix", f"c{k}"))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * n // GROUP_ROWS))
    trees = ready[0]
    for more in ready[1:]:
        trees = trees.unionByName(more)
    # a task gets about TASK_ROWS suffixes, whatever their number
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    trees = trees.withColumn("part", F.pmod("prefix", F.lit(groups))).repartition(tasks, "part").groupBy("part").applyInArrow(_subtrees, "sid long, s int")
    if rest is not None:  # oversized at full depth: one node each
        trees = trees.union(rest.where("d > least").select("sid", "s"))
    return trees


def _apply(batch, as_is):
    """The rows with their words that stay, joined by one space, and the numbers of words; with as_is, texts that lose none unchanged."""
    raw, offsets = text_bytes(batch.column("text"))
    starts, ends, first = word_spans(raw, offsets)
    gone = np.zeros(len(starts) + 1, np.int64)
    plans = batch.column("plan")
    touched = np.flatnonzero(plans.is_valid().to_numpy(zero_copy_only=False))
    if len(touched):
        sid = _units(batch.column("text"))[3].view(np.int64)
        for i in touched:
            for p in plans[int(i)].as_py():
                if p["sid"] == sid[i] and first[i + 1] > first[i]:
                    for r in p["runs"]:  # of window starts
                        gone[first[i] + r["a"]] += 1
                        gone[first[i] + r["b"] + WINDOW] -= 1
    stays = np.cumsum(gone)[:-1] == 0
    kept = np.zeros(len(raw) + 1, np.int64)
    np.add.at(kept, starts[stays], 1)
    np.add.at(kept, ends[stays], -1)
    keep = np.cumsum(kept)[:-1] > 0
    # one space behind each kept word but the last of its text: the byte behind an inner word is white space
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))[stays]
    inner = np.flatnonzero(stays)[np.flatnonzero(own[1:] == own[:-1])] if len(own) else np.zeros(0, np.int64)
    out = raw.copy()
    out[ends[inner]] = 0x20
    keep[ends[inner]] = True
    removed = np.concatenate([np.zeros(1, np.int64), np.cumsum(~stays)])
    lost = np.diff(removed[first])
    if as_is:
        same = np.repeat(lost == 0, np.diff(offsets))
        out[same] = raw[same]
        keep |= same
    size = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[offsets]
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(size.tobytes()), pa.py_buffer(out[keep].tobytes()))
    rest = [c for c in batch.schema.names if c not in ("text", "plan")]
    yield pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in rest), text.cast(pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(lost, pa.int64())],
        names=[*rest, "kept_text", "n_words", "n_removed"],
    )


def _small(side: DataFrame, numbers) -> DataFrame:
    """The side, to be broadcast if its rows hold few enough numbers."""
    total = side.agg(F.sum(numbers + 2)).first()[0] or 0
    return F.broadcast(side) if total <= BROADCAST_NUMBERS else side


def remove_repeats(docs: DataFrame, as_is: bool = False) -> DataFrame:
    """The rows of docs (any columns beside doc_id and text) with kept_text, n_words and n_removed instead of text.

    A word goes if a window of 50 consecutive words that covers it also starts in a document with
    a smaller doc_id; all windows are judged on the input. kept_text has the words that stay,
    joined by one space; with as_is, a text that loses no word is unchanged.

    A null text has no words. A row with a null doc_id is kept whole and removes nothing. Repeated
    rows (one doc_id) do not remove each other. Input columns named kept_text, n_words or n_removed
    are replaced. An empty table gives no rows.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed", "plan").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    profiles = cut(map_text(docs.where("doc_id is not null").select("doc_id", "text"), _profile, "doc_id long, n_words long, sid long, anchors array<long>").where(f"n_words >= {WINDOW}"))
    units = profiles.groupBy("sid").agg(F.min("doc_id").alias("d"), F.first("anchors").alias("anchors"))
    anchored = units.select("sid", "d", F.explode("anchors").alias("anchor"))
    shared = anchored.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    wanted = cut(anchored.join(shared, "anchor").groupBy("sid", "d").agg(F.collect_list("anchor").alias("shared")))
    texts = docs.select("doc_id", "text").join(_small(wanted.withColumnRenamed("d", "doc_id"), F.size("shared")), "doc_id")
    columns = "sid long, d long, s int, " + ", ".join(f"c{k} long" for k in range(len(STEPS)))
    windows = _repeated_windows(table(map_text(texts, _suffixes, columns)))
    # runs of neighbouring starts; a unit's starts are no more than its words
    windows = windows.withColumn("run", F.col("s") - F.dense_rank().over(Window.partitionBy("sid").orderBy("s")))
    runs = windows.groupBy("sid", "run").agg(F.min("s").alias("a"), F.max("s").alias("b")).groupBy("sid").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    first = units.select("sid", "d")
    parts = runs.join(first, "sid").select(F.col("d").alias("doc_id"), "sid", "runs")
    copies = profiles.join(first, "sid").where("doc_id > d").select("doc_id", "sid", "n_words").distinct()
    copies = copies.select("doc_id", "sid", F.array(F.struct(F.lit(0).alias("a"), (F.col("n_words") - WINDOW).cast("int").alias("b"))).alias("runs"))
    plan = cut(parts.union(copies).groupBy("doc_id").agg(F.collect_list(F.struct("sid", "runs")).alias("plan")))
    plan = _small(plan, 2 + F.aggregate("plan", F.lit(0), lambda n, p: n + 1 + 2 * F.size(p["runs"])))
    joined = docs.join(plan, "doc_id", "left")
    rest = [f for f in joined.schema.fields if f.name not in ("text", "plan")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "kept_text string", "n_words long", "n_removed long"])
    return map_text(joined, lambda batch: _apply(batch, as_is), schema)
