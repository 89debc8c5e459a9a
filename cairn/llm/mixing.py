"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash, so the blocks are a random permutation of
the source. A target of e + r times the source takes every block e times and a run of further
blocks of r times its words, the last of them in part. That makes an exact quota of blocks for
each source. A tree over the output shards splits the quotas: at a node, the left half of the
shards draws its share of blocks from the node's quotas without replacement (one multivariate
hypergeometric draw), the right half has the rest. Each shard so gets a disjoint run of every
source's permuted blocks and shuffles its documents locally.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, cut

#: At the end of a partial block, documents among which those that come nearest to the target are chosen.
CHOICE = 24
#: Words of a document that may come from a block behind the partial one, at most.
SMALL = 1 << 12
#: Words of a block and of an output shard, about; blocks that share a partial sum.
BLOCK_WORDS, SHARD_WORDS, RUN = 1 << 16, 1 << 20, 4096
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 11
ITEM = ["doc_id", "source", "size", "text_hash"]


def targets(sizes: list[float], share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> list[float]:
    """Words to take from each source, in order: by repeating weights, at most `most` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, live, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while live:
        total = sum(weight[i] for i in live)
        over = {i for i in live if rest * weight[i] / total > most * sizes[i]}
        if not over:
            for i in live:
                out[i] = rest * weight[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
        live -= over
    return out


def items_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; 0 of a null text) and text_hash of every row of docs."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )


def source_targets(items: DataFrame) -> DataFrame:
    """source, number, source_size, target of every source, by code point with null last; one row a source."""
    spark = items.sparkSession
    # one sum for each source: the list of sources is the mix's configuration and is taken to fit the driver
    sums = items.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(((r.source, r.n) for r in sums), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    goal = targets([n for _, n in rows])
    return spark.createDataFrame([(s, k, n, t) for k, ((s, n), t) in enumerate(zip(rows, goal))], "source string, number int, source_size long, target double")


def _nearest(words: list[int], budget: int) -> list[int]:
    """Places of a subset whose sum comes nearest to the budget (the smaller sum on a tie): sums are bits of one number."""
    sums = [1]
    for w in words:
        sums.append(sums[-1] | sums[-1] << w)
    low = (sums[-1] & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = sums[-1] >> (budget + 1)
    high = budget + (above & -above).bit_length() if above else None
    want = high if high is not None and high - budget < budget - low else low
    chosen = []
    for k in range(len(words) - 1, -1, -1):
        if not sums[k] >> want & 1:
            chosen.append(k)
            want -= words[k]
    return chosen


def _fitting(words: list[int], order: list[int], budget: float) -> tuple[list[int], list[int]]:
    """(places whose words come near the budget, places skipped): in order those that fit, the last ones and the least skipped chosen anew."""
    left, taken, skipped = budget, [], []
    for k in order:
        (taken if words[k] <= left else skipped).append(k)
        left -= words[k] if words[k] <= left else 0
    skipped.sort(key=lambda k: (words[k], k))
    inside = max(0, len(taken) - CHOICE // 2)
    sure, free = taken[:inside], taken[inside:] + skipped[: CHOICE // 2]
    chosen = _nearest([words[k] for k in free], round(budget - sum(words[k] for k in sure)))
    return sure + [free[k] for k in chosen], skipped


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Items of a source's last, partial block, and behind it of the next ones: in permuted order those that fit.

    Where that leaves a gap, a long document that was skipped may come first, and the others fill what it leaves.
    """
    budget = float(group["budget"].iloc[0])
    group = group.sort_values(["block", "order", *ITEM[:1], "text_hash"])
    words = group["words"].tolist()
    miss = lambda places: abs(budget - sum(words[k] for k in places))
    best, skipped = _fitting(words, list(range(len(words))), budget)
    for long in skipped[:CHOICE]:
        if miss(best) < 1 or words[long] > budget:
            break
        best = min(best, _fitting(words, [long, *(k for k in range(len(words)) if k != long)], budget)[0], key=miss)
    return group.iloc[sorted(best)][["number", *ITEM]]


def _shard_draws(quotas: np.ndarray, shards: int, seed: int):
    """For each shard: (source number, first unit, number of units), by descending the splitting tree."""
    total = int(quotas.sum())
    room = lambda i: total * i // shards

    def draws(frames):
        for frame in frames:
            rows = []
            for shard in frame["id"]:
                low, high, quota, skipped = 0, shards, quotas.copy(), np.zeros_like(quotas)
                while high - low > 1:
                    middle = (low + high) // 2
                    rng = np.random.default_rng([seed, low, high])
                    left = rng.multivariate_hypergeometric(quota, room(middle) - room(low), method="marginals")
                    if shard < middle:
                        high, quota = middle, left
                    else:
                        low, quota, skipped = middle, quota - left, skipped + left
                rows += [(int(shard), int(s), int(skipped[s]), int(quota[s])) for s in np.flatnonzero(quota)]
            yield pd.DataFrame(rows, columns=["shard", "number", "first", "units"])

    return draws


def mix(items: DataFrame, goal: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, source, size, text_hash, shard, position): the mix, one row for every time an item is taken.

    items is (doc_id, source, size, text_hash); rows alike in all four are taken together, each
    as often as the others. Items of size 0 are never taken. The same input gives the same rows.
    """
    spark = items.sparkSession
    plan = goal.where("source_size > 0 and target > 0").withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
    plan = plan.withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    plan = plan.withColumn("extra", F.col("target") - F.col("passes") * F.col("source_size"))
    grouped = items.where("size > 0").groupBy(*ITEM).agg(F.count("*").alias("n"))
    own = grouped.alias("a").join(F.broadcast(plan).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "number", "blocks", "passes", "extra")
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash")
    own = cut(own.withColumns({"order": order, "words": F.col("size") * F.col("n")}).withColumn("block", F.pmod("order", "blocks")))

    # words before each block, in two steps so that no window holds more than RUN blocks of a source
    block = own.groupBy("number", "block", "blocks", "passes", "extra").agg(F.sum("words").alias("words")).withColumn("run", F.floor(F.col("block") / RUN))
    run = block.groupBy("number", "run").agg(F.sum("words").alias("w"))
    before = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    run = run.select("number", "run", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("number", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(run, ["number", "run"])
    block = block.withColumn("begin", F.col("ahead") + F.col("within"))
    block = cut(block.withColumn("budget", F.col("extra") - F.col("begin")).select("number", "block", "blocks", "passes", "words", "budget"))

    # a long document of the partial block may leave room for more than the others there: behind them come
    # the small documents of the next blocks, about twice the budget's words of them
    small = own.where(F.col("words") <= SMALL).groupBy("number").agg(F.sum("words").alias("small"))
    part = block.where("budget > 0 and words > budget").join(small, "number", "left")
    more = F.coalesce(F.ceil(2 * F.col("budget") * F.col("blocks") / F.col("small")), F.lit(0))
    part = part.select("number", F.col("block").alias("at"), "budget", F.least(F.col("block") + more, F.col("blocks") - 1).alias("end"))
    partial = own.join(F.broadcast(part), "number").where("block = at or block > at and block <= end and words <= " + str(SMALL))
    partial = partial.select("number", *ITEM, "block", "order", "words", "budget")
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    filled = partial.groupBy("number").applyInPandas(_fill, ", ".join(f"{c} {types[c]}" for c in ["number", *ITEM]))

    # units: pass k of block b is unit k * blocks + b; the further blocks come last
    last = F.when(F.col("budget") > 0, F.col("passes") + 1).otherwise(F.col("passes"))
    unit = block.where("passes > 0 or budget > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), (last - 1).cast("int"))))
    unit = unit.select("number", "block", "pass", (F.col("pass") * F.col("blocks") + F.col("block")).alias("place"), ((F.col("pass") == F.col("passes")) & (F.col("words") > F.col("budget"))).alias("partial"))
    ranked = _ranks(unit)
    quota = dict(unit.groupBy("number").agg(F.count("*").alias("q")).collect())  # one number for each source
    quotas = np.array([quota.get(k, 0) for k in range(max(quota, default=-1) + 1)], np.int64)
    taken = goal.agg(F.sum("target")).first()[0] or 0
    shards = max(1, min(int(quotas.sum()), round(taken / SHARD_WORDS)))
    draws = spark.range(shards).mapInPandas(_shard_draws(quotas, shards, seed), "shard long, number int, first long, units long")
    draws = draws.withColumn("rank", F.explode(F.sequence("first", F.col("first") + F.col("units") - 1)))
    placed = ranked.join(draws.select("shard", "number", "rank"), ["number", "rank"])

    whole = own.join(placed.where("not partial").select("number", "block", "pass", "shard"), ["number", "block"]).select(*ITEM, "pass", "shard")
    some = filled.join(placed.where("partial").select("number", "pass", "shard"), "number").select(*ITEM, "pass", "shard")
    rows = whole.unionByName(some)
    # the local shuffle: a shard is about SHARD_WORDS words
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), *ITEM, "pass"), *ITEM, "pass")
    return rows.withColumn("position", F.row_number().over(local)).select(*ITEM, "shard", "position")


def _ranks(unit: DataFrame) -> DataFrame:
    """unit with rank: its place among its source's units, counted in runs of RUN places."""
    unit = unit.withColumn("run", F.floor(F.col("place") / RUN))
    size = unit.groupBy("number", "run").agg(F.count("*").alias("k"))
    before = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("number", "run", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("number", "run").orderBy("place")
    return unit.join(size, ["number", "run"]).withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1).drop("run", "ahead")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it, repeats counted) of every row.

    A null text or one without words has size 0 and is not taken. A null source is a source. Rows
    alike in doc_id, source and text have the same taken each; no document exceeds twice its size.
    """
    items = cut(items_of(docs))
    goal = source_targets(items)
    times = mix(items, goal).groupBy(*ITEM).agg(F.count("*").alias("times"))
    out = items.alias("i").join(times.alias("t"), [F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ITEM], "left")
    out = out.join(F.broadcast(goal).alias("g"), F.col("i.source").eqNullSafe(F.col("g.source")))
    return out.select("i.doc_id", "i.size", "source_size", "target", (F.col("i.size") * F.coalesce("times", F.lit(0))).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, dealt into shards and in the shards' order."""
    docs = docs.drop("shard", "position")
    items = cut(items_of(docs))
    rows = mix(items, source_targets(items)).select("doc_id", "text_hash", "source", "shard", "position").alias("m")
    # rows alike in doc_id, source and text are one item: each of them is taken as often as the item
    out = docs.alias("d").join(rows, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.text_hash")) & F.col("d.source").eqNullSafe(F.col("m.source")))
    return out.select("d.*", "m.shard", "m.position").repartition("shard").sortWithinPartitions("shard", "position").select(docs.columns)
