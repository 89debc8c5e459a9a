"""Jaccard self-join on word n-grams by vertical partitioning.

All n-grams have one global order, rarest first by exact counts of sets and then by fingerprint.
The order is cut at pivots into contiguous fragments of about equal numbers of postings, and a
set falls into one segment for each fragment. Candidates meet inside a fragment; their overlap
is counted fragment by fragment and summed for the pair, which decides the link exactly.

Most sets cannot link to another one, and no row is made for them: a set of n n-grams of which
u are in no other set overlaps any other in n - u at most. That is tested first on a part of
the fingerprints (a set with too many unshared n-grams in a part has too many altogether), then
on all n-grams of the sets left.

Candidates come from the rare end of the order: if two sets meet the threshold, their first
common n-gram leaves enough behind it in both. That bound on its two places, the bound on the
sizes and a 256-bit parity signature (its differing bits never exceed the symmetric difference)
are conditions of the join, so a pair that fails them is no row. A posting list is split by set
size, in steps of the largest ratio that the threshold allows.

Groups of near copies are linked through hubs: in every posting list the member with the
rarest place is compared with the others; afterwards only pairs that are in one list and still
in different components are compared. No link between components is lost, and pairs inside
one are not listed. Identical sets are one node throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, U, ints, map_text, mix, text_bytes, windows_of, word_hashes, word_spans
from cairn.llm.components import connected_components

#: Fragments of the order.
FRAGMENTS = 8
#: Rows of two numbers that may be broadcast (8 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Partners of a set that one task compares with its segments; a set with more has copies of its segments.
PARTNERS = 256
#: Rows of a key that are never too many, and rows of one side that meet a posting list in one part.
HOT_ROWS, LIST = 1024, 1024
SIGNATURE = ("p0", "p1", "p2", "p3")


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' n-gram fingerprints, each text's distinct and ascending; where each text's begin and the end)."""
    raw, offsets = text_bytes(text)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    grams = windows_of(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:  # a shorter text is one n-gram, an empty one none
            out.append(windows_of(words[a:b], b - a) if b > a else grams[:0])
    stops = np.cumsum([0, *map(len, out)])
    return np.concatenate([np.zeros(0, np.uint64), *out]), stops


def _identities(grams: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each set, 0 of an empty one; members' second fingerprints)."""
    second = mix(grams + U(0x632BE59BD9B4E019))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(second)])[stops]
    n = np.diff(stops)
    return np.where(n > 0, mix(np.diff(sums) + n.astype(np.uint64)), U(0)).view(np.int64), second


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, sid (the set's identity) and its parity words p0-p3."""

    def profile(batch):
        grams, stops = shingle_sets(batch.column("text"), size)
        sid, second = _identities(grams, stops)
        n = np.diff(stops)
        bit = np.repeat(np.arange(len(n)), n) * 256 + (second & U(255)).astype(np.int64)
        odd = np.bincount(bit, minlength=len(n) * 256).astype(np.uint8) & 1
        parity = np.packbits(odd).view(np.int64).reshape(len(n), 4)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid), *(pa.array(parity[:, k]) for k in range(4))], names=["doc_id", "n", "sid", *SIGNATURE])

    return map_text(docs, profile, "doc_id long, n long, sid long, p0 long, p1 long, p2 long, p3 long")


def _postings(texts: DataFrame, size: int, least: int, part: int = 1) -> DataFrame:
    """(gram, sid) of the texts' sets of at least `least` n-grams; only fingerprints divisible by `part`, a power of two.

    texts is (text) or (text, sid): with sid, a text that has another identity is left out.
    """
    named = "sid" in texts.columns

    def postings(batch):
        grams, stops = shingle_sets(batch.column("text"), size)
        sid = _identities(grams, stops)[0]
        n = np.diff(stops)
        wanted = n >= least
        if named:  # a doc_id may have rows with other texts
            wanted &= sid == ints(batch.column("sid"))
        keep = np.repeat(wanted, n) & ((grams & U(part - 1)) == 0)
        yield pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(np.repeat(sid, n)[keep])], names=["gram", "sid"])

    return map_text(texts, postings, "gram long, sid long")


def _of(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, text) of the sets(sid, d): each from the rows of its least document."""
    wanted = sets.select("sid", F.col("d").alias("doc_id"))
    return texts.join(F.broadcast(wanted) if sets.count() <= BROADCAST_ROWS else wanted, "doc_id").select("sid", "text")


def _can_link(n: Column, unshared: Column, percent: int) -> Column:
    return 100 * (n - unshared) >= percent * n


def linkable_sets(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The nodes(sid, n, ..) that may link to another set, by their unshared n-grams in a part of the fingerprints."""
    least = _least(percent)
    # a part of twice the share that a set may lose: an unrelated set has far more unshared n-grams there
    part = 1 << max(0, int(math.floor(math.log2(100 / (2 * (100 - percent)))))) if percent < 100 else 1
    seen = _postings(docs.where("doc_id is not null").select("text"), size, least, part)
    seen = seen.groupBy("gram").agg(F.min("sid").alias("sid"), F.max("sid").alias("other")).where("sid = other")
    own = seen.groupBy("sid").agg(F.count("*").alias("unshared"))
    nodes = nodes.where(F.col("n") >= least).join(own, "sid", "left")
    return nodes.where(_can_link(F.col("n"), F.coalesce("unshared", F.lit(0)), percent)).drop("unshared")


def _least(percent: int) -> int:
    """The fewest n-grams of a set that may link to a different set: it lies in one that has one more."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _place(gram: Column, k: Column) -> Column:
    """Where an n-gram of count k stands in the global order, as a number: never falling along it."""
    return k + (gram / F.lit(2.0**64) + 0.5)


def pivots_of(postings: DataFrame, fragments: int = FRAGMENTS) -> list[float]:
    """Places that cut the order of postings(gram, k) into fragments of about equal numbers of postings."""
    at = [i / fragments for i in range(1, fragments)]
    return postings.select(_place(F.col("gram"), F.col("k")).alias("place")).approxQuantile("place", at, 0.005)


def segments_of(docs: DataFrame, sets: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(sid, fragment, n, head, grams): the sets(sid, d, n) cut at the pivots; only n-grams of two sets or more are in segments.

    head is the number of n-grams before the segment in the global order; the unshared ones come
    first. grams is in that order. Sets with too many unshared n-grams are left out.
    """
    rows = scratch.table(_postings(_of(docs, sets), size, 1))
    # repeated rows of a text count too, which is as good an order, but make no n-gram a shared one
    counts = rows.groupBy("gram").agg(F.count("*").alias("k"), F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").drop("a", "b")
    counts = scratch.table(counts)
    shared = scratch.table(hot_join(rows, counts, ["gram"], "k", rows.count()))
    scratch.drop(rows, counts)
    pivots = pivots_of(shared)
    place = _place(F.col("gram"), F.col("k"))
    fragment = sum(((place > p).cast("int") for p in pivots), F.lit(0))
    # a set's members are no more than its text's words; repeated rows of a text give each of them again
    parts = shared.groupBy("sid", fragment.alias("fragment")).agg(F.sort_array(F.collect_set(F.struct("k", "gram"))).alias("grams"))
    parts = scratch.table(parts.select("sid", "fragment", F.col("grams.gram").alias("grams")))
    scratch.drop(shared)
    sizes = parts.groupBy("sid").agg(F.sum(F.size("grams")).alias("held"), F.map_from_entries(F.collect_list(F.struct("fragment", F.size("grams").alias("k")))).alias("sizes"))
    sizes = sizes.join(sets.select("sid", "n"), "sid").where(_can_link(F.col("n"), F.col("n") - F.col("held"), percent))
    before = sum((F.when(F.col("fragment") > f, F.coalesce(F.col("sizes")[f], F.lit(0))).otherwise(0) for f in range(FRAGMENTS)), F.lit(0))
    out = scratch.table(parts.join(sizes, "sid").select("sid", "fragment", "n", (F.col("n") - F.col("held") + before).alias("head"), "grams"))
    scratch.drop(parts)
    return out


def hot_join(rows: DataFrame, counted: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """rows joined with counted (one row a key, with the number of its rows), no key of which fills a task.

    A key with over a quarter of a task's even share of all rows is hot. There are at most four of
    them for each task, so they are broadcast, and their rows are never dealt by key. counted is a
    stored table; total is the number of all rows.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col(count) > max(HOT_ROWS, total // (4 * tasks))
    heavy = counted.where(hot)
    if heavy.isEmpty():
        return rows.join(counted, key)
    few = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(counted.where(~hot), key)
    return few.unionByName(rest)


def _differing(x: str, y: str) -> Column:
    """Differing bits of two parity signatures."""
    return sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in SIGNATURE), F.lit(0))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two postings of one n-gram, taken as the first common one, leave room for the threshold."""
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny = c(x, "n"), c(y, "n")
    overlap = F.ceil(percent * (nx + ny) / (100 + percent) - F.lit(1e-9))
    return (
        (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
        & (F.least(nx - c(x, "at"), ny - c(y, "at")) >= overlap)
        & (_differing(x, y) <= nx + ny - 2 * overlap)
    )


def _lists(segments: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Posting lists (gram, step) of the prefixes, with each member's place `at`, size n and signature, and the list's number of members.

    Sets whose sizes the threshold allows together are at most one step apart; each set is in the
    lists of its own step and of the one below.
    """
    keep = F.col("n") - F.ceil(percent * F.col("n") / 100 - F.lit(1e-9)) + 1  # places of the prefix
    rows = segments.where(F.col("head") < keep).withColumn("grams", F.slice("grams", F.lit(1), (keep - F.col("head")).cast("int")))
    rows = rows.select("sid", "head", F.posexplode("grams").alias("i", "gram")).select("sid", "gram", (F.col("head") + F.col("i")).alias("at"))
    step = F.floor(F.log("n") / (math.log(100 / percent) + 1e-6))
    rows = scratch.table(rows.join(sets.select("sid", "n", *SIGNATURE), "sid").withColumn("step", F.explode(F.array(step, step - 1))))
    shared = scratch.table(rows.groupBy("gram", "step").agg(F.count("*").alias("members")).where("members > 1"))
    out = scratch.table(hot_join(rows, shared, ["gram", "step"], "members", rows.count()))
    scratch.drop(rows, shared)
    return out


def _links(pairs: DataFrame, segments: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose sets meet the threshold: overlaps counted by fragment and summed."""
    pairs = scratch.table(pairs.select("u", "v"))
    few = pairs.count() <= BROADCAST_ROWS
    side = F.broadcast if few else lambda rows: rows
    copies = pairs.groupBy("v").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("copies"))
    dealt = pairs.join(side(copies), "v").withColumn("copy", F.pmod(F.hash("u"), F.col("copies"))).drop("copies")
    x = segments.join(side(dealt.withColumnRenamed("u", "sid")), "sid").select(F.col("sid").alias("u"), "v", "copy", "fragment", F.col("n").alias("nu"), F.col("grams").alias("gu"))
    y = segments.join(side(copies.withColumnRenamed("v", "sid")), "sid")
    y = y.select(F.col("sid").alias("v"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "fragment", F.col("n").alias("nv"), F.col("grams").alias("gv"))
    partial = x.join(y, ["v", "copy", "fragment"]).select("u", "v", "nu", "nv", F.size(F.array_intersect("gu", "gv")).alias("overlap"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("overlap").alias("o"))
    out = scratch.table(total.where(100 * F.col("o") >= percent * (F.col("nu") + F.col("nv") - F.col("o"))).select("u", "v"))
    scratch.drop(pairs)
    return out


def _prepared(docs: DataFrame, size: int, percent: int, scratch: Scratch):
    """(profiles by row, nodes by set, segments and posting lists of the sets that may link)."""
    profiles = scratch.table(_profiles(docs, size))
    alike = profiles.where("n > 0 and doc_id is not null").groupBy("sid")
    nodes = scratch.table(alike.agg(F.min("doc_id").alias("d"), *(F.first(c).alias(c) for c in ("n", *SIGNATURE))))
    sets = scratch.table(linkable_sets(docs, nodes, size, percent))
    segments = segments_of(docs, sets, size, percent, scratch)
    lists = _lists(segments, sets, percent, scratch)
    return profiles, nodes, segments, lists


def _columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _pairs(lists: DataFrame, percent: int, apart: Column | None = None) -> DataFrame:
    """The distinct candidate pairs (u, v), u < v, of all posting lists; a long list's pairs are made in parts of about LIST rows of one side."""
    parts = F.ceil(F.col("members") / LIST).cast("int")
    x = lists.withColumn("part", F.pmod(F.hash("sid"), parts)).alias("x")
    y = lists.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    meet = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.sid") < F.col("y.sid")) & _may_link("x", "y", percent)
    meet = meet & apart if apart is not None else meet
    return x.join(y, meet).select(F.col("x.sid").alias("u"), F.col("y.sid").alias("v")).distinct()


def ngram_links(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(all links (u, v) between different sets, u < v; members (doc_id, sid, n) of the sets): the whole join.

    Documents of one set are linked with each other and with all documents of a linked set. The
    edge cases are those of ngram_components. Its work is that of all pairs of near copies.
    """
    docs = _columns(docs)
    scratch = Scratch(docs.sparkSession)
    profiles, _, segments, lists = _prepared(docs, size, percent, scratch)
    return _links(_pairs(lists, percent), segments, percent, scratch), profiles.where("n > 0 and doc_id is not null").select("doc_id", "sid", "n")


def ngram_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word
    n-grams (A-Z lower-cased). component_id is the smallest doc_id reachable by links.

    A null or wordless text has n_shingles 0 and its own id. A row whose doc_id is null keeps
    its row, with component_id null, and links nothing. Repeated rows give repeated rows. Other
    columns are ignored; an empty table gives no rows.
    """
    docs = _columns(docs)
    scratch = Scratch(docs.sparkSession)
    profiles, nodes, segments, lists = _prepared(docs, size, percent, scratch)

    # first the likeliest hub of every set, then the other hubs of sets still apart, then all pairs still apart
    heads = scratch.table(lists.groupBy("gram", "step").agg(F.min(F.struct("at", "n", "sid", *SIGNATURE)).alias("y"), F.first("members").alias("members")))
    total = lists.count()
    hubs = hot_join(lists.select("gram", "step", F.struct("sid", "n", "at", *SIGNATURE).alias("x")), heads, ["gram", "step"], "members", total)
    hubs = hubs.where((F.col("x.sid") != F.col("y.sid")) & _may_link("x", "y", percent))
    hubs = scratch.table(hubs.select(F.col("x.sid").alias("u"), F.col("y.sid").alias("v"), _differing("x", "y").alias("differ")).distinct())
    likely = hubs.groupBy("u").agg(F.min(F.struct("differ", "v")).alias("h")).select("u", "h.v")
    links = _links(likely, segments, percent, scratch)
    root = links.groupBy("u").agg(F.min("v").alias("root"))
    root = root.join(root.select(F.col("u").alias("root"), F.col("root").alias("next")), "root", "left").select("u", F.coalesce("next", "root").alias("root"))
    others = hubs.select("u", "v").join(likely, ["u", "v"], "left_anti").join(root, "u", "left").join(root.select(F.col("u").alias("v"), F.col("root").alias("other")), "v", "left")
    others = others.where(F.coalesce("root", "u") != F.coalesce("other", "v"))
    links = links.union(_links(others, segments, percent, scratch))

    known = connected_components(links, scratch)
    member = lists.join(known.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    apart = member.groupBy("gram", "step").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.first("members").alias("of")).where("a < b").drop("a", "b")
    apart = scratch.table(apart)
    member = scratch.table(hot_join(member, apart, ["gram", "step"], "of", total))
    rest = _pairs(member, percent, F.col("x.component") != F.col("y.component"))
    rest = scratch.table(rest.join(hubs.select("u", "v").union(hubs.select("v", "u")), ["u", "v"], "left_anti"))
    scratch.drop(member, hubs, lists, heads, apart)
    if not rest.isEmpty():
        known = connected_components(links.union(_links(rest, segments, percent, scratch)), scratch)
    named = nodes.select("sid", "d").join(known.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("d").alias("component_id"))
    named = named.join(least, "component").select("sid", "component_id")
    out = (
        profiles.select("doc_id", F.col("n").alias("n_shingles"), "sid")
        .join(named, "sid", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))).alias("component_id"))
    )
    scratch.drop(segments)
    return out
