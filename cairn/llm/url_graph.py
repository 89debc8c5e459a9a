"""URL filters by rules and, where no rule fits, by trust propagated over the link graph.

Hosts are nodes. Edges are of two kinds: a page's absolute links to other hosts, weighted by
their number, and from each host to its parent domain, weighted by the host's pages (whoever
runs the domain answers for the host's name; a domain of one label is no host). Trust is a
personalised PageRank from trusted hosts along the edges; distrust one from blocked hosts
against them, so a host that links to blocked ones, or lies in a blocked domain, is distrusted.
A host is blocked where its share of distrust passes a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut

#: Host and path, as in the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, THRESHOLD = 0.85, 0.5
#: Steps end when the scores change by no more than this part of the seeds' weight altogether; each step lessens the change.
TOLERANCE = 1e-6

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules, value) -> Column:
    """value(verdict, host, path) of the longest rule that fits, else null. Rules are configuration: one expression holds them."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(value(verdict, h, p))).otherwise(out)
    return out


def host_scores(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from hosts(host, trusted, blocked: seed weights) and edges(src, dst, weight).

    Each kind's seeds are scaled to sum 1; a walk restarts at its seeds, and what has no way on
    is lost. Steps go on until the scores are settled. Without edges or seeds the scores are the
    scaled seeds.
    """
    total = hosts.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    scaled = lambda name, whole: (F.col(name) / whole if whole else F.lit(0.0)).alias(name)
    seeds = hosts.select("host", scaled("trusted", total.t), scaled("blocked", total.b))
    targets = edges.select(F.col("dst").alias("host"))
    nodes = cut(seeds.union(targets.distinct().join(seeds, "host", "left_anti").select("host", F.lit(0.0), F.lit(0.0))))
    way = edges.select("src", "dst", "weight", F.lit(True).alias("along")).union(edges.select("dst", "src", "weight", F.lit(False)))
    out = way.groupBy("src", "along").agg(F.sum("weight").alias("total"))
    way = cut(way.join(out, ["src", "along"]).select("src", "dst", "along", (F.col("weight") / F.col("total")).alias("share")))
    state = nodes.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    if way.isEmpty():
        return state
    moved = 1.0
    while moved > TOLERANCE:
        sent = way.join(state, way.src == state.host).select("dst", F.when(F.col("along"), F.col("trust") * F.col("share")).alias("t"), F.when(~F.col("along"), F.col("distrust") * F.col("share")).alias("d"))
        got = sent.groupBy("dst").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        after = nodes.join(got, nodes.host == got.dst, "left").select(
            "host",
            ((1 - DAMPING) * F.col("trusted") + DAMPING * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - DAMPING) * F.col("blocked") + DAMPING * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        old, state = state, cut(after)
        was = old.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = state.join(was, "host").agg(F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d")))).first()[0] or 0.0
    return state


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) from each of hosts(host, n) to its parent domain, and from that on, down to domains of two labels."""
    labels = F.split("host", r"\.")
    name = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))
    inside = hosts.where((F.size(labels) > 2) & F.element_at(labels, -1).rlike("^[a-z]"))  # no addresses of numbers
    return inside.select(F.explode(steps).alias("e"), "n").groupBy("e.src", "e.dst").agg(F.sum("n").cast("double").alias("weight"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust and decided of every row of pages(page_id, url, html).

    decided is `rule`, `scores` (the host has trust or distrust) or `default`. The longest fitting rule decides. Without one the host's scores do: block where distrust is
    over THRESHOLD of both together, else allow; a url without a host is allowed. Seeds are hosts
    that the rules decide: blocked where block rules fit more than half of a host's pages, else
    trusted where an allow rule fits one; a seed weighs as many as its pages. A null url is an
    empty one, a null html has no links; repeated rows count and return as often as they are there.
    """
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    base = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    rule = rule_column(F.col("host"), F.col("path"), rules, lambda v, h, p: h + p)
    verdict = rule_column(F.col("host"), F.col("path"), rules, lambda v, h, p: v)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    count = base.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a"))
    hosts = count.select("host", F.when((F.col("a") > 0) & (2 * F.col("b") <= F.col("n")), F.col("n")).otherwise(0).cast("double").alias("trusted"), F.when(2 * F.col("b") > F.col("n"), F.col("n")).otherwise(0).cast("double").alias("blocked"))
    links = base.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    links = links.select("src", host_of(F.concat(F.lit(":"), F.regexp_replace("link", "^[^/]*:", ""))).alias("dst"))
    edges = links.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    edges = cut(edges.union(domain_edges(count)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    scores = host_scores(hosts, edges)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    own = base.drop("html").join(scores, "host", "left")
    by_host = F.when(F.col("distrust") > 0, F.when(share > THRESHOLD, "block").otherwise("allow")).otherwise("allow")
    decided = F.when(F.col("ruled").isNotNull(), "rule").when((F.col("trust") > 0) | (F.col("distrust") > 0), "scores").otherwise("default")
    return own.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust", decided.alias("decided"))
