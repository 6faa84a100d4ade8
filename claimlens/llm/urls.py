"""URL filter by rules and link-graph propagation (operator 5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lineage import materialize

#: (list, host and its subdomains, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Ranks, which add up to 1, have settled once a round moves no more than this in all.
SETTLED = 1e-10
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Propagation:
    damping: float = 0.85
    rounds: int = 1000  # safety bound; ranks that haven't settled by then raise
    seed_share: float = 0.5  # a host is a seed if a larger share of its pages is under rules of one list
    margin: float = 1.0  # block a host whose distrust is over this many times its trust
    floor: float = 1e-9


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, list) of the longest rule that fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame) -> DataFrame:
    """(a, b): distinct edges between different hosts, from a page's host to the host of an absolute link in its html."""
    found = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), 1)
    rows = pages.select("host", F.explode(F.array_distinct(found)).alias("to"))
    target = host_of(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to")))
    return rows.select(F.col("host").alias("a"), target.alias("b")).filter("a <> b AND a <> '' AND b <> ''").distinct()


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, name: str) -> DataFrame:
    """(host, rank): personalised PageRank over edges (a, b); seeds (host, seed) carry the restart weights, adding up to 1.

    Rank that reaches a host without edges goes back to the seeds in the same round. That only scales the ranks, which
    are a multiple of x = seed + damping * (what x sends along edges); so x is found in rounds until it has settled, and
    brought to the sum 1. Each round is written to the shared folder, which bounds the plan and what a lost executor
    costs. A hot target is summed in part before it is shuffled.
    """
    out = materialize(edges.join(edges.groupBy("a").agg(F.count(F.lit(1)).alias("deg")), "a").select("a", "b", (1.0 / F.col("deg")).alias("w")), f"{name}-edges")
    hosts = seeds.select("host").unionByName(out.select(F.col("a").alias("host"))).unionByName(out.select(F.col("b").alias("host"))).distinct()
    base = materialize(hosts.join(seeds, "host", "left").select("host", F.coalesce("seed", F.lit(0.0)).alias("seed")), f"{name}-hosts")
    rank = base.select("host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        sent = rank.join(out, rank["host"] == out["a"]).groupBy(F.col("b").alias("host")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        moved = base.join(sent, "host", "left").join(rank.withColumnRenamed("rank", "was"), "host", "left")
        moved = materialize(moved.select("host", (F.col("seed") + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"), "was"), name)
        row = moved.agg(F.sum("rank").alias("total"), F.sum(F.abs(F.col("rank") - F.col("was"))).alias("off")).first()
        total = row["total"] or 1.0
        rank = moved.select("host", "rank")
        if (row["off"] or 0.0) <= SETTLED * total:
            return moved.select("host", (F.col("rank") / F.lit(total)).alias("rank"))
    raise RuntimeError(f"{name} ranks haven't settled after {rounds} rounds")


def judge(pages: DataFrame, rules=RULES, p: Propagation | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each row of pages.

    The longest fitting rule decides. For other pages the host does: trust flows from hosts whose pages are mostly under
    allow rules along links, distrust flows from hosts mostly under block rules against links (who links to them), and
    a host is blocked if its distrust is over `margin` times its trust. A host that neither reaches is allowed. Null
    urls and urls without :// have an empty host and path, fit no rule and are allowed; null html has no links; repeated
    rows are judged alike, and count as pages of their host. Other columns are ignored.
    """
    p = p or Propagation()
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    name, kind = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "listed": kind})
    share = lambda k: F.sum(F.when(F.col("listed") == k, 1).otherwise(0)) / F.count(F.lit(1))
    hosts = materialize(rows.filter("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), "hosts")
    edges = materialize(links(rows), "links")

    def seeds(column):
        s = hosts.filter(F.col(column) > p.seed_share)
        n = s.count()
        return s.select("host", F.lit(1.0 / max(n, 1)).alias("seed"))

    trust = pagerank(edges, seeds("allow"), p.damping, p.rounds, "trust").select("host", F.col("rank").alias("trust"))
    against = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    distrust = pagerank(against, seeds("block"), p.damping, p.rounds, "distrust").select("host", F.col("rank").alias("distrust"))
    marks = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").fillna(0.0, ["trust", "distrust"])
    marks = materialize(marks, "marks")
    out = rows.select("page_id", "host", "path", "rule", "listed").join(marks, "host", "left")
    bad = (F.col("distrust") > p.floor) & (F.col("distrust") > F.lit(p.margin) * F.col("trust"))
    verdict = F.coalesce("listed", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"))
