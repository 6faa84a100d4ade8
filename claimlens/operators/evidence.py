"""Evidence tables of detected networks, recurrence between them, and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import SPACES, STOP_WORDS
from .digest import ordered_digest
from .graph import both_ways, connected_components, eigenvector_centrality
from .metrics import duplicated_posts, time_bins
from .overlap import shared_sums
from .ranks import gaps, medians


def burst_timeline(posts: DataFrame, seconds: int = 60) -> DataFrame:
    # nine digits first, so that float noise does not decide ties of the fourth
    z = F.round(F.round("z", 9), 4)
    return time_bins(posts, seconds).select(
        "network_id", F.timestamp_seconds(F.col("bin") * seconds).alias("bin_start"), "post_count", z.alias("zscore"), "is_anomalous")


def duplicate_groups(posts: DataFrame, eligible: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Every post with its SHA-256, the id of its duplicate group (NULL outside one) and the canonical flag.

    Groups are connected over texts, not posts: copies of one text are one node.
    """
    present = eligible.select("network_id", "text_id").distinct()
    a = present.select("network_id", F.col("text_id").alias("text_a"))
    b = present.select("network_id", F.col("text_id").alias("text_b"))
    edges = links.join(a, "text_a").join(b, ["network_id", "text_b"]).select(F.col("network_id").alias("g"), F.col("text_a").alias("a"), F.col("text_b").alias("b"))
    parts = connected_components(edges).select(F.col("g").alias("network_id"), F.col("node").alias("text_id"), "component")
    grouped = eligible.join(parts, ["network_id", "text_id"], "left").withColumn("component", F.coalesce("component", "text_id"))
    facts = grouped.groupBy("network_id", "component").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("post_id", F.struct("created_at", "post_id")).alias("canonical")).filter("size >= 2")
    ids = ordered_digest(grouped.join(facts.select("network_id", "component"), ["network_id", "component"], "left_semi"), ["network_id", "component"], "post_id")
    named = grouped.join(facts, ["network_id", "component"]).join(ids, ["network_id", "component"]).select(
        "network_id", "post_id", F.col("digest").alias("duplicate_group"), (F.col("post_id") == F.col("canonical")).alias("is_canonical"))
    hashed = texts.select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return posts.join(hashed, "doc_id").join(named, ["network_id", "post_id"], "left").select(
        "network_id", "post_id", "account_id", "created_at", "content_sha256", "duplicate_group", F.coalesce("is_canonical", F.lit(False)).alias("is_canonical"))


def duplication_rate(posts: DataFrame, eligible: DataFrame, links: DataFrame) -> DataFrame:
    dup = duplicated_posts(eligible, links).filter("is_dup").select("network_id", "text_id")
    hit = eligible.join(dup, ["network_id", "text_id"], "left_semi").groupBy("network_id", "account_id").agg(F.count(F.lit(1)).alias("d"))
    total = posts.groupBy("network_id", "account_id").agg(F.count(F.lit(1)).alias("posts"))
    return total.join(hit, ["network_id", "account_id"], "left").select(
        "network_id", "account_id", "posts", F.round(F.coalesce("d", F.lit(0)) / F.col("posts"), 4).alias("duplication_rate"))


def member_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    a = members.select("network_id", "claim_id", F.col("account_id").alias("a"))
    b = members.select("network_id", "claim_id", F.col("account_id").alias("b"))
    return edges.join(a, ["claim_id", "a"]).join(b, ["network_id", "claim_id", "b"])


def degree_centrality(edges: DataFrame, members: DataFrame) -> DataFrame:
    inner = member_edges(edges, members).select(F.col("network_id").alias("g"), "a", "b")
    degree = both_ways(inner).groupBy(F.col("g").alias("network_id"), F.col("u").alias("account_id")).agg(F.count(F.lit(1)).alias("degree"))
    size = members.groupBy("network_id").agg(F.count(F.lit(1)).alias("n"))
    return members.select("network_id", "account_id").join(size, "network_id").join(degree, ["network_id", "account_id"], "left").select(
        "network_id", "account_id", F.round(F.coalesce("degree", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1)), 4).alias("degree_centrality"))


def account_annex(members: DataFrame, posts: DataFrame, edges: DataFrame, rates: DataFrame, accounts: DataFrame,
                  centrality: DataFrame | None = None) -> DataFrame:
    keys = ["network_id", "account_id"]
    hours = posts.groupBy(*keys, F.hour("created_at").alias("hr")).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("posts_in_cluster"), F.round(F.count(F.lit(1)) / 24, 4).alias("circadian_coverage"))
    middle = medians(gaps(posts, keys), keys, "gap", "median_gap").withColumn("median_gap", F.round("median_gap", 3))
    out = (
        members.select(*keys).join(hours, keys, "left").join(rates.select(*keys, "duplication_rate"), keys, "left").join(middle, keys, "left")
        .join(degree_centrality(edges, members), keys).join(accounts.select("account_id", "handle"), "account_id", "left")
        .select(*keys, F.coalesce("handle", F.lit("")).alias("handle"), F.coalesce("posts_in_cluster", F.lit(0).cast("bigint")).alias("posts_in_cluster"),
                F.coalesce("duplication_rate", F.lit(0.0)).alias("duplication_rate"), "median_gap",
                F.coalesce("circadian_coverage", F.lit(0.0)).alias("circadian_coverage"), "degree_centrality"))
    if centrality is not None:
        out = out.join(centrality, keys, "left").withColumn("eigenvector_centrality", F.coalesce("eigenvector_centrality", F.lit(0.0)))
    return out


def network_centrality(edges: DataFrame, members: DataFrame) -> DataFrame:
    inner = member_edges(edges, members).select(F.col("network_id").alias("g"), "a", "b", F.col("w_total").alias("w"))
    nodes = members.select(F.col("network_id").alias("g"), F.col("account_id").alias("node"))
    return eigenvector_centrality(inner, nodes).select(F.col("g").alias("network_id"), F.col("node").alias("account_id"), F.col("centrality").alias("eigenvector_centrality"))


def edge_snapshot(edges: DataFrame, members: DataFrame) -> DataFrame:
    return member_edges(edges, members).select(
        "network_id", F.col("a").alias("account_a"), F.col("b").alias("account_b"), "w_total", "w_time", "w_text", "w_amp", "w_meta", "w_struct", "signal_count")


def network_table(members: DataFrame, posts: DataFrame) -> DataFrame:
    """Sizes and the sorted set of platforms (five at most) of each network, with its claim."""
    size = members.groupBy("network_id", "claim_id").agg(F.count(F.lit(1)).alias("account_count"))
    p = posts.groupBy("network_id", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("network_id").agg(
        F.sum("n").alias("post_count"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("platforms"))
    return size.join(p, "network_id", "left")


def snapshot_digest(evidence: DataFrame, as_of: str, retention_days: int = 24 * 30) -> DataFrame:
    expiry = F.lit(as_of).cast("timestamp") + F.expr(f"make_dt_interval({retention_days})")
    return ordered_digest(evidence, ["network_id"], "content_sha256").select(
        "network_id", F.col("digest").alias("snapshot_sha256"), F.col("n").alias("evidence_post_count"), expiry.alias("expires_at"))


def top_terms(posts: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """(network_id, term, n, rank): most frequent alphanumeric words longer than three letters, no stop words.

    Words are counted once per stored text and multiplied by the posts that carry it.
    """
    uses = posts.groupBy("network_id", "doc_id").agg(F.count(F.lit(1)).alias("uses"))
    words = texts.select("doc_id", F.explode(F.split(F.translate(F.lower("text"), SPACES, " " * len(SPACES)), " +")).alias("w")).select(
        "doc_id", F.regexp_replace("w", r"[^\p{L}\p{N}]", "").alias("term"))
    words = words.filter((F.char_length("term") > 3) & ~F.col("term").isin(*STOP_WORDS)).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    counts = uses.join(words, "doc_id").groupBy("network_id", "term").agg(F.sum(F.col("uses") * F.col("c")).alias("n"))
    w = Window.partitionBy("network_id").orderBy(F.col("n").desc(), F.col("term"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fingerprint(members: DataFrame, terms: DataFrame) -> DataFrame:
    """SHA-256 of the sorted members and the sorted top terms."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    m = members.groupBy("network_id").agg(joined("account_id").alias("m"))
    t = terms.groupBy("network_id").agg(joined("term").alias("t"))
    return m.join(t, "network_id", "left").select("network_id", F.sha2(F.concat("m", F.lit("::"), F.coalesce("t", F.lit(""))), 256).alias("fingerprint"))


def recurrence_parent(members: DataFrame, order: DataFrame, threshold: float = 0.50) -> DataFrame:
    """(network_id, parent_network_id, jaccard): the earlier network with the most similar member set.

    order: (network_id, seq); a network may only point to one with a smaller seq. Equal values go to the earlier one.
    """
    m = members.select("network_id", "account_id").distinct().withColumn("g", F.lit(0))
    both = shared_sums(m, "g", "network_id", "account_id", value="both").select("a", "b", "both")
    size = m.groupBy("network_id").agg(F.count(F.lit(1)).alias("n")).join(order, "network_id")
    x = size.select(F.col("network_id").alias("a"), F.col("n").alias("na"), F.col("seq").alias("sa"))
    y = size.select(F.col("network_id").alias("b"), F.col("n").alias("nb"), F.col("seq").alias("sb"))
    j = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    pairs = both.join(x, "a").join(y, "b").withColumn("j", j).filter((F.col("j") >= threshold) & (F.col("sa") != F.col("sb")))
    a_first = F.col("sa") < F.col("sb")
    directed = pairs.select(
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("network_id"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("parent"),
        F.least("sa", "sb").alias("seq"), F.round("j", 9).alias("j"))
    best = directed.groupBy("network_id").agg(F.min(F.struct((-F.col("j")).alias("nj"), "seq", "parent")).alias("t"))
    return best.select("network_id", F.col("t.parent").alias("parent_network_id"), F.round(-F.col("t.nj"), 4).alias("jaccard"))


def comparison_accounts(candidates: DataFrame, members: DataFrame, totals: DataFrame) -> DataFrame:
    """Per network, candidates of its claim that are in no network, by volume, as many as it has members."""
    free = candidates.select("claim_id", "account_id").join(members.select("claim_id", "account_id").distinct(), ["claim_id", "account_id"], "left_anti")
    ranked = free.join(totals, "account_id", "left").withColumn("total_posts", F.coalesce("total_posts", F.lit(0).cast("bigint")))
    size = members.groupBy("network_id", "claim_id").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("cap"))
    largest = size.groupBy("claim_id").agg(F.max("cap").alias("largest"))
    # the first `largest` of a claim are among the first `largest` of its parts, so no task sorts a whole claim
    order = [F.col("total_posts").desc(), F.col("account_id")]
    parts = ranked.join(largest, "claim_id").withColumn("part", F.pmod(F.xxhash64("account_id"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id", "part").orderBy(*order))).filter("rank <= largest")
    short = parts.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy(*order))).filter("rank <= largest").drop("part")
    return short.join(size, "claim_id").filter("rank <= cap").select("network_id", "account_id", "total_posts", "rank")


def run_summary(run_claims: DataFrame, claims: DataFrame, candidates: DataFrame, missing: DataFrame) -> DataFrame:
    """Per run: claims examined, candidates summed, any truncated, families missing anywhere. Unknown and predicted claims are skipped."""
    known = run_claims.join(claims.filter("claim_type = 'existing'").select("claim_id"), "claim_id", "left_semi")
    per_claim = candidates.groupBy("claim_id").agg(F.max("candidates").alias("candidates"), F.max("truncated").alias("truncated"))
    fam = known.join(missing, "claim_id").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("missing_families"))
    out = known.join(per_claim, "claim_id", "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("claims"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"), F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"))
    return out.join(fam, "run_id", "left").withColumn("missing_families", F.coalesce("missing_families", F.lit(""))).withColumn("status", F.lit("completed"))


def purge_evidence(table: DataFrame, network_ids: DataFrame) -> DataFrame:
    """An evidence table without the rows of the named networks; the network table itself is kept by the caller."""
    return table.join(network_ids.select("network_id").distinct(), "network_id", "left_anti")


def purge_all(tables: dict[str, DataFrame], network_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The evidence tables after a purge, by name, and (table_name, purged, kept): how many rows of each table went and stayed."""
    named = network_ids.select("network_id").distinct()
    marks = None
    for name, table in tables.items():
        gone = table.select("network_id").join(named.withColumn("gone", F.lit(1)), "network_id", "left")
        row = gone.agg(F.lit(name).alias("table_name"), F.count("gone").alias("purged"), (F.count(F.lit(1)) - F.count("gone")).alias("kept"))
        marks = row if marks is None else marks.unionByName(row)
    return {name: purge_evidence(table, named) for name, table in tables.items()}, marks
