"""Claim-relevance gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def relevance_gate(members: DataFrame, posts: DataFrame, totals: DataFrame, anchor: float = 0.60, min_posts: int = 20,
                   min_link: float = 0.15) -> DataFrame:
    """Anchoring share, post count, overlap ratio and the first failing test of every network."""
    own = posts.groupBy("network_id", "account_id").agg(F.count(F.lit(1)).alias("n"))
    m = members.select("network_id", "account_id").join(own, ["network_id", "account_id"], "left").join(totals, "account_id", "left")
    n = F.coalesce("n", F.lit(0))
    agg = m.groupBy("network_id").agg(
        F.count(F.lit(1)).alias("members"), F.sum(n).alias("claim_posts"),
        (F.count(F.when(n >= 2, 1)) / F.count(F.lit(1))).alias("anchoring"), F.sum(F.coalesce("total_posts", n)).alias("all_posts"))
    overlap = F.when(F.col("all_posts") > 0, F.col("claim_posts") / F.col("all_posts")).otherwise(0.0)
    failed = F.when(F.col("anchoring") < anchor, "anchoring").when(F.col("claim_posts") < min_posts, "evidence_volume").when(overlap < min_link, "link_strength")
    return agg.select(
        "network_id", "members", "claim_posts", F.round("anchoring", 4).alias("anchoring_share"), F.round(overlap, 4).alias("overlap_ratio"),
        failed.alias("failed_test")).withColumn("passed", F.col("failed_test").isNull())


def offtopic_clusters(gate: DataFrame, metrics: DataFrame) -> DataFrame:
    """Gate failures with their signals, ratios and the failed test."""
    return gate.filter(~F.col("passed")).join(metrics.select("network_id", "sy", "du", "co", "pr", "au", "coordination_score"), "network_id").select(
        "network_id", F.col("members").alias("account_count"), F.col("claim_posts").alias("post_count"), "anchoring_share", "overlap_ratio",
        "failed_test", "sy", "du", "co", "pr", "au", "coordination_score")
