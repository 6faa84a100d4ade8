"""Boards, listings and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import materialize


def _matches(column: str, q: str | None) -> Column:
    if not q:
        return F.lit(True)
    return F.lower(column).contains(q.lower())


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page of a listing with the total number of matching rows. The listing is written once and read twice."""
    df = materialize(df, "listing")
    return df.withColumn("total", F.lit(df.count()).cast("bigint")).orderBy(*order).offset(offset).limit(limit)


def statement_counts(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("claim_id").isNotNull()).groupBy("claim_id").agg(
        F.count(F.when(F.col("stance") == "supporting", 1)).alias("supporting_count"),
        F.count(F.when(F.col("stance") == "opposing", 1)).alias("opposing_count"))


def alert_flags(claims: DataFrame, alerts: DataFrame) -> DataFrame:
    ids = alerts.select("claim_id").distinct().withColumn("on", F.lit(True))
    return claims.select("claim_id").join(ids, "claim_id", "left").select("claim_id", F.coalesce("on", F.lit(False)).alias("alert_on"))


def existing_board(scored: DataFrame, posts: DataFrame, alerts: DataFrame, topic_ids=None, status: str | None = None,
                   q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Existing claims by final score, unknown last. Counts are joined once, not fetched per row."""
    keep = scored.filter((F.col("claim_type") == "existing") & _matches("claim_statement", q))
    if topic_ids:
        keep = keep.filter(F.col("topic_id").isin(list(topic_ids)))
    if status:
        keep = keep.filter(F.col("status") == status)
    zero = F.lit(0).cast("bigint")
    top = page(keep, [F.col("final_score").desc_nulls_last(), F.col("claim_id")], limit, offset)
    return (
        top.join(statement_counts(posts), "claim_id", "left").join(alert_flags(keep, alerts), "claim_id", "left")
        .select("claim_id", "claim_statement", "topic_id", "status", "final_score",
                F.coalesce("supporting_count", zero).alias("supporting_count"), F.coalesce("opposing_count", zero).alias("opposing_count"),
                "alert_on", "total"))


def non_existing_board(claims: DataFrame, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    keep = claims.filter((F.col("claim_type") == "non_existing") & _matches("claim_statement", q)).select(
        "claim_id", "claim_statement", "topic_id", "policy_id", "created_at", F.lit(None).cast("double").alias("final_score"), F.lit(False).alias("alert_on"))
    return page(keep, [F.col("created_at").desc(), F.col("claim_id")], limit, offset)


def top_accounts(posts: DataFrame, k: int = 5) -> DataFrame:
    counts = posts.filter((F.col("stance") == "supporting") & F.col("author_id").isNotNull() & F.col("claim_id").isNotNull()).groupBy(
        "claim_id", "author_id").agg(F.count(F.lit(1)).alias("post_count"))
    w = Window.partitionBy("claim_id").orderBy(F.col("post_count").desc(), F.col("author_id"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def claim_posts(posts: DataFrame) -> DataFrame:
    """Posts of every claim in display order, as rows: (claim_id, stance, position, post_id, created_at).

    Kept as rows rather than one list per claim, so that a claim with very many posts stays spread out;
    positions come from per-day counts plus a rank inside the day.
    """
    p = posts.filter(F.col("claim_id").isNotNull()).select("claim_id", "stance", "post_id", "created_at", F.to_date("created_at").alias("day"))
    days = p.groupBy("claim_id", "stance", "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("claim_id", "stance").orderBy("day")
    before = days.withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
    inside = Window.partitionBy("claim_id", "stance", "day").orderBy("created_at", "post_id")
    ranked = p.withColumn("r", F.row_number().over(inside))
    return ranked.join(before, ["claim_id", "stance", "day"]).select(
        "claim_id", "stance", (F.col("before") + F.col("r")).alias("position"), "post_id", "created_at")


def claim_detail(scored: DataFrame, posts: DataFrame, topics: DataFrame, alerts: DataFrame, links: DataFrame) -> DataFrame:
    """Per existing claim: score parts, sizes and ends of the three post lists, top accounts, policies, topic, alert."""
    p = posts.filter(F.col("claim_id").isNotNull())
    order = F.struct("created_at", "post_id")

    def per(stance):
        mine = F.col("stance") == stance
        return [F.count(F.when(mine, 1)).alias(f"{stance}_posts"), F.min_by(F.when(mine, F.col("post_id")), F.when(mine, order)).alias(f"first_{stance}")]

    lists = p.groupBy("claim_id").agg(*[c for s in ("supporting", "opposing", "neutral") for c in per(s)])
    tops = top_accounts(posts).groupBy("claim_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "author_id"))), lambda x: x["author_id"]), ",").alias("top_accounts"))
    linked = links.groupBy("claim_id").agg(F.count(F.lit(1)).alias("policies"), F.min("policy_id").alias("first_policy"))
    zero = F.lit(0).cast("bigint")
    return (
        scored.filter("claim_type = 'existing'")
        .join(lists, "claim_id", "left").join(tops, "claim_id", "left").join(linked, "claim_id", "left")
        .join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id", "left")
        .join(alert_flags(scored, alerts), "claim_id", "left")
        .withColumn("policies", F.coalesce("policies", zero))
        .withColumns({f"{s}_posts": F.coalesce(f"{s}_posts", zero) for s in ("supporting", "opposing", "neutral")}))


def predicted_detail(claims: DataFrame, policies: DataFrame) -> DataFrame:
    p = policies.select("policy_id", F.col("title").alias("policy_title"))
    return claims.filter("claim_type = 'non_existing'").select("claim_id", "claim_statement", "status", "policy_id").join(p, "policy_id", "left")


def watchlist(alerts: DataFrame, scored: DataFrame, threshold: float = 70.0, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    score = F.coalesce("final_score", F.lit(0.0))
    rows = alerts.join(scored.filter(_matches("claim_statement", q)), "claim_id").select(
        "claim_id", "claim_statement", score.alias("final_score"),
        F.when(score >= threshold, "over_threshold").otherwise("under_threshold").alias("threshold_status"), "added_at")
    return page(rows, [F.col("added_at").desc(), F.col("claim_id")], limit, offset)


def bucket_key(at: Column, granularity: str) -> Column:
    if granularity == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), at), F.weekofyear(at))
    return F.date_format(at, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[granularity])


def score_trend(snapshots: DataFrame, alerts: DataFrame, granularity: str = "week") -> DataFrame:
    """Mean score per watched claim and bucket; a bucket's time is its earliest snapshot over all of them."""
    watched = snapshots.join(alerts.select("claim_id").distinct(), "claim_id", "left_semi").withColumn("bucket", bucket_key(F.col("recorded_at"), granularity))
    # stored scores have four decimals: a decimal sum makes the mean independent of row order
    mean = F.sum(F.col("final_score").cast("decimal(18,4)")).cast("double") / F.count("final_score")
    per_claim = watched.groupBy("claim_id", "bucket").agg(mean.alias("mean_score"), F.min("recorded_at").alias("first_at"))
    times = per_claim.groupBy("bucket").agg(F.min("first_at").alias("recorded_at"))
    return per_claim.join(times, "bucket").select("claim_id", "bucket", "recorded_at", "mean_score")


def policy_board(policies: DataFrame, claims: DataFrame, links: DataFrame, years=None, q: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Policies with linked claims first by their latest claim, then the others by creation, newest first."""
    keep = policies.filter(_matches("title", q))
    if years:
        keep = keep.filter(F.year("rolled_out_date").isin(list(years)))
    linked = links.join(claims.select("claim_id", "created_at"), "claim_id").select("policy_id", "created_at")
    predicted = claims.filter("policy_id IS NOT NULL").select("policy_id", "created_at")
    latest = linked.unionByName(predicted).groupBy("policy_id").agg(F.max("created_at").alias("latest"))
    ranked = keep.join(latest, "policy_id", "left").select(
        "policy_id", "title", F.col("latest").isNotNull().alias("has_activity"), F.coalesce("latest", "created_at").alias("sort_time"))
    return page(ranked, [F.col("has_activity").desc(), F.col("sort_time").desc(), F.col("policy_id")], limit, offset)


def policy_detail(policies: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """Linked and predicted claims of each policy. A few claims may hold all links, so links meet the titles first, by
    policy, and claims last; those are written before, so that the planner knows when they are few and can be sent."""
    titles = materialize(policies.select("policy_id", "title"), "titles")
    claims = materialize(claims.select("claim_id", "claim_type", "claim_statement", "status", F.col("policy_id").alias("predicted_of")), "claims")
    cols = ("policy_id", "claim_id", "claim_statement", "status")
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # kept: merged by bytes, a task would sort millions of short rows
    existing = claims.filter("claim_type = 'existing'")
    linked = links.select("claim_id", "policy_id").join(existing.select("claim_id"), "claim_id", "left_semi")
    linked = linked.repartition(parts, "policy_id").join(titles, "policy_id").join(existing, "claim_id")
    predicted = claims.filter("predicted_of IS NOT NULL").withColumnRenamed("predicted_of", "policy_id").join(titles, "policy_id")
    return linked.select(*cols, F.lit("linked").alias("kind"), "title").unionByName(predicted.select(*cols, F.lit("predicted").alias("kind"), "title"))


def policy_status(policies: DataFrame, as_of: str) -> DataFrame:
    return policies.select("policy_id", F.when(F.col("rolled_out_date") <= F.lit(as_of).cast("date"), "rolled_out").otherwise("not_rolled_out").alias("policy_status"))
