"""Metrics of detected groups. Inputs: members (network_id, claim_id, account_id) and the posts of the
members on that claim (network_id, claim_id, account_id, post_id, created_at, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.provenance import HANDLE_TEMPLATE
from .lineage import materialize
from .ranks import chunked_rank, gaps
from .vectors import mean_of

SIGMAS = 3
MAX_POSTS_PER_DAY = 50.0
# Weights of the composite and the breadth threshold.
COMPOSITE = {"sy": 0.25, "du": 0.25, "co": 0.20, "pr": 0.15, "au": 0.15}
FAMILY_AT = 50.0


def network_posts(posts: DataFrame, members: DataFrame) -> DataFrame:
    return posts.join(members.select("network_id", "claim_id", "account_id"), ["claim_id", "account_id"])


def time_bins(posts: DataFrame, seconds: int = 60) -> DataFrame:
    """Non-empty bins with their network's total, z-score against its bins, and whether they lie beyond SIGMAS deviations.

    Both follow from whole numbers (n bins, their sum and sum of squares), so a bin at exactly SIGMAS deviations is never
    beyond it, and no value depends on the order of rows.
    """
    bins = posts.groupBy("network_id", F.floor(F.unix_seconds("created_at") / seconds).alias("bin")).agg(F.count(F.lit(1)).alias("post_count"))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    stats = bins.groupBy("network_id").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("post_count").alias("total"), F.sum(F.col("post_count") * F.col("post_count")).alias("squares"))
    j = bins.join(stats, "network_id").withColumn("above", whole("bins") * whole("post_count") - whole("total")).withColumn(
        "spread", whole("bins") * whole("squares") - whole("total") * whole("total"))
    above, spread = F.col("above"), F.col("spread")
    z = F.when(spread > 0, above.cast("double") / F.sqrt(spread.cast("double"))).otherwise(0.0)
    small = lambda c: c.cast("decimal(19,0)")
    beyond = (above > 0) & (small(above) * small(above) > SIGMAS * SIGMAS * spread)
    return j.select("network_id", "bin", "post_count", "total", z.alias("z"), beyond.alias("is_anomalous"))


def burst_share(posts: DataFrame, seconds: int = 60) -> DataFrame:
    return time_bins(posts, seconds).groupBy("network_id").agg(
        F.sum(F.when(F.col("is_anomalous"), F.col("post_count")).otherwise(0)).alias("posts_in_burst"), F.max("total").alias("total_posts"))


def member_pair_mean(w_time: DataFrame) -> DataFrame:
    """w_time: (network_id, a, b, score) of the pairs inside networks."""
    return w_time.groupBy("network_id").agg(F.avg("score").alias("mean_w_time"))


def synchrony(posts: DataFrame, w_time: DataFrame, seconds: int = 60) -> DataFrame:
    return burst_share(posts, seconds).join(member_pair_mean(w_time), "network_id", "left").select(
        "network_id", "posts_in_burst", "total_posts",
        (60 * F.coalesce("mean_w_time", F.lit(0.0)) + 40 * F.col("posts_in_burst") / F.col("total_posts")).alias("sy"))


def duplicated_posts(eligible: DataFrame, links: DataFrame) -> DataFrame:
    """(network_id, text_id, is_dup): a text is duplicated when two posts carry it or a similar text is present."""
    n = eligible.groupBy("network_id", "text_id").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select(F.col("text_a").alias("text_id"), F.col("text_b").alias("other")).unionByName(
        links.select(F.col("text_b").alias("text_id"), F.col("text_a").alias("other")))
    similar = n.join(ends, "text_id").join(n.select("network_id", F.col("text_id").alias("other")), ["network_id", "other"]).select("network_id", "text_id").distinct().withColumn("s", F.lit(True))
    return n.join(similar, ["network_id", "text_id"], "left").select("network_id", "text_id", "n", (F.coalesce("s", F.lit(False)) | (F.col("n") > 1)).alias("is_dup"))


def duplication(posts: DataFrame, eligible: DataFrame, links: DataFrame) -> DataFrame:
    dup = duplicated_posts(eligible, links).filter("is_dup").groupBy("network_id").agg(F.sum("n").alias("d"))
    total = posts.groupBy("network_id").agg(F.count(F.lit(1)).alias("total_posts"))
    d = F.coalesce("d", F.lit(0).cast("bigint"))
    return total.join(dup, "network_id", "left").select("network_id", d.alias("duplicated_posts"), "total_posts", (100 * d / F.col("total_posts")).alias("du"))


def cohesion(shape: DataFrame) -> DataFrame:
    return shape.withColumn("co", 100 * (1 - F.col("conductance")))


def _member_accounts(members: DataFrame, accounts: DataFrame) -> DataFrame:
    return members.select("network_id", "account_id").join(accounts, "account_id", "left")


def tightest_window(members: DataFrame, accounts: DataFrame, hours: float = 36) -> DataFrame:
    """Largest share of known creation times inside one window; NULL under two of them."""
    t = _member_accounts(members, accounts).filter("created_at_platform IS NOT NULL").withColumn("t", F.unix_micros("created_at_platform"))
    # time is cut into pieces as wide as the window; a member also stands in the piece before its own, where it only counts
    width = int(hours * 3600 * 1_000_000)
    piece = F.floor(F.col("t") / width)
    places = F.array(F.struct(piece.alias("piece"), F.lit(True).alias("own")), F.struct((piece - 1).alias("piece"), F.lit(False).alias("own")))
    t = t.select("network_id", "t", F.explode(places).alias("p")).select("network_id", "t", "p.*")
    w = Window.partitionBy("network_id", "piece").orderBy("t").rangeBetween(0, width)
    return t.withColumn("inside", F.count(F.lit(1)).over(w)).filter("own").groupBy("network_id").agg(
        F.max("inside").alias("in_window"), F.count(F.lit(1)).alias("known")).withColumn(
        "window_share", F.when(F.col("known") >= 2, F.col("in_window") / F.col("known")))


def template_and_image_share(members: DataFrame, accounts: DataFrame) -> DataFrame:
    """Shares of members whose handle template or profile hash is held by at least two members."""
    m = _member_accounts(members, accounts)
    h = F.lower("handle")
    prefix, digits = F.regexp_extract(h, HANDLE_TEMPLATE, 1), F.char_length(F.regexp_extract(h, HANDLE_TEMPLATE, 3))
    size = m.groupBy("network_id").agg(F.count(F.lit(1)).alias("members"))
    templates = m.filter(h.rlike(HANDLE_TEMPLATE)).groupBy("network_id", prefix.alias("p"), digits.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    t = templates.filter("n >= 2").groupBy("network_id").agg(F.sum("n").alias("t"))
    images = m.filter(F.coalesce("profile_hash", F.lit("")) != "").groupBy("network_id", "profile_hash").agg(F.count(F.lit(1)).alias("n"))
    i = images.filter("n >= 2").groupBy("network_id").agg(F.sum("n").alias("i"))
    zero = F.lit(0)
    return size.join(t, "network_id", "left").join(i, "network_id", "left").select(
        "network_id", "members", (F.coalesce("t", zero) / F.col("members")).alias("template_share"), (F.coalesce("i", zero) / F.col("members")).alias("image_share"))


def age_percentile_inverted(members: DataFrame, accounts: DataFrame, baseline: DataFrame, as_of: str) -> DataFrame:
    """1 - share of baseline ages not above the network's upper-median age. baseline: (age_hours).

    The baseline is counted per day of age and summed up once; only the day holding a median is
    looked at value by value, by equality on the day.
    """
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at_platform")) / 3.6e9
    ages = _member_accounts(members, accounts).filter("created_at_platform IS NOT NULL").select("network_id", "account_id", age.alias("age"))
    ranked = chunked_rank(ages, ["network_id"], ["age", "account_id"], F.floor("age"))
    median = ranked.filter(F.col("rn") == F.floor(F.col("group_rows") / 2) + 1).select("network_id", "age")
    values = baseline.filter("age_hours IS NOT NULL").groupBy("age_hours").agg(F.count(F.lit(1)).alias("n")).withColumn("d", F.floor(F.col("age_hours") / 24))
    m = median.withColumn("d", F.floor(F.col("age") / 24))
    # running total over whole days (some ten thousand at most); days holding a median take part with 0
    days = m.select("d", F.lit(0).cast("bigint").alias("n")).unionByName(values.select("d", "n")).groupBy("d").agg(F.sum("n").alias("n"))
    before = days.select("d", (F.sum("n").over(Window.orderBy("d")) - F.col("n")).alias("day_before"))
    total = baseline.agg(F.count("age_hours")).scalar()
    same = m.join(values, "d").filter(F.col("age_hours") <= F.col("age")).groupBy("network_id").agg(F.sum("n").alias("same_day"))
    rank = (F.col("day_before") + F.coalesce("same_day", F.lit(0))) / total
    return m.join(before, "d").join(same, "network_id", "left").select("network_id", (1 - rank).alias("age_inverted")).filter("age_inverted IS NOT NULL")


def provenance_anomaly(members: DataFrame, accounts: DataFrame, as_of: str, baseline: DataFrame | None = None) -> DataFrame:
    parts = template_and_image_share(members, accounts).join(tightest_window(members, accounts), "network_id", "left")
    age = F.lit(None).cast("double")
    if baseline is not None:
        parts = parts.join(age_percentile_inverted(members, accounts, baseline, as_of), "network_id", "left")
        age = F.col("age_inverted")
    mean = mean_of([F.col("window_share"), F.col("template_share"), F.col("image_share"), age])
    two = F.col("known") >= 2
    return parts.select(
        "network_id", F.when(two, F.col("in_window")).otherwise(F.lit(0)).cast("bigint").alias("in_window"),
        F.when(two, F.col("known")).otherwise(F.lit(0)).cast("bigint").alias("known"), (100 * F.coalesce(mean, F.lit(0.0))).alias("pr"))


def interpost_regularity(posts: DataFrame, keys=("network_id", "account_id")) -> DataFrame:
    """1 - normalised entropy of the gaps in at most ten equal bins; all equal 1; no row under three posts."""
    keys = list(keys)
    g = gaps(posts, keys)
    span = g.groupBy(*keys).agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.count(F.lit(1)).alias("m")).filter("m >= 2")
    bins = F.least(F.lit(10), F.col("m"))
    # all-equal groups keep lo = hi and fall into one bin
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("gap") - F.col("lo")) / width), bins - 1)).otherwise(F.lit(0))
    counts = g.join(span, keys).groupBy(*keys, "lo", "hi", "m", slot.alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.col("m")
    h = counts.groupBy(*keys, "lo", "hi", "m").agg((-F.sum(p * F.log(p))).alias("h"))
    return h.select(*keys, F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(1 - F.col("h") / F.log(bins)).alias("regularity"))


def activity_parts(posts: DataFrame, window_hours: float) -> DataFrame:
    """Clock coverage, posting rate and reshare share per member."""
    days = max(window_hours / 24, 1 / 24)
    hourly = posts.groupBy("network_id", "account_id", F.hour("created_at").alias("hr")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.coalesce("is_native_reshare", F.lit(False)) | F.col("reshared_post_id").isNotNull(), 1)).alias("r"))
    return hourly.groupBy("network_id", "account_id").agg(
        F.sum("n").alias("posts"), (F.count(F.lit(1)) / 24).alias("circadian"),
        F.least(F.sum("n") / days / MAX_POSTS_PER_DAY, F.lit(1.0)).alias("rate"), (F.sum("r") / F.sum("n")).alias("reshare_ratio"))


def automation(members: DataFrame, posts: DataFrame, window_hours: float) -> DataFrame:
    """Mean over the members of the mean of their available parts; a member without posts has three zeros."""
    zero = F.lit(0.0)
    m = members.select("network_id", "account_id").join(activity_parts(posts, window_hours), ["network_id", "account_id"], "left").join(
        interpost_regularity(posts), ["network_id", "account_id"], "left")
    score = mean_of([F.col("regularity"), *[F.coalesce(c, zero) for c in ("circadian", "rate", "reshare_ratio")]])
    hours = posts.groupBy("network_id", F.hour("created_at").alias("hr")).agg(F.lit(1)).groupBy("network_id").agg(F.count(F.lit(1)).alias("active_hours"))
    return m.groupBy("network_id").agg((100 * F.avg(score)).alias("au")).join(hours, "network_id", "left").withColumn("active_hours", F.coalesce("active_hours", F.lit(0).cast("bigint")))


def coordination_score(sy: DataFrame, du: DataFrame, co: DataFrame, pr: DataFrame, au: DataFrame) -> DataFrame:
    """The composite and its parts at two decimals, with the raw numerators and denominators beside them.

    Each part (a row per network) is written by itself: one plan of all of them has hundreds of stages, which the driver holds at once.
    """
    sy, du, co, pr, au = (materialize(part, "metric") for part in (sy, du, co, pr, au))
    j = (
        sy.select("network_id", "sy", "posts_in_burst", "total_posts").join(du.select("network_id", "du", "duplicated_posts"), "network_id")
        .join(co.select("network_id", "co"), "network_id").join(pr.select("network_id", "pr", "in_window", "known"), "network_id")
        .join(au.select("network_id", "au", "active_hours"), "network_id"))
    total = sum((F.lit(w) * F.col(c) for c, w in COMPOSITE.items()), F.lit(0.0))
    return j.select(
        "network_id", *[F.round(c, 2).alias(c) for c in COMPOSITE],
        F.round(F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 9), 2).alias("coordination_score"),
        "posts_in_burst", "total_posts", "duplicated_posts", "in_window", "known", "active_hours")


def signal_breadth(metrics: DataFrame) -> DataFrame:
    breadth = sum((F.when(F.col(c) >= FAMILY_AT, 1).otherwise(0) for c in COMPOSITE), F.lit(0))
    return metrics.withColumn("signal_breadth", breadth)


def confidence_band(scored: DataFrame, truncated, unavailable: int = 0, high: float = 70.0, high_breadth: int = 3,
                    medium: float = 55.0, medium_breadth: int = 2) -> DataFrame:
    """scored has coordination_score and signal_breadth. A degraded run caps high at medium."""
    s, b = F.col("coordination_score"), F.col("signal_breadth")
    degraded = truncated | F.lit(unavailable >= 2)
    is_high = (s >= high) & (b >= high_breadth)
    return scored.withColumn(
        "confidence_band",
        F.when(is_high & ~degraded, "high").when(is_high | ((s >= medium) & (b >= medium_breadth)), "medium").otherwise("low"))


def allowlist_suppressed(members: DataFrame, allowlist: DataFrame, share: float = 0.60) -> DataFrame:
    m = members.join(allowlist.select("account_id").distinct().withColumn("ok", F.lit(1)), "account_id", "left")
    return m.groupBy("network_id").agg((F.count("ok") / F.count(F.lit(1)) >= share).alias("suppressed"))
