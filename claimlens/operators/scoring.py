"""Claim scoring. All post-derived inputs come from one conditional aggregate over the posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import Settings
from ..functions import scoring as S
from .lineage import materialize
from .vectors import best_match

SUPPORTING, OPPOSING = "supporting", "opposing"


def _since(as_of: str, hours: float) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600:.6f})")


def _is(stance: str) -> Column:
    return F.col("stance") == stance


# --- facts: sums of posts that add up -----------------------------------------------------------

FACT_KEYS = ("claim_id", "stance", "author_id", "source", "at")
FACT_SUMS = ("n", "impressions", "negative_reactions", "positive_reactions", "outrage", "outrage_n")


def as_facts(posts: DataFrame) -> DataFrame:
    """Posts as facts of one row each."""
    return posts.filter(F.col("claim_id").isNotNull()).select(
        "claim_id", "stance", "author_id", "source", F.col("created_at").alias("at"), F.lit(1).cast("bigint").alias("n"), "impressions",
        "negative_reactions", "positive_reactions", F.col("outrage_score").alias("outrage"), F.col("outrage_score").isNotNull().cast("bigint").alias("outrage_n"))


def merged_facts(*parts: DataFrame) -> DataFrame:
    """Facts of several tables added up."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*FACT_KEYS).agg(*[F.sum(c).alias(c) for c in FACT_SUMS])


def post_facts(posts: DataFrame, bounds: tuple[Column, ...] = ()) -> DataFrame:
    """Mergeable sums per claim, stance, author, source and hour.

    Every score input is read from these: counts and sums add, distinct authors and sources are keys. `at` is the hour,
    except in an hour that one of `bounds` cuts, where it is the time itself, so that every window ending at a bound
    is exact.
    """
    hour = F.date_trunc("hour", "at")
    inside = [(b > hour) & (b < hour + F.expr("INTERVAL 1 HOUR")) for b in bounds]
    cut = reduce(lambda x, y: x | y, inside, F.lit(False))
    return merged_facts(as_facts(posts).withColumn("at", F.when(cut, F.col("at")).otherwise(hour)))


def window_bounds(as_of: str, s: Settings) -> tuple[Column, ...]:
    v, n = s.s("velocity_interval_hours"), s.s("npr_window_hours")
    return tuple(_since(as_of, h) for h in (v, 2 * v, n, 24 * s.s("reach_normalization_window_days")))


def reach_inputs(posts: DataFrame, claims: DataFrame, as_of: str, window_days: float = 90) -> DataFrame:
    return reach_of(as_facts(posts), claims, as_of, window_days)


def reach_of(facts: DataFrame, claims: DataFrame, as_of: str, window_days: float = 90) -> DataFrame:
    """Impressions, authors, posts and platforms of each claim's recent supporting posts; zeros when none.

    The two distinct counts are taken in steps (pre-aggregate by claim, author and source), so a
    claim holding a third of all posts shrinks on the map side before its rows meet in one task.
    """
    recent = facts.filter(_is(SUPPORTING) & (F.col("at") >= _since(as_of, 24 * window_days)))
    slim = recent.groupBy("claim_id", "author_id", "source").agg(F.sum("impressions").alias("impressions"), F.sum("n").alias("n"))
    per_author = slim.groupBy("claim_id", "author_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("n").alias("n"), F.collect_set("source").alias("sources")
    )
    agg = per_author.groupBy("claim_id").agg(
        F.sum("impressions").alias("impressions"),
        F.count("author_id").alias("unique_authors"),
        F.sum("n").alias("post_count"),
        F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).cast("bigint").alias("platforms"),
    )
    zero = F.lit(0).cast("bigint")
    return claims.select("claim_id").join(agg, "claim_id", "left").select(
        "claim_id",
        *[F.coalesce(c, zero).alias(c) for c in ("impressions", "unique_authors", "post_count", "platforms")],
    )


def reach_scores(posts: DataFrame, claims: DataFrame, as_of: str, s: Settings) -> DataFrame:
    return reach_scores_of(as_facts(posts), claims, as_of, s)


def reach_scores_of(facts: DataFrame, claims: DataFrame, as_of: str, s: Settings) -> DataFrame:
    """Raw reach of existing claims, scaled to 0-100 inside each topic."""
    existing = claims.filter(F.col("claim_type") == "existing")
    raw = existing.select("claim_id", "topic_id").join(
        reach_of(facts, existing, as_of, s.s("reach_normalization_window_days")), "claim_id"
    ).withColumn(
        "raw_reach", S.raw_reach(F.col("impressions"), F.col("unique_authors"), F.col("post_count"), F.col("platforms"), s)
    )
    per_topic = raw.groupBy("topic_id").agg(F.min("raw_reach").alias("lo"), F.max("raw_reach").alias("hi"))
    return raw.join(per_topic, "topic_id").select(
        "claim_id", "topic_id", "raw_reach",
        S.minmax_0_100(F.col("raw_reach"), F.col("lo"), F.col("hi")).alias("reach_score"),
    )


def post_aggregates(posts: DataFrame, as_of: str, s: Settings) -> DataFrame:
    return aggregates_of(as_facts(posts), as_of, s)


def aggregates_of(facts: DataFrame, as_of: str, s: Settings) -> DataFrame:
    """Velocity windows, pushback volumes and reaction sums per claim, in one pass over the facts."""
    v, n = s.s("velocity_interval_hours"), s.s("npr_window_hours")
    at = F.col("at")
    in_npr = at >= _since(as_of, n)

    def count_if(cond, name):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint").alias(name)

    def stance_aggs(stance, tag):
        c = _is(stance)
        of = lambda x: F.sum(F.when(c, F.col(x)))
        return [
            (of("outrage") / F.nullif(of("outrage_n"), F.lit(0))).alias(f"outrage_{tag}"),
            of("negative_reactions").alias(f"negative_{tag}"),
            of("positive_reactions").alias(f"positive_{tag}"),
            count_if(c, f"posts_{tag}"),
        ]

    return facts.groupBy("claim_id").agg(
        count_if(_is(SUPPORTING) & (at >= _since(as_of, v)), "volume_now"),
        count_if(_is(SUPPORTING) & (at >= _since(as_of, 2 * v)) & (at < _since(as_of, v)), "volume_before"),
        count_if(_is(SUPPORTING) & in_npr, "npr_supporting"),
        count_if(_is(OPPOSING) & in_npr, "npr_opposing"),
        *stance_aggs(SUPPORTING, "sup"),
        *stance_aggs(OPPOSING, "opp"),
    )


def topic_volume(posts: DataFrame, claims: DataFrame) -> DataFrame:
    return topic_volume_of(as_facts(posts), claims)


def topic_volume_of(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """Hourly supporting posts per topic. Counted per claim first: few rows then meet the claim table."""
    hourly = facts.filter(_is(SUPPORTING)).groupBy("claim_id", F.date_trunc("hour", "at").alias("bucket_start")).agg(F.sum("n").alias("count"))
    return (
        hourly.join(claims.select("claim_id", "topic_id"), "claim_id")
        .groupBy("topic_id", "bucket_start")
        .agg(F.sum("count").alias("supporting_volume"))
    )


def velocity_baseline(volume: DataFrame) -> DataFrame:
    """Mean and population deviation of growth between neighbouring stored hours of a topic."""
    w = Window.partitionBy("topic_id").orderBy("bucket_start")
    growth = volume.withColumn("before", F.lag("supporting_volume").over(w)).withColumn(
        "growth", S.raw_velocity(F.col("supporting_volume"), F.col("before"))
    )
    enough = F.count(F.lit(1)) >= 3
    return growth.groupBy("topic_id").agg(
        F.when(enough, F.avg("growth")).otherwise(F.lit(0.0)).alias("baseline_mean"),
        F.when(enough, F.stddev_pop("growth")).otherwise(F.lit(0.0)).alias("baseline_std"),
    )


def velocity_scores(posts: DataFrame, claims: DataFrame, as_of: str, s: Settings) -> DataFrame:
    facts = as_facts(posts)
    return velocity_scores_of(facts, aggregates_of(facts, as_of, s), claims, s)


def velocity_scores_of(facts: DataFrame, agg: DataFrame, claims: DataFrame, s: Settings) -> DataFrame:
    existing = claims.filter(F.col("claim_type") == "existing").select("claim_id", "topic_id")
    agg = agg.select("claim_id", "volume_now", "volume_before")
    zero = F.lit(0).cast("bigint")
    base = velocity_baseline(topic_volume_of(facts, claims))
    return (
        existing.join(agg, "claim_id", "left").join(base, "topic_id", "left")
        .select(
            "claim_id",
            S.raw_velocity(F.coalesce("volume_now", zero), F.coalesce("volume_before", zero), s.s("velocity_epsilon")).alias("raw_velocity"),
            F.coalesce("baseline_mean", F.lit(0.0)).alias("m"), F.coalesce("baseline_std", F.lit(0.0)).alias("sd"),
        )
        .select(
            "claim_id", "raw_velocity",
            S.velocity_score(F.col("raw_velocity"), F.col("m"), F.col("sd"), s.s("velocity_zscore_min"), s.s("velocity_zscore_max")).alias("velocity_score"),
        )
    )


def falseness_scores(claims: DataFrame, corpus: DataFrame, s: Settings, verdicts: DataFrame | None = None) -> DataFrame:
    """Top similarity to the debunk corpus; below the threshold the fixed verdict score, else NULL."""
    existing = claims.filter(F.col("claim_type") == "existing").select("claim_id", "embedding")
    best = best_match(existing, "claim_id", corpus, "source_id")
    out = existing.select("claim_id").join(best, "claim_id", "left").withColumn(
        "corpus_score", S.falseness(F.col("similarity"), s.s("falseness_match_threshold"))
    )
    if verdicts is None:
        return out.select("claim_id", "similarity", F.col("corpus_score").alias("falseness_score"))
    return out.join(verdicts.select("claim_id", "false_verdict"), "claim_id", "left").select(
        "claim_id", "similarity",
        F.coalesce("corpus_score", F.when(F.col("false_verdict"), F.lit(float(s.s("falseness_live_match_score"))))).alias("falseness_score"),
    )


def harm_scores(claims: DataFrame, s: Settings) -> DataFrame:
    parts = [F.coalesce(c, F.lit(0.0)) for c in HARM_PARTS]
    return claims.withColumn("harm_score", S.harm(*parts, s))


HARM_PARTS = ("harm_public_safety", "harm_institutional_trust", "harm_economic", "harm_policy_disruption")


def apply_harm_overrides(claims: DataFrame, overrides: DataFrame, s: Settings) -> DataFrame:
    """Reviewer values replace only the supplied parts; the harm score is then computed again."""
    o = overrides.select("claim_id", *[F.col(c).alias("new_" + c) for c in HARM_PARTS], F.lit(True).alias("confirmed"))
    merged = claims.join(o, "claim_id", "left")
    for c in HARM_PARTS:
        merged = merged.withColumn(c, F.coalesce("new_" + c, c))
    merged = merged.withColumn("harm_confirmed", F.coalesce("confirmed", F.lit(False)))
    return harm_scores(merged.drop(*["new_" + c for c in HARM_PARTS], "confirmed"), s)


def emotional_intensity(agg: DataFrame) -> DataFrame:
    def ei(tag):
        return S.emotional_intensity(*[F.col(f"{x}_{tag}") for x in ("outrage", "negative", "positive", "posts")])

    return agg.select("claim_id", ei("sup").alias("ei_supporting"), ei("opp").alias("ei_opposing"))


def pushback(agg: DataFrame, claims: DataFrame, s: Settings) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    joined = claims.select("claim_id").join(agg, "claim_id", "left").select(
        "claim_id", F.coalesce("npr_supporting", zero).alias("supporting"), F.coalesce("npr_opposing", zero).alias("opposing")
    )
    out = joined.withColumn("npr", S.npr(F.col("supporting"), F.col("opposing")))
    return out.withColumn("is_dormant", F.col("npr").isNull()).withColumn(
        "discount_factor",
        S.discount(F.col("npr"), F.col("supporting") + F.col("opposing"), s.s("discount_gamma"), s.s("npr_reliability_minimum_posts")),
    )


def rescore(claims: DataFrame, posts: DataFrame, corpus: DataFrame, s: Settings, as_of: str,
            verdicts: DataFrame | None = None) -> DataFrame:
    """Every score of every claim. The posts are read once, into facts."""
    facts = materialize(post_facts(posts, window_bounds(as_of, s)), "facts")
    return rescore_facts(claims, facts, corpus, s, as_of, verdicts)


def rescore_facts(claims: DataFrame, facts: DataFrame, corpus: DataFrame, s: Settings, as_of: str,
                  verdicts: DataFrame | None = None) -> DataFrame:
    """Every score of every claim from a table of facts. Claims that are only predicted keep NULL scores."""
    existing = claims.filter(F.col("claim_type") == "existing")
    agg = aggregates_of(facts, as_of, s)
    zero = F.lit(0).cast("bigint")
    scored = (
        harm_scores(existing, s)
        .join(reach_scores_of(facts, existing, as_of, s).select("claim_id", "reach_score"), "claim_id", "left")
        .join(velocity_scores_of(facts, agg, claims, s).select("claim_id", "velocity_score"), "claim_id", "left")
        .join(falseness_scores(existing, corpus, s, verdicts).select("claim_id", "falseness_score"), "claim_id", "left")
        .join(agg.select("claim_id", "npr_supporting", "npr_opposing"), "claim_id", "left")
        .join(emotional_intensity(agg), "claim_id", "left")
        .withColumn("npr_supporting", F.coalesce("npr_supporting", zero))
        .withColumn("npr_opposing", F.coalesce("npr_opposing", zero))
        .withColumn("npr", S.npr(F.col("npr_supporting"), F.col("npr_opposing")))
        .withColumn("is_dormant", F.col("npr").isNull())
        .withColumn("emotional_intensity_score", F.coalesce("ei_supporting", F.lit(0.0)))
        .withColumn(
            "discount_factor",
            S.discount(F.col("npr"), F.col("npr_supporting") + F.col("npr_opposing"), s.s("discount_gamma"), s.s("npr_reliability_minimum_posts")),
        )
        .withColumn(
            "claim_score",
            S.claim_score(F.coalesce("reach_score", F.lit(0.0)), F.col("velocity_score"), F.col("falseness_score"),
                          F.coalesce("harm_score", F.lit(0.0)), F.col("emotional_intensity_score"), s),
        )
        .withColumn("final_score", S.final_score(F.col("claim_score"), F.col("discount_factor")))
        .select("claim_id", *SCORE_COLUMNS)
    )
    return claims.drop("embedding").join(scored, "claim_id", "left")


SCORE_COLUMNS = (
    "reach_score velocity_score falseness_score harm_score emotional_intensity_score ei_opposing npr is_dormant "
    "discount_factor claim_score final_score"
).split()


def score_snapshots(scored: DataFrame, as_of: str) -> DataFrame:
    return scored.filter(F.col("final_score").isNotNull()).select(
        "claim_id", "final_score", F.lit(as_of).cast("timestamp").alias("recorded_at")
    )


class FactStore:
    """Facts on disk, one folder for each batch of posts: a rescore adds them up and reads no post again.

    A batch that is delivered twice replaces its own folder. Times must be whole hours: the facts of a past hour can
    no longer be cut.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, posts: DataFrame, batch: int) -> None:
        post_facts(posts).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def facts(self) -> DataFrame:
        return merged_facts(self.spark.read.parquet(self.path).select(*FACT_KEYS, *FACT_SUMS))

    def rescore(self, claims: DataFrame, corpus: DataFrame, s: Settings, as_of: str, verdicts: DataFrame | None = None) -> DataFrame:
        hour = self.spark.sql("SELECT date_trunc('HOUR', CAST(:t AS timestamp)) = CAST(:t AS timestamp) AS whole", args={"t": as_of}).first()
        steps = (s.s("velocity_interval_hours"), s.s("npr_window_hours"), 24 * s.s("reach_normalization_window_days"))
        if not hour["whole"] or any(x != int(x) for x in steps):
            raise ValueError("stored facts are hourly: as_of and all windows have to be whole hours")
        return rescore_facts(claims, materialize(self.facts(), "facts"), corpus, s, as_of, verdicts)
