"""Landed crawl payloads (feed XML, comment JSON, channel messages, forecasts, reviews) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.ingest import newest_per_channel

FEED_ITEM = "guid string, link string, title string, description string, pubDate string"
COMMENT_THREADS = (
    "videoId string, items array<struct<id: string, snippet: struct<topLevelComment: struct<snippet: struct<"
    "textDisplay: string, authorDisplayName: string, authorChannelId: struct<value: string>, likeCount: bigint, publishedAt: string>>>>>"
)
FORECAST = (
    "lokasi struct<kecamatan: string, kotkab: string>, "
    "data array<struct<cuaca: array<array<struct<weather_desc: string>>>>>"
)
REVIEWS = "array<struct<claimReview: array<struct<textualRating: string>>>>"


def read_feed_xml(spark: SparkSession, path: str, feed: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)
    published = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return raw.select(F.lit(feed).alias("feed"), F.col("guid").alias("id"), "link", "title", F.col("description").alias("summary"), published.alias("published"))


def rss_candidates(items: DataFrame, as_of: str) -> DataFrame:
    """Feed items (feed, id, link, title, summary, published) as candidates; popularity = 10 per copy of the title - age in hours."""
    blank = F.lit("")
    key = F.lower(F.trim(T.strip_html(F.coalesce("title", blank))))
    rows = items.withColumn("k", key)
    copies = rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    now = F.lit(as_of).cast("timestamp")
    at = F.coalesce("published", now)
    age = F.greatest((F.unix_micros(now) - F.unix_micros(at)) / 3.6e9, F.lit(0.0))
    title, summary = T.strip_html(F.coalesce("title", blank)), T.strip_html(F.coalesce("summary", blank))
    filled = lambda c: F.nullif(F.col(c), blank)
    return rows.join(copies, "k").select(
        F.trim(F.concat(title, F.lit(". "), summary)).alias("text"), F.lit("rss").alias("source"), F.lit(None).cast("string").alias("author_id"),
        F.lit(None).cast("string").alias("location"),
        F.concat(F.lit("rss:"), "feed", F.lit(":"), F.coalesce(filled("id"), filled("link"), title)).alias("external_ref"),
        at.alias("created_at"), (F.col("copies") * 10 - age).alias("popularity_score"))


def comment_candidates(threads: DataFrame, as_of: str) -> DataFrame:
    """Comment threads (one JSON text per row in `payload`) as candidates; blank comments are dropped."""
    t = threads.select(F.from_json("payload", COMMENT_THREADS).alias("p")).select(F.col("p.videoId").alias("video"), F.explode("p.items").alias("i"))
    top = "i.snippet.topLevelComment.snippet."
    text = F.trim(F.col(top + "textDisplay"))
    author = F.coalesce(F.nullif(F.col(top + "authorChannelId.value"), F.lit("")), F.col(top + "authorDisplayName"))
    return t.filter(F.coalesce(text, F.lit("")) != "").select(
        text.alias("text"), F.lit("social").alias("source"), author.alias("author_id"), F.lit(None).cast("string").alias("location"),
        F.concat_ws(":", F.lit("youtube"), "video", "i.id").alias("external_ref"),
        F.coalesce(F.col(top + "publishedAt").cast("timestamp"), F.lit(as_of).cast("timestamp")).alias("created_at"),
        F.coalesce(F.col(top + "likeCount"), F.lit(0)).cast("double").alias("popularity_score"))


def message_candidates(messages: DataFrame, as_of: str, window_hours: float = 6.0, per_channel: int | None = None) -> DataFrame:
    """Channel messages (channel, id, date, text, views, forwards) of the window with text; per_channel keeps the newest only."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {window_hours * 3600:.6f})")
    newest = messages if per_channel is None else newest_per_channel(messages, "channel", "date", "id", per_channel)
    return newest.filter((F.col("date") >= since) & (F.coalesce("text", F.lit("")) != "")).select(
        "text", F.lit("social").alias("source"), F.col("channel").alias("author_id"), F.lit(None).cast("string").alias("location"),
        F.concat_ws(":", F.lit("telegram"), "channel", F.col("id").cast("string")).alias("external_ref"), F.col("date").alias("created_at"),
        (F.coalesce("views", F.lit(0)) + F.coalesce("forwards", F.lit(0)) * 5).cast("double").alias("popularity_score"))


def debunk_corpus(items: DataFrame, stored_urls: DataFrame) -> DataFrame:
    """Labelled hoax items (title, link, description) not stored yet: title, content and url of corpus rows."""
    claim = F.trim(F.regexp_replace(F.trim("title"), T.HOAX_PREFIX, ""))
    link = F.trim(F.coalesce("link", F.lit("")))
    kept = items.filter(F.trim("title").rlike(T.HOAX_PREFIX)).select(
        claim.alias("claim"), link.alias("source_url"), T.strip_html(F.coalesce("description", F.lit("")), entities=True).alias("d"))
    fresh = kept.join(stored_urls.select("source_url").distinct(), "source_url", "left_anti")
    return fresh.select(F.col("claim").alias("title"), F.coalesce(F.nullif("d", F.lit("")), "claim").alias("content"), F.nullif("source_url", F.lit("")).alias("source_url"))


def hazard_lines(forecasts: DataFrame, key: str) -> DataFrame:
    """One text line per place from all blocks and entries of a forecast JSON text in `payload`; places without data give none."""
    f = forecasts.select(key, F.from_json("payload", FORECAST).alias("p")).filter(F.size("p.data") > 0)
    days = F.flatten(F.array_compact(F.transform("p.data", lambda b: b["cuaca"])))
    entries = F.flatten(F.array_compact(days))
    found = F.array_distinct(F.filter(F.transform(entries, lambda e: e["weather_desc"]), lambda d: T.contains_any(d, T.HAZARD_WORDS)))
    place = F.concat(F.coalesce("p.lokasi.kecamatan", F.lit("?")), F.lit(", "), F.coalesce("p.lokasi.kotkab", F.lit("?")))
    # The sentences of a line.
    tail = F.when(F.size("h") > 0, F.concat(F.array_join("h", ", "), F.lit(" forecast in the next ~24h."))).otherwise("no significant weather hazard forecast in the next ~24h.")
    return f.select(key, place.alias("place"), found.alias("h")).select(key, F.concat(F.lit("- [BMKG] "), "place", F.lit(": "), tail).alias("line"))


def false_verdict(reviews: Column) -> Column:
    """True when any rating of a reviews JSON text reads as false."""
    parsed = F.from_json(reviews, REVIEWS)
    hit = lambda r: T.contains_any(F.coalesce(r["textualRating"], F.lit("")), T.FALSE_RATING_WORDS)
    return F.coalesce(F.exists(parsed, lambda c: F.coalesce(F.exists(c["claimReview"], hit), F.lit(False))), F.lit(False))
