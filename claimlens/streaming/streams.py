"""Structured Streaming forms of ingest, topic volume, pushback and burst bins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.formation import attach_to_claims
from ..operators.lineage import materialize, new_path
from ..operators.scoring import FactStore
from ..sources.schemas import LANDED, MODEL


def read_stream(spark: SparkSession, path: str, name: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDED.get(name) or MODEL[name])
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start(df: DataFrame, each, mode: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def upsert_to(path: str):
    """foreachBatch sink that appends each batch's rows under its number; re-delivered batches replace themselves."""
    def write(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

    return write


def latest(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The newest row of every key in a folder written by upsert_to."""
    rows = spark.read.schema(schema + ", batch int").parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch")


HOUR, MINUTE = 3_600_000, 60_000  # milliseconds


def _timed(posts: DataFrame, delay: str) -> DataFrame:
    """posts with a watermark and with the time in milliseconds, which state functions count in; no time is the oldest."""
    return posts.withWatermark("created_at", delay).withColumn("_ms", F.coalesce(F.unix_millis("created_at"), F.lit(0)))


REF_BUCKETS = 512  # keys of the state of refs; a call of Python serves a bucket, not a ref


def first_refs(posts: DataFrame, delay_hours: int = 24) -> DataFrame:
    """Posts with a ref that was not seen before: per ref the smallest post_id of the batch it first comes in.

    Keyed state remembers a ref until the watermark is `delay_hours` past its last sight, so repeats are skipped
    without reading what was stored, and the state holds refs of that time only. Refs lie in buckets by hash, and the
    timer of a bucket stands where its first ref may be forgotten.
    """
    timed = _timed(posts.filter("external_ref IS NOT NULL"), f"{delay_hours} hours").withColumn("_bucket", F.pmod(F.xxhash64("external_ref"), F.lit(REF_BUCKETS)))
    names, span = posts.columns, delay_hours * HOUR

    def keep(key, frames, state):
        mark = state.getCurrentWatermarkMs()
        refs, times = state.get if state.exists else ([], [])
        seen = {r: t for r, t in zip(refs, times) if t + span > mark}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            fresh = rows[~rows["external_ref"].isin(seen)].sort_values("post_id").drop_duplicates("external_ref")
            if len(fresh):
                yield fresh[names]
            for r, t in rows.groupby("external_ref")["_ms"].max().items():
                seen[r] = max(int(t), seen.get(r, 0))
        if not seen:
            state.remove()
            return
        state.update((list(seen), list(seen.values())))
        state.setTimeoutTimestamp(max(min(seen.values()) + span, mark + 1))

    return timed.groupBy("_bucket").applyInPandasWithState(keep, posts.schema, "refs array<string>, times array<bigint>", "append", "EventTimeTimeout")


def unique_posts(posts: DataFrame, delay_hours: int = 24) -> DataFrame:
    """Idempotent ingest: posts with a ref are kept once, posts without one all pass."""
    return first_refs(posts, delay_hours).unionByName(posts.filter("external_ref IS NULL"))


def pushback_now(posts: DataFrame, hours: int = 24, delay: str = "2 hours") -> DataFrame:
    """(claim_id, at, supporting, opposing, is_dormant): the volumes of a claim's last `hours`, given out when they change.

    State holds a claim's counts by hour, at most `hours` + 1 of them and those ahead of the watermark. A timer stands
    where the oldest hour leaves the window: volumes fall, and a claim goes dormant, as time passes without a new post.
    """
    timed = _timed(posts.filter("claim_id IS NOT NULL AND created_at IS NOT NULL AND stance IN ('supporting', 'opposing')").select("claim_id", "stance", "created_at"), delay)
    span = hours * HOUR

    def count(key, frames, state):
        bins = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        if state.hasTimedOut:
            at = state.getCurrentWatermarkMs()
        else:
            rows = pd.concat(list(frames))
            for h, side in zip((rows["_ms"] // HOUR * HOUR).tolist(), rows["stance"].tolist()):
                s, o = bins.get(h, (0, 0))
                bins[h] = (s + (side == "supporting"), o + (side == "opposing"))
            at = max(max(bins) + HOUR, state.getCurrentWatermarkMs())
        bins = {h: c for h, c in bins.items() if h + HOUR + span > at}
        sup, opp = sum(s for s, _ in bins.values()), sum(o for _, o in bins.values())
        yield pd.DataFrame({"claim_id": [key[0]], "ms": [at], "supporting": [sup], "opposing": [opp], "is_dormant": [not bins]})
        if not bins:
            state.remove()
            return
        at_hours = sorted(bins)
        state.update((at_hours, [bins[h][0] for h in at_hours], [bins[h][1] for h in at_hours]))
        state.setTimeoutTimestamp(max(at_hours[0] + HOUR + span, state.getCurrentWatermarkMs() + 1))

    rows = timed.groupBy("claim_id").applyInPandasWithState(
        count, "claim_id bigint, ms bigint, supporting bigint, opposing bigint, is_dormant boolean",
        "hours array<bigint>, supporting array<bigint>, opposing array<bigint>", "update", "EventTimeTimeout")
    return rows.select("claim_id", F.timestamp_millis("ms").alias("at"), "supporting", "opposing", "is_dormant")


def burst_updates(posts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(claim_id, bin_start, post_count, bins, zscore, is_anomalous): every minute bin once it is closed, against the
    claim's bins up to and with it.

    State holds the open bins and the number, sum and squares of the closed ones. A bin closes when the watermark passes
    its end, by a new post or by a timer; closed bins are given out in the batch that closes them.
    """
    timed = _timed(posts.filter("claim_id IS NOT NULL AND created_at IS NOT NULL AND stance = 'supporting'").select("claim_id", "created_at"), delay)

    def close(key, frames, state):
        starts, counts, n, total, squares = state.get if state.exists else ([], [], 0, 0, 0)
        open_ = dict(zip(starts, counts))
        if not state.hasTimedOut:
            for frame in frames:
                for b, c in (frame["_ms"] // MINUTE * MINUTE).value_counts().items():
                    open_[int(b)] = open_.get(int(b), 0) + int(c)
        mark, out = state.getCurrentWatermarkMs(), []
        for b in sorted(open_):
            if b + MINUTE > mark:
                break
            c = open_.pop(b)
            n, total, squares = n + 1, total + c, squares + c * c
            mean = total / n
            sd = max(squares / n - mean * mean, 0.0) ** 0.5
            out.append((key[0], b, c, n, round((c - mean) / sd, 4) if sd > 0 else 0.0, bool(c > mean + 3 * sd)))
        if out:
            yield pd.DataFrame(out, columns=["claim_id", "ms", "post_count", "bins", "zscore", "is_anomalous"])
        state.update((sorted(open_), [open_[b] for b in sorted(open_)], n, total, squares))
        if open_:
            state.setTimeoutTimestamp(max(min(open_) + MINUTE, mark + 1))

    rows = timed.groupBy("claim_id").applyInPandasWithState(
        close, "claim_id bigint, ms bigint, post_count bigint, bins bigint, zscore double, is_anomalous boolean",
        "starts array<bigint>, counts array<bigint>, n bigint, total bigint, squares bigint", "append", "EventTimeTimeout")
    return rows.select("claim_id", F.timestamp_millis("ms").alias("bin_start"), "post_count", "bins", "zscore", "is_anomalous")


def topic_volume(posts: DataFrame, claims: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Hourly supporting posts per topic; late rows inside the watermark update their own hour."""
    return (
        posts.filter("stance = 'supporting' AND claim_id IS NOT NULL").withWatermark("created_at", delay)
        .join(claims.select("claim_id", "topic_id"), "claim_id")
        .groupBy(F.window("created_at", "1 hour").alias("w"), "topic_id").agg(F.count(F.lit(1)).alias("supporting_volume"))
        .select("topic_id", F.col("w.start").alias("bucket_start"), "supporting_volume"))


def pushback(posts: DataFrame, delay: str = "2 hours", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Supporting and opposing posts per claim in sliding windows; volumes fall as time passes without new posts."""
    return (
        posts.filter("claim_id IS NOT NULL AND stance IN ('supporting', 'opposing')").withWatermark("created_at", delay)
        .groupBy(F.window("created_at", length, slide).alias("w"), "claim_id")
        .agg(F.count(F.when(F.col("stance") == "supporting", 1)).alias("supporting"), F.count(F.when(F.col("stance") == "opposing", 1)).alias("opposing"))
        .select("claim_id", F.col("w.end").alias("window_end"), "supporting", "opposing"))


def minute_bins(posts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return (
        posts.filter("claim_id IS NOT NULL AND stance = 'supporting'").withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 minute").alias("w"), "claim_id").agg(F.count(F.lit(1)).alias("post_count"))
        .select("claim_id", F.col("w.start").alias("bin_start"), "post_count"))


def burst_scores(bins: DataFrame) -> DataFrame:
    """z-score of every non-empty bin of a claim against the claim's own bins."""
    stats = bins.groupBy("claim_id").agg(F.avg("post_count").alias("mean"), F.stddev_pop("post_count").alias("sd"))
    z = F.when(F.col("sd") > 0, F.round((F.col("post_count") - F.col("mean")) / F.col("sd"), 4)).otherwise(0.0)
    return bins.join(stats, "claim_id").select("claim_id", "bin_start", "post_count", z.alias("zscore"), (F.col("post_count") > F.col("mean") + 3 * F.col("sd")).alias("is_anomalous"))


def run_updates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregating stream over what is available and return its newest values as a table."""
    spark = df.sparkSession
    out, state = new_path(spark, name), new_path(spark, name + "-state")
    start(df, upsert_to(out), "update", state).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return latest(spark, out, keys, schema)


def run_append(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into a parquet table, every row it gives out."""
    spark = df.sparkSession
    out, state = new_path(spark, name), new_path(spark, name + "-state")
    start(df, upsert_to(out), mode, state).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


STORED = "post_id bigint, external_ref string, created_at timestamp, claim_id bigint"


def ingest_to(path: str, vectors: DataFrame, claims: DataFrame, threshold: float, facts: FactStore | None = None, texts: DataFrame | None = None):
    """foreachBatch sink: attach posts to claims, write them under the batch number, and add their facts.

    Posts come without repeats, so nothing stored is read. A batch delivered twice replaces its own rows and facts.
    Where texts are given, the stance of an attached post is labelled from its text.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "batch")
        best = attach_to_claims(batch, vectors, claims, threshold).select("post_id", F.col("claim_id").alias("found"))
        rows = batch.join(best, "post_id", "left")
        if texts is not None:
            said = F.when(F.col("claim_id").isNull() & F.col("found").isNotNull(), T.stance(F.col("text"))).otherwise(F.col("stance"))
            rows = rows.join(texts.select("doc_id", "text"), "doc_id", "left").withColumn("stance", said).drop("text")
        rows = materialize(rows.withColumn("claim_id", F.coalesce("claim_id", "found")).drop("found"), "ingested")
        upsert_to(path)(rows.select("post_id", "external_ref", "created_at", "claim_id"), number)
        if facts is not None:
            facts.add(rows, number)

    return write


def run_ingest(posts: DataFrame, vectors: DataFrame, claims: DataFrame, threshold: float = 0.55, delay_hours: int = 24,
               facts: FactStore | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Ingest what is available; returns the stored posts."""
    spark = posts.sparkSession
    out, state = new_path(spark, "ingest"), new_path(spark, "ingest-state")
    start(unique_posts(posts, delay_hours), ingest_to(out, vectors, claims, threshold, facts, texts), "append", state).awaitTermination()
    return spark.read.schema(STORED).parquet(out).drop("batch")
