"""Streams over several batches against their batch forms."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from claimlens.config import Settings
from claimlens.operators import formation as C
from claimlens.operators import scoring as Q
from claimlens.sources.schemas import MODEL
from claimlens.streaming import streams as ST

T0 = dt.datetime(2026, 1, 1)
POST = MODEL["posts"]


def post(i, minute, claim=1, stance="supporting", ref=None, vec=None):
    return (i, i, vec, "social", f"u{i % 5}", ref, 10 + i, i % 3, 2, 0.25 * (i % 4), claim, stance, "neutral", None, None, None, None, None, False, T0 + dt.timedelta(minutes=minute))


def files(spark, tmp_path, *batches):
    """A stream that takes one file a trigger, in the order given."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, POST).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next(p for p in os.listdir(tmp_path / f"b{i}") if p.endswith(".parquet"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.link(tmp_path / f"b{i}" / part, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return ST.read_stream(spark, str(tmp_path / "in"), "posts", files_per_trigger=1)


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_refs_are_kept_once_over_batches_and_forgotten_after_their_time(spark, tmp_path):
    a = [post(1, 0, ref="x"), post(2, 1, ref="x"), post(3, 2), post(4, 3)]
    b = [post(5, 10, ref="x"), post(6, 11, ref="y")]
    c = [post(7, 60 * 24 * 4, ref="z")]
    d = [post(8, 60 * 24 * 4 + 5, ref="x"), post(9, 60 * 24 * 4 + 6, ref="z")]
    d.append((*post(20, 0, ref="none")[:-1], None))  # a ref without a time
    got = ST.run_append(ST.unique_posts(files(spark, tmp_path, a, b, c, d)), "unique")
    assert sorted(r.post_id for r in got.collect()) == [1, 3, 4, 6, 7, 8, 20]


def test_an_idle_claim_goes_dormant(spark, tmp_path):
    a = [post(1, 0, claim=1), post(2, 70, claim=1, stance="opposing"), post(3, 5, claim=2)]
    later = [[post(10 + i, m, claim=2)] for i, m in enumerate((1200, 1650, 1920, 2280))]  # watermarks 18, 25.5, 30, 36 hours
    rows = ST.run_append(ST.pushback_now(files(spark, tmp_path, a, *later)), "dormant", "update")
    one = [(r.supporting, r.opposing, r.is_dormant) for r in rows.filter("claim_id = 1").orderBy("at").collect()]
    assert one[0] == (1, 1, False) and one[-1] == (0, 0, True) and (0, 1, False) in one
    assert not rows.filter("claim_id = 2").orderBy(F.col("at").desc()).first().is_dormant


def test_bursts_come_with_the_batch_that_closes_them(spark, tmp_path):
    counts = [1, 2, 1, 1, 9, 1]
    batches, i = [], 0
    for minute, n in enumerate(counts):
        batches.append([post(i + k, minute * 30) for k in range(n)])
        i += n
    got = {r.bin_start: r for r in ST.run_append(ST.burst_updates(files(spark, tmp_path, *batches)), "bursts").collect()}
    seen = []
    for minute, n in list(enumerate(counts))[:-1]:
        seen.append(n)
        r = got[T0 + dt.timedelta(minutes=30 * minute)]
        mean = sum(seen) / len(seen)
        sd = (sum(x * x for x in seen) / len(seen) - mean * mean) ** 0.5
        assert (r.post_count, r.bins) == (n, len(seen)) and abs(r.zscore - (round((n - mean) / sd, 4) if sd else 0.0)) < 1e-4


def test_a_stream_scores_as_a_batch(spark, tmp_path):
    s = Settings.defaults()
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    claims = spark.createDataFrame([(k, "existing", f"c{k}", 1, "active", None, k, 10.0, 20.0, 30.0, 40.0, T0) for k in (1, 3)], MODEL["claims"]).join(vectors, "vec_id")
    corpus = vectors.withColumnRenamed("vec_id", "source_id")
    rows = [[post(10 * b + i, 600 * b + 40 * i, claim=[1, 3, None][i % 3], stance=["supporting", "opposing"][i % 2] if i % 3 < 2 else None, vec=1 + i % 3, ref=f"r{10 * b + i // 2}" if i % 4 else None) for i in range(9)] for b in range(3)]
    texts = spark.createDataFrame([(i, "this hoax is false" if i % 2 else "share this now") for i in range(40)], "doc_id bigint, text string")
    facts = Q.FactStore(spark, str(tmp_path / "facts"))
    stored = ST.run_ingest(files(spark, tmp_path, *rows), vectors, claims, 0.7, facts=facts, texts=texts)
    all_posts = spark.createDataFrame([r for b in rows for r in b], POST)
    first = all_posts.filter("external_ref IS NOT NULL").groupBy("external_ref").agg(F.min("post_id").alias("post_id"))
    kept = all_posts.filter("external_ref IS NULL").unionByName(all_posts.join(first, ["external_ref", "post_id"], "left_semi"))
    best = C.attach_to_claims(kept, vectors, claims, 0.7).select("post_id", F.col("claim_id").alias("found"))
    whole = kept.join(best, "post_id", "left").join(texts, "doc_id").withColumn("stance", F.when(F.col("claim_id").isNull() & F.col("found").isNotNull(), ST.T.stance(F.col("text"))).otherwise(F.col("stance")))
    whole = whole.withColumn("claim_id", F.coalesce("claim_id", "found"))
    assert {(r.post_id, r.claim_id) for r in stored.collect()} == {(r.post_id, r.claim_id) for r in whole.collect()}
    order = lambda df: rounded(df.select("claim_id", *Q.SCORE_COLUMNS))
    as_of = "2026-01-02 06:00:00"
    assert order(facts.rescore(claims, corpus, s, as_of)) == order(Q.rescore(claims, whole, corpus, s, as_of))
    with pytest.raises(ValueError, match="whole hours"):
        facts.rescore(claims, corpus, s, "2026-01-02 06:10:00")


def test_facts_of_a_cut_hour_are_exact(spark):
    posts = spark.createDataFrame([post(i, 7 * i, claim=1 + i % 2, stance=["supporting", "opposing"][i % 2]) for i in range(60)], POST)
    s = Settings.defaults(scoring__velocity_interval_hours=2.0)
    as_of = "2026-01-01 06:17:30"
    a = Q.aggregates_of(Q.post_facts(posts, Q.window_bounds(as_of, s)), as_of, s)
    b = Q.post_aggregates(posts, as_of, s)
    assert rounded(a) == rounded(b)
