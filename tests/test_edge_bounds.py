"""Pairs that cannot be edges are left out where they are met; what is left gives the same edges."""

import datetime as dt
import random

from pyspark.sql import functions as F

from claimlens.operators import pairs
from claimlens.operators import signals as N
from claimlens.operators.fusion import strong_edges

T0 = dt.datetime(2026, 1, 1)
ACCOUNTS = "account_id string, handle string, created_at_platform timestamp, profile_hash string, bio string, declared_location string, client_app string"


def made(spark):
    rng = random.Random(23)
    pick = lambda *xs: rng.choice(xs)
    names = [f"u{i}" for i in range(70)]
    accounts = [(n, pick(None, "", f"abc_w{i % 7:02d}", f"xy{i}", f"abcd_w{i:03d}"), pick(None, T0 + dt.timedelta(hours=rng.randrange(60))), pick(None, "zz", "ab" * 8, "a" * 40, f"{i:016x}"),
                 pick(None, "", "local voice of the town", f"watcher {i % 4}"), pick(None, "Here", "There"), pick(None, "app", "web")) for i, n in enumerate(names[:-2])]
    posts = [(i % 2, rng.choice(names), T0 + dt.timedelta(hours=rng.randrange(40)), pick(None, f"p{rng.randrange(5)}"), None, None, pick(None, f"http://s/{rng.randrange(9)}"), pick(None, "s"), i % 60) for i in range(420)]
    frame = spark.createDataFrame(posts, "claim_id int, account_id string, created_at timestamp, reshared_post_id string, quoted_post_id string, replied_to_post_id string, outbound_url string, outbound_domain string, text_id int")
    follows = [(n, f) for n in names for f in range(25) if rng.random() < 0.3]
    return frame, spark.createDataFrame(accounts, ACCOUNTS), spark.createDataFrame(follows, "account_id string, follows int")


def test_bounds_lose_no_edge(spark):
    posts, accounts, followers = made(spark)
    candidates, eligible = posts.select("claim_id", "account_id").distinct(), posts.filter("text_id < 40")
    links = spark.createDataFrame([(1, 2), (5, 9), (9, 11)], "text_a int, text_b int")
    weights, theta, s = {"w_time": 0.30, "w_text": 0.25, "w_amp": 0.20, "w_meta": 0.15, "w_struct": 0.10}, 0.30, 0.25
    bounds = N.EdgeBounds(N.edge_traits(posts, eligible, candidates, accounts, 3600), weights, theta, s, 36.0)
    met = {}

    def edges(b):
        met[b is None] = report = {}
        families = [N.TimeFamily(posts, 3600, 0.01, b), N.TextFamily(eligible, links), N.AmpFamily(posts, b), N.StructFamily(candidates, followers, b)]
        return {tuple(r) for r in strong_edges(families, lambda p: N.w_meta(p, accounts), weights, theta, 2, s, report).collect()}

    whole = edges(None)
    assert len(whole) > 20 and edges(bounds) == whole
    assert all(met[False][f]["met"] < met[True][f]["met"] for f in ("w_amp", "w_struct"))


def test_similarity_is_never_over_its_bound(spark):
    posts, accounts, _ = made(spark)
    candidates = posts.select("claim_id", "account_id").distinct()
    both = candidates.withColumnRenamed("account_id", "a").join(candidates.withColumnRenamed("account_id", "b"), "claim_id").filter("a < b")
    score = {(r.claim_id, r.a, r.b): r.score for r in N.w_meta(both, accounts).collect()}
    traits = N.edge_traits(posts, posts, candidates, accounts, 3600).toPandas().set_index(["g", "e"])
    keys = [(r.claim_id, r.a, r.b) for r in both.collect()]
    most = N.similarity_bound(traits.loc[[(g, a) for g, a, _ in keys]], traits.loc[[(g, b) for g, _, b in keys]], 36.0)
    assert len(keys) > 4000 and all(score.get(k, 0.0) <= m for k, m in zip(keys, most))


def test_rows_go_to_a_bounded_number_of_blocks(spark):
    size = lambda n: spark.range(1).select(pairs._blocks_of(F.lit(n))).first()[0]
    assert [size(n) for n in (1, 2048, 2049, 16_384, 131_072, 350_000)] == [1, 1, 2, 8, 8, 22]


def test_marks_of_bins_leave_out_pairs_with_too_few_in_common(spark):
    hours = {"a": range(12), "b": [0, *range(20, 31)], "c": [*range(6), *range(40, 46)]}  # 12 posts each; a shares 1 bin with b, 6 with c
    none = (None,) * 5
    posts = spark.createDataFrame([(1, n, T0 + dt.timedelta(hours=h), *none) for n, hs in hours.items() for h in hs],
                                  "claim_id int, account_id string, created_at timestamp, reshared_post_id string, quoted_post_id string, replied_to_post_id string, outbound_url string, outbound_domain string")
    candidates = posts.select("claim_id", "account_id").distinct()
    traits = N.edge_traits(posts, posts, candidates, spark.createDataFrame([], ACCOUNTS), 3600)
    t = traits.toPandas().set_index("e")
    wanted = N.EdgeBounds(None, {}, 0.3, 0.25, 36.0).time_rule(0.25)(t.loc[["a", "a"]], t.loc[["b", "c"]], None)
    assert t["plain_bins"].all() and wanted.tolist() == [False, True]
