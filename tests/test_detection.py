"""A planted network of six accounts among organic ones is found, and only it."""

import datetime as dt

from claimlens.config import DetectorParameters
from claimlens.plans.detection import Inputs, detect
from claimlens.sources.schemas import MODEL

T0 = dt.datetime(2026, 1, 1, 12, 0)


def post(i, author, doc, minute, claim=1, stance="supporting"):
    return (i, doc, None, "social", author, None, 10, 0, 0, 0.5, claim, stance, "neutral", "https://x.example/a" if author.startswith("bot") else None,
            "x.example" if author.startswith("bot") else None, None, None, None, False, T0 + dt.timedelta(minutes=minute))


def inputs(spark, bots=True):
    posts, texts, n = [], [], 0

    def add(author, text, minute):
        nonlocal n
        texts.append((n, text))
        posts.append(post(n, author, n, minute))
        n += 1

    if bots:
        for b in range(6):
            for k in range(4):
                add(f"bot{b}", "The new road charge is a hidden tax on every family in town" + "!" * b, 60 * k)
    for o in range(3):
        for k in range(3):
            add(f"org{o}", f"organic thought number {o * 7 + k} about {'buses trains ferries bikes'.split()[(o + k) % 4]} and weather {k * 13 + o}", 5000 + 977 * o + 61 * k * (o + 1))
    accounts = [(f"bot{b}", f"citizen_voice{b}{b}", T0 - dt.timedelta(hours=200 - b), "ab" * 8, "local voice", "Here", "app") for b in range(6)] if bots else []
    accounts += [(f"org{o}", f"person{o}", T0 - dt.timedelta(days=900 + 400 * o), None, None, None, None) for o in range(3)]
    claims = spark.createDataFrame([(1, "existing", "road charge", 1, "active", None, None, 0.0, 0.0, 0.0, 0.0, T0)], MODEL["claims"])
    return Inputs(
        posts=spark.createDataFrame(posts, MODEL["posts"]), claims=claims, texts=spark.createDataFrame(texts, "doc_id bigint, text string"),
        accounts=spark.createDataFrame(accounts, "account_id string, handle string, created_at_platform timestamp, profile_hash string, bio string, declared_location string, client_app string"))


def test_planted_network_is_found_exactly(spark):
    out = detect(inputs(spark), "2026-01-01 00:00:00", "2026-01-31 00:00:00", "2026-01-31 00:00:00", DetectorParameters(window_days=30))
    assert out["candidates"].count() == 9
    assert {r.account_id for r in out["members"].collect()} == {f"bot{b}" for b in range(6)}
    n = out["networks"].collect()
    assert len(n) == 1 and n[0].account_count == 6 and n[0].post_count == 24 and n[0].parent_network_id is None
    assert n[0].du == 100.0 and n[0].platforms == "social"
    e = out["evidence_posts"].collect()
    assert len(e) == 24 and len({r.duplicate_group for r in e}) == 1 and sum(r.is_canonical for r in e) == 1
    assert out["annex"].filter("degree_centrality = 1.0 AND eigenvector_centrality > 0.99").count() == 6
    assert out["offtopic"].count() == 0 and out["snapshot"].first().evidence_post_count == 24


def test_noise_alone_gives_no_network(spark):
    out = detect(inputs(spark, bots=False), "2026-01-01 00:00:00", "2026-01-31 00:00:00", "2026-01-31 00:00:00")
    assert out["members"].count() == 0 and out["networks"].count() == 0


def test_a_table_is_built_when_it_is_asked_for(spark, monkeypatch):
    from claimlens.plans import detection

    monkeypatch.setattr(detection.X, "communities", lambda *a: 1 / 0)  # a run asked for its edges and core searches no communities
    out = detect(inputs(spark), "2026-01-01 00:00:00", "2026-01-31 00:00:00", "2026-01-31 00:00:00", DetectorParameters(window_days=30))
    assert out["core"].count() == out["edges"].count() == 15
