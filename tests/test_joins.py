"""Similarity joins, pair sums and duplicate texts against brute force."""

import random
import tracemalloc
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimlens.operators import lineage
from claimlens.operators import textdup as D
from claimlens.operators.overlap import shared_sums
from claimlens.operators import pairs
from claimlens.operators.pairs import heavy_pairs, listed, met
from claimlens.operators.signals import w_text
from claimlens.operators.vectors import fit_index, pairs_above, top_k


def unit(rng, n, d=8, clusters=6):
    centers = rng.normal(size=(clusters, d))
    v = centers[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, embedding array<double>")


def test_top_k_small_side_and_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = unit(rng, 60), unit(rng, 45)
    left, right = table(spark, a).withColumnRenamed("id", "l"), table(spark, b).withColumnRenamed("id", "r")
    sims = np.round(a @ b.T, 9)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-sims[i], kind="stable")[:3] if sims[i, j] >= 0.5}
    for limit in (1000, 10):
        got = {(r.l, r.r) for r in top_k(left, "l", right, "r", 3, 0.5, small_side_rows=limit).collect()}
        assert got == want
        every = {(r.l, r.r) for r in top_k(left, "l", right, "r", None, 0.5, small_side_rows=limit).collect()}
        assert every == {(i, j) for i in range(60) for j in range(45) if sims[i, j] >= 0.5}


def test_pairs_above_is_exact_with_many_pivots_and_small_blocks(spark):
    v = unit(np.random.default_rng(2), 300)
    sims = np.round(v @ v.T, 9)
    want = {(i, j) for i, j in combinations(range(300), 2) if sims[i, j] >= 0.93}
    report = {}
    rows = pairs_above(table(spark, v), "id", 0.93, block_rows=16, report=report).collect()
    assert report["wanted"] <= report["products"] <= report["met"] and report["products"] < 300 * 299 / 2 / 3
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {(r.a, r.b) for r in rows} == want


def test_shared_sums_hot_features_match_brute_force(spark):
    rng = random.Random(3)
    rows = {(g, f"e{e}", f): (rng.randint(1, 4), 1 + f % 3) for g in (1, 2) for e in range(40) for f in range(12) if rng.random() < (0.95 if f < 3 else 0.1)}
    df = spark.createDataFrame([(*k, w, c) for k, (w, c) in rows.items()], "g int, e string, f int, w int, c int")
    want = defaultdict(float)
    for (g, e, f), (w, c) in rows.items():
        for (g2, e2, f2), (w2, _) in rows.items():
            if g == g2 and f == f2 and e < e2:
                want[g, e, e2] += c * w * w2
    for hot in (2, 1000):
        got = {(r.g, r.a, r.b): r.total for r in shared_sums(df, "g", "e", "f", "w", "c", hot_df=hot).collect()}
        assert got == dict(want)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["abc", "abcd!!", "ABCD!", ""]
    units = D.text_units(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    norm = {r.text_id: r.norm for r in units.collect()}
    sets = {k: ({t[i:i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t}) for k, t in norm.items() if t}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = {(r.text_a, r.text_b) for r in D.near_duplicate_texts(units, 0.8).collect()}
    assert want and got == want


def test_normalisation_groups_variants(spark):
    rows = [(1, "Read THIS now!!! https://a.example/x @bob"), (2, "read this now! http://b.example @al \U0001f600"), (3, "other")]
    u = {r.doc_id: r.text_id for r in D.text_units(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert u[1] == u[2] == 1 and u[3] == 3


def test_heavy_pairs_match_brute_force(spark):
    rng = random.Random(9)
    rows, need = {}, {}
    for g in ("x", "y"):
        for e in range(45):
            need[g, f"e{e}"] = rng.choice([1.0, 1.0, 2.5, 4.0, 9.0])
            for f in range(30):
                if rng.random() < (0.9 if f < 2 else 0.12):
                    rows[g, f"e{e}", f] = (rng.choice([1.0, 1.0, 3.0]), 0.5 + f % 3)
    frame = spark.createDataFrame([(*k, *v, need[k[:2]]) for k, v in rows.items()], "g string, e string, f int, w double, k double, need double")
    sums = defaultdict(float)
    for (g, e, f), (w, k) in rows.items():
        for (g2, e2, f2), (w2, _) in rows.items():
            if g == g2 and f == f2 and e < e2:
                sums[g, e, e2] += k * w * w2
    want = {p for p, s in sums.items() if s >= min(need[p[0], p[1]], need[p[0], p[2]])}
    report = {}
    got = {(r.g, r.a, r.b): r.total for r in heavy_pairs(frame, report=report).collect()}
    assert set(got) == want and all(abs(got[p] - sums[p]) < 1e-9 for p in want)
    assert len(want) == report["wanted"] <= report["met"] < len(sums)


def test_unit_vectors_meet_by_what_their_tails_can_add(spark):
    rng = np.random.default_rng(10)
    m = rng.random((60, 40)) * (rng.random((60, 40)) < 0.2)
    m[:, 0] = rng.random(60) * 0.3  # a feature that all have
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    t = 0.45
    frame = spark.createDataFrame([("g", f"{i:02}", int(j), float(m[i, j]), 1 / t, 1.0) for i, j in zip(*np.nonzero(m))], "g string, e string, f int, w double, k double, need double")
    cos = m @ m.T
    want = {(f"{i:02}", f"{j:02}") for i, j in combinations(range(60), 2) if cos[i, j] >= t}
    report = {}
    assert {(r.a, r.b) for r in heavy_pairs(frame, True, report).collect()} == want
    assert report["met"] < 60 * 59 / 4


def test_near_duplicates_write_less_than_their_shingles(spark, tmp_path, monkeypatch):
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(300)]
    texts += [t + " " + rng.choice(words) for t in texts[:40]]
    monkeypatch.setattr(lineage, "checkpoint_root", lambda _: str(tmp_path))
    units = D.text_units(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    near = {(r.text_a, r.text_b) for r in D.near_duplicate_texts(units).collect()}
    assert near == {(i, 300 + i) for i in range(40)}
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert written < 2 * sum(map(len, texts))  # shingle sets alone take four times the texts


def test_links_of_unused_texts_are_not_searched_and_change_no_score(spark):
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [(i, base[i % 6] + (" " + words[i] if i >= 6 else "")) for i in range(24)]
    units = D.text_units(spark.createDataFrame(texts, "doc_id int, text string"))
    posts = [(1, f"u{p % 4}", p, p % 14, False) for p in range(40)]  # texts 14 to 23 are in no post
    eligible = D.eligible_posts(spark.createDataFrame(posts, "claim_id int, account_id string, post_id int, doc_id int, is_native_reshare boolean"), units)
    used = D.units_of(units, eligible)
    assert {r.text_id for r in used.collect()} == set(range(14))
    scores = lambda u: sorted(tuple(r) for r in w_text(eligible, D.duplicate_links(D.near_duplicate_texts(u))).collect())
    assert scores(used) and scores(used) == scores(units)


def test_met_pairs_shuffle_keys_and_products_only(spark):
    rows = spark.createDataFrame([("g", f"e{e}", f, 1.0, 1.0, 1.0) for e in range(6) for f in range(3)], "g string, e string, f int, w double, k double, need double")
    out = met(listed(rows))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "first(" not in plan and out.count() == 15


def test_pairs_of_blocks_are_whole_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ENTITIES", 4)
    rng = random.Random(3)
    lists = {f"e{e:02d}": sorted({rng.randrange(25) for _ in range(9)}) for e in range(30)}
    rows = spark.createDataFrame([("g", e, f, 1.0, 1.0, 3.0) for e, fs in lists.items() for f in fs], "g string, e string, f bigint, w double, k double, need double")
    want = {(a, b): len(set(lists[a]) & set(lists[b])) for a in lists for b in lists if a < b and len(set(lists[a]) & set(lists[b])) >= 3}
    assert {(r.a, r.b): r.total for r in heavy_pairs(rows).collect()} == want
    plan = met(listed(rows))._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert plan.startswith("FlatMapCoGroupsInPandas")  # nothing is shuffled or joined after the pairs are made


def test_a_step_of_the_sums_may_cut_a_block(monkeypatch):
    monkeypatch.setattr(pairs, "PRODUCTS_AT_ONCE", 3)
    side = pd.DataFrame({"fs": [["a", "b"], ["b", "c"], ["c"]], "ws": [[1.0, 2.0], [3.0, 1.0], [5.0]], "end_df": [2, 2, 2], "end_f": ["b", "c", "c"]})
    sums, earlier = pairs._block_sums(side, side)
    assert sums.tolist() == [[5.0, 6.0, 0.0], [6.0, 10.0, 5.0], [0.0, 5.0, 25.0]]
    assert earlier.tolist() == [[True, True, True], [False, True, True], [False, True, True]]


def test_sums_of_given_pairs_keep_their_columns(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ENTITIES", 3)
    rng = random.Random(4)
    rows = [(g, f"e{e}", f"f{f}", rng.random() + 0.1, 1.0 + f) for g in (1, 2) for e in range(11) for f in range(9) if rng.random() < 0.4]
    frame = spark.createDataFrame(rows, "g int, e string, f string, w double, k double")
    by = defaultdict(dict)
    for g, e, f, w, k in rows:
        by[g, e][f] = (w, k)
    given = [(g, f"e{x}", f"e{y}", float(x)) for g in (1, 2, 3) for x, y in combinations(range(12), 2) if (x + y) % 3]
    want = {}
    for g, a, b, need in given:
        shared = by[g, a].keys() & by[g, b].keys()
        if shared:
            want[g, a, b, need] = sum(by[g, a][f][1] * by[g, a][f][0] * by[g, b][f][0] for f in shared)
    sums = pairs.pair_sums(spark.createDataFrame(given, "g int, a string, b string, need double"), frame)
    got = {(r.g, r.a, r.b, r.need): r.total for r in sums.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert "[g, a, b" not in "".join(x for x in sums._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)  # lists are not joined pair by pair


def test_index_is_fitted_in_memory_of_the_sample(spark):
    v = unit(np.random.default_rng(2), 3000)
    rows = table(spark, v).select(F.col("id"), F.col("embedding").alias("v")).cache()
    fit_index(rows, 3000, 4)
    tracemalloc.start()
    _, rotation = fit_index(rows, 3000, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 4  # a matrix of rows x rows has twice that
    assert np.allclose(rotation.T @ rotation, np.eye(8))
    spread = ((v @ rotation) ** 2).sum(axis=0)
    assert (np.diff(spread) <= 1e-6).all()
