"""pairs_above sends a vector once a block, and a forest of its pairs keeps forest and components."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from claimlens.operators import vectors as V
from claimlens.operators.density import spanning_forest


def random_units(spark, n, d=16):
    v = np.random.default_rng(3).normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, embedding array<double>")


def test_vectors_are_sent_once_a_block_not_once_a_cell(spark, monkeypatch):
    sizes = {}
    plain = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, name="step": sizes.setdefault(name, plain(df, name)))
    v, df = random_units(spark, 600)
    got = {(r.a, r.b) for r in V.pairs_above(df, "id", 0.5, block_rows=200).collect()}
    sims = np.round(v @ v.T, 9)
    assert got == {p for p in combinations(range(600), 2) if sims[p] >= 0.5}
    assert all(t.count() == 600 for t in sizes.values())  # before: a row for each cell a vector visits, 13 cells here
    visits = sizes["blocks"].agg(F.max(F.size("visits"))).first()[0]
    assert visits <= 600 // 200 * 2


def test_forest_of_blocks_keeps_the_spanning_forest(spark):
    v, df = random_units(spark, 250)
    whole = V.pairs_above(df, "id", 0.4, block_rows=60)
    few = V.pairs_above(df, "id", 0.4, block_rows=60, forest=True)
    assert few.count() < whole.count() / 1.5
    forests = [{(r.a, r.b, r.s) for r in spanning_forest(x.select(F.lit(0).alias("g"), "a", "b", F.col("similarity").alias("s"))).collect()} for x in (whole, few)]
    assert forests[0] == forests[1] and len(forests[0]) > 200


def test_strongest_forest_breaks_ties_by_ends():
    a, b, s = np.array([1, 1, 2, 5, 3]), np.array([2, 3, 3, 6, 4]), np.array([0.5, 0.5, 0.5, 0.9, 0.4])
    kept = sorted((int(a[k]), int(b[k])) for k in V.strongest_forest(a, b, s))
    assert kept == [(1, 2), (1, 3), (3, 4), (5, 6)]
    assert len(V.strongest_forest(a[:0], b[:0], s[:0])) == 0
