"""Graph jobs on planted graphs."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import graph as X
from claimlens.operators.density import density, density_clusters, level_grid, nested_components, spanning_forest, stable_clusters


def edges(spark, rows):
    return spark.createDataFrame([(g, min(a, b), max(a, b), float(w)) for g, a, b, w in rows], "g int, a string, b string, w double")


def cliques(g, sizes, w=1.0):
    out, start = [], 0
    for s in sizes:
        out += [(g, f"n{i:03d}", f"n{j:03d}", w) for i, j in combinations(range(start, start + s), 2)]
        start += s
    return out


def test_components_of_long_path_star_and_two_graphs(spark):
    rows = [(1, f"p{i:03d}", f"p{i + 1:03d}", 1) for i in range(70)] + [(2, "hub", f"s{i:03d}", 1) for i in range(50)] + [(2, "x", "y", 1)]
    random.Random(5).shuffle(rows)
    got = {(r.g, r.node): r.component for r in X.connected_components(edges(spark, rows)).collect()}
    assert {c for (g, _), c in got.items() if g == 1} == {"p000"} and len([1 for g, _ in got if g == 1]) == 71
    assert {c for (g, _), c in got.items() if g == 2} == {"hub", "x"}


def test_k_core_peels_chain_and_keeps_clique(spark):
    rows = cliques(1, [5]) + [(1, "n004", "t1", 1), (1, "t1", "t2", 1), (1, "t2", "n000", 1)]
    core = {(r.a, r.b) for r in X.k_core(edges(spark, rows), 3).collect()}
    assert core == {(f"n{i:03d}", f"n{j:03d}") for i, j in combinations(range(5), 2)}
    assert X.k_core(edges(spark, [(1, "a", "b", 1)]), 3).count() == 0


def test_communities_recover_planted_cliques(spark):
    rows = cliques(1, [6, 7, 5]) + [(1, "n005", "n006", 0.3), (1, "n012", "n013", 0.3)]
    e = edges(spark, rows)
    parts = X.communities(e)
    groups = sorted(sorted(r.m) for r in parts.groupBy("community").agg(F.collect_list("node").alias("m")).collect())
    assert [len(g) for g in groups] == [6, 7, 5]
    q = X.quality(e, parts).first().quality
    one = X.quality(e, parts.withColumn("community", F.lit("all"))).first().quality
    assert q > one
    again = {(r.node, r.community) for r in X.communities(e.repartition(7)).collect()}
    assert again == {(r.node, r.community) for r in parts.collect()}


def test_shape_conductance_both_readings(spark):
    e = edges(spark, cliques(1, [4]) + [(1, "n000", "z", 2.0)])
    member = spark.createDataFrame([(1, f"n{i:03d}", "c") for i in range(4)], "g int, node string, community string")
    r = X.community_shape(e, member).first()
    assert (r.members, r.edges, r.density, r.conductance) == (4, 6, 1.0, round(2 / 14, 4))
    assert X.community_shape(e, member, as_published=True).first().conductance == round(6 / 14, 4)
    assert X.retain(X.community_shape(e, member)).count() == 0


@pytest.mark.parametrize("small", [0, X.SMALL_GRAPH_NODES])
def test_eigenvector_matches_dense_solution(spark, small):
    rng = random.Random(6)
    names = [f"v{i}" for i in range(9)]
    rows = [(1, a, b, rng.random()) for a, b in combinations(names, 2) if rng.random() < 0.6]
    m = np.zeros((9, 9))
    for _, a, b, w in rows:
        i, j = names.index(a), names.index(b)
        m[i, j] = m[j, i] = w
    vec = np.abs(np.linalg.eigh(m)[1][:, -1])
    nodes = spark.createDataFrame([(1, n) for n in [*names, "alone"]], "g int, node string")
    got = {r.node: r.centrality for r in X.eigenvector_centrality(edges(spark, rows), nodes, tol=1e-7, small=small).collect()}
    assert got["alone"] == 0
    if small == 0:
        with pytest.raises(RuntimeError):
            X.eigenvector_centrality(edges(spark, rows), nodes, rounds=2, every=2, tol=0.0, small=0)
    assert max(abs(got[n] - vec[i] / vec.max()) for i, n in enumerate(names)) < 1e-3


def _kruskal(edges):
    root, out = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, a, b in sorted((-s, a, b) for a, b, s in edges):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.add((a, b))
    return out


def _components(nodes, edges, t):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, s in edges:
        if s >= t:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return [frozenset(c) for c in out.values()]


def _stable(nodes, edges, grid, least):
    """Stable clusters by recursion over whole sets."""
    weight = lambda c: sum(nodes[n] for n in c)
    level = [[c for c in _components(nodes, edges, t) if weight(c) >= least] for t in grid]
    gain = [0.0] + [density(b) - density(a) for a, b in zip(grid, grid[1:])]

    def line(i, c):
        """(mass of the cluster that c belongs to from level i on, what it splits into)."""
        kids = [k for k in level[i + 1] if k <= c] if i + 1 < len(grid) else []
        mass = weight(c) * gain[i]
        if len(kids) == 1:
            more, below = line(i + 1, kids[0])
            return mass + more, below
        return mass, [best(i + 1, k) for k in kids]

    def best(i, c):
        own, parts = line(i, c)
        split = sum(m for m, _ in parts)
        return (own, [(i, c)]) if round(own, 9) >= round(split, 9) else (split, [x for _, cs in parts for x in cs])

    return {(i, min(c)) for top in level[0] for i, c in best(0, top)[1]}


def test_forest_and_stable_clusters_match_brute_force(spark):
    rng = random.Random(11)
    nodes = {n: rng.choice([1, 1, 1, 3]) for n in range(70)}
    edges = [(a, b, round(rng.uniform(0.4, 1.0), 3)) for a in range(70) for b in range(a + 1, 70) if rng.random() < 0.06]
    frame = spark.createDataFrame([(0, *e) for e in edges], "g int, a int, b int, s double")
    forest = spanning_forest(frame)
    assert {(r.a, r.b) for r in forest.collect()} == _kruskal(edges)
    grid = level_grid(0.4, 6)
    table = spark.createDataFrame(list(nodes.items()), "node int, weight int")
    got = {(r.level, r.comp) for r in stable_clusters(nested_components(forest, table, grid), grid, 2).collect()}
    want = _stable(nodes, edges, grid, 2)
    assert got == want and len({i for i, _ in want}) > 1


def test_a_chain_does_not_merge_two_dense_groups(spark):
    near = lambda ids, s: [(a, b, s) for a in ids for b in ids if a < b]
    edges = near(range(0, 6), 0.97) + near(range(20, 26), 0.95) + [(5, 10, 0.6), (10, 11, 0.6), (11, 20, 0.6), (40, 41, 0.58)]
    frame = spark.createDataFrame(edges, "a int, b int, s double")
    nodes = spark.createDataFrame([(n, 1) for n in {x for a, b, _ in edges for x in (a, b)} | {50}], "node int, weight int")
    out = defaultdict(set)
    for r in density_clusters(frame, nodes, 0.55).collect():
        out[r.cluster].add(r.node)
    assert dict(out) == {0: set(range(6)), 20: set(range(20, 26)), 40: {40, 41}}
    empty = density_clusters(frame.limit(0), nodes, 0.55)
    assert empty.count() == 0
