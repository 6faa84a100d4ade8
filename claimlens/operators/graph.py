"""Graph jobs over edge tables (g, a, b[, w]): one graph per value of g, all graphs at once.

Every round is a few joins and partial aggregates; its result is written to the shared checkpoint
folder, so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .lineage import materialize

EPS = 1e-9


def _fingerprint(df: DataFrame, *cols: str):
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("x")).first()
    return row["n"], row["x"]


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    return edges.select("g", F.col("a").alias("u"), F.col("b").alias("v"), *extra).unionByName(
        edges.select("g", F.col("b").alias("u"), F.col("a").alias("v"), *extra))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(g, node, component): component = smallest node id reachable. Alternating large and small stars."""
    cur = edges.select("g", F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    cur = materialize(cur, "cc")
    nodes = cur.select("g", F.col("hi").alias("node")).unionByName(cur.select("g", F.col("lo").alias("node"))).distinct()
    seen = _fingerprint(cur, "g", "hi", "lo")
    for _ in range(max_rounds):
        sym = cur.select("g", F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select("g", F.col("lo").alias("u"), F.col("hi").alias("v")))
        mins = sym.groupBy("g", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = sym.filter("v > u").join(mins, ["g", "u"]).select("g", F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("g", "hi").agg(F.min("lo").alias("m"))
        small = large.join(low, ["g", "hi"]).select("g", F.explode(F.array("hi", "lo")).alias("x"), "m").select(
            "g", F.col("x").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        cur = materialize(small, "cc")
        now = _fingerprint(cur, "g", "hi", "lo")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    labels = cur.select("g", F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.join(labels, ["g", "node"], "left").select("g", "node", F.coalesce("component", "node").alias("component"))


def k_core(edges: DataFrame, k: int = 3) -> DataFrame:
    """Edges whose two ends keep at least k neighbours after all weaker nodes are gone."""
    cols = edges.columns
    cur = edges
    count = None
    while True:
        degree = both_ways(cur).groupBy("g", "u").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= k).select("g", "u")
        kept = cur.join(degree.withColumnRenamed("u", "a"), ["g", "a"], "left_semi").join(
            degree.withColumnRenamed("u", "b"), ["g", "b"], "left_semi").select(*cols)
        kept = materialize(kept, "core")
        n = kept.count()
        if n == count or n == 0:
            return kept
        count, cur = n, kept


def _local_moving(sym: DataFrame, strength: DataFrame, total: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(g, u, c) after moving nodes to the neighbouring label with the best quality gain until none gains.

    sym (g, u, v, w) has both directions and may hold self-loops (u = v, counted twice in strength).
    A share of the nodes, drawn by hash anew in each round and smaller in later ones, moves at a time, so neighbours do
    not swap labels forever. Labels that don't settle within `rounds` are an error.
    """
    labels = strength.select("g", "u", F.col("u").alias("c"))
    for r in range(rounds):
        size = strength.join(labels, ["g", "u"]).groupBy("g", "c").agg(F.sum("s").alias("cs"))
        near = (
            sym.filter("u <> v").join(labels.select("g", F.col("u").alias("v"), "c"), ["g", "v"])
            .groupBy("g", "u", "c").agg(F.sum("w").alias("wc"))
        )
        own = labels.withColumn("own", F.col("c"))
        options = near.select("g", "u", "c", "wc").unionByName(labels.select("g", "u", "c", F.lit(0.0).alias("wc"))).groupBy("g", "u", "c").agg(F.sum("wc").alias("wc"))
        gain = (
            options.join(own.select("g", "u", "own"), ["g", "u"]).join(strength, ["g", "u"]).join(size, ["g", "c"]).join(total, "g")
            .withColumn("rest", F.col("cs") - F.when(F.col("c") == F.col("own"), F.col("s")).otherwise(0.0))
            .withColumn("gain", F.round(F.col("wc") - resolution * F.col("s") * F.col("rest") / F.col("m2"), 9))
        )
        best = gain.groupBy("g", "u").agg(
            F.max_by("gain", F.when(F.col("c") == F.col("own"), 1).otherwise(0)).alias("stay"),
            F.first("own").alias("own"),
            F.min(F.struct((-F.col("gain")).alias("ng"), "c")).alias("top"),
        )
        drawn = F.pmod(F.xxhash64("u", F.lit(r)), F.lit(2 + r // 8)) == 0
        gains = -F.col("top.ng") > F.col("stay") + EPS
        step = materialize(best.select("g", "u", F.when(drawn & gains, F.col("top.c")).otherwise(F.col("own")).alias("c"), gains.alias("gains")), "labels")
        labels = step.select("g", "u", "c")
        if step.filter("gains").isEmpty():
            return labels
    raise RuntimeError("communities did not settle")


def communities(edges: DataFrame, resolution: float = 1.0, levels: int = 60, rounds: int = 200) -> DataFrame:
    """(g, node, community) from weighted edges (g, a, b, w): configuration-model quality, multi-level.

    Levels and rounds are safety bounds: a search that needs more raises instead of returning an unsettled partition. Labels are split into connected parts at the end, so no community is internally disconnected.
    """
    base = materialize(edges.select("g", "a", "b", F.col("w").cast("double").alias("w")), "graph")
    sym = both_ways(base, "w")
    total = materialize(sym.groupBy("g").agg(F.sum("w").alias("m2")), "mass")
    member = sym.select("g", F.col("u").alias("node")).distinct().withColumn("c", F.col("node"))
    size = None
    for _ in range(levels):
        strength = materialize(sym.groupBy("g", "u").agg(F.sum("w").alias("s")), "strength")
        labels = _local_moving(sym, strength, total, resolution, rounds)
        # the smallest member names the merged node
        names = labels.groupBy("g", "c").agg(F.min("u").alias("name"))
        to = labels.join(names, ["g", "c"]).select("g", "u", "name")
        member = materialize(member.join(to.select("g", F.col("u").alias("c"), "name"), ["g", "c"]).select("g", "node", F.col("name").alias("c")), "member")
        n = member.select("g", "c").distinct().count()
        if n == size:
            break
        size = n
        sym = materialize(
            sym.join(to.withColumnRenamed("name", "cu"), ["g", "u"]).join(to.select("g", F.col("u").alias("v"), F.col("name").alias("cv")), ["g", "v"])
            .groupBy("g", F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "coarse")
    else:
        raise RuntimeError("communities did not settle")
    a = member.select("g", F.col("node").alias("a"), F.col("c").alias("ca"))
    b = member.select("g", F.col("node").alias("b"), F.col("c").alias("cb"))
    inner = base.join(a, ["g", "a"]).join(b, ["g", "b"]).filter("ca = cb")
    parts = connected_components(inner.select("g", "a", "b"))
    return member.select("g", "node").join(parts, ["g", "node"], "left").select(
        "g", "node", F.coalesce("component", "node").alias("community"))


def quality(edges: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(g, quality) of a partition (g, node, community): inside weight minus the expected weight."""
    sym = both_ways(edges, "w")
    m2 = sym.groupBy("g").agg(F.sum("w").alias("m2"))
    of = lambda n, c: member.select("g", F.col("node").alias(n), F.col("community").alias(c))
    inside = sym.join(of("u", "cu"), ["g", "u"]).join(of("v", "cv"), ["g", "v"]).groupBy("g").agg(
        F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    mass = sym.join(of("u", "cu"), ["g", "u"]).groupBy("g", "cu").agg(F.sum("w").alias("k")).groupBy("g").agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inside.join(mass, "g").join(m2, "g").select(
        "g", ((F.col("inside") - resolution * F.col("k2") / F.col("m2")) / F.col("m2")).alias("quality"))


def community_shape(edges: DataFrame, member: DataFrame, as_published: bool = False) -> DataFrame:
    """Per (g, community): members, inside edges, density and conductance.

    Conductance is the share of incident weight that leaves; as_published gives inside over incident.
    """
    a = member.select("g", F.col("node").alias("a"), F.col("community").alias("ca"))
    b = member.select("g", F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(a, ["g", "a"], "left").join(b, ["g", "b"], "left")
    same = F.col("ca") == F.col("cb")
    inner = e.filter(same).groupBy("g", F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("inside"))
    crossing = e.filter(~F.coalesce(same, F.lit(False)))
    ends = crossing.select("g", F.col("ca").alias("community"), "w").unionByName(crossing.select("g", F.col("cb").alias("community"), "w"))
    cut = ends.filter("community IS NOT NULL").groupBy("g", "community").agg(F.sum("w").alias("cut"))
    size = member.groupBy("g", "community").agg(F.count(F.lit(1)).alias("members"))
    zero = F.lit(0.0)
    n, inside, out = F.col("members"), F.coalesce("inside", zero), F.coalesce("cut", zero)
    incident = 2 * inside + out
    top = inside if as_published else out
    return (
        size.join(inner, ["g", "community"], "left").join(cut, ["g", "community"], "left")
        .select(
            "g", "community", "members", F.coalesce("edges", F.lit(0)).alias("edges"),
            F.when(n < 2, zero).otherwise(F.round(F.coalesce("edges", F.lit(0)) / (n * (n - 1) / 2), 4)).alias("density"),
            F.when(incident > 0, F.round(top / incident, 4)).otherwise(zero).alias("conductance"),
        )
    )


def retain(shape: DataFrame, min_size: int = 5, min_density: float = 0.30) -> DataFrame:
    return shape.filter((F.col("members") >= min_size) & (F.col("density") >= min_density))


SMALL_GRAPH_NODES = 2_000  # such a graph is one dense matrix of 32 MB at the utmost


def _leading_vectors(sym: DataFrame) -> DataFrame:
    """(g, u, x) of small graphs, each solved whole: the all-ones vector laid onto the leading eigenvectors."""
    kinds = {f.name: f.dataType.simpleString() for f in sym.schema.fields}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, u = np.unique(pdf["u"].to_numpy(), return_inverse=True)
        m = np.zeros((len(names), len(names)))
        np.add.at(m, (u, np.searchsorted(names, pdf["v"].to_numpy())), pdf["w"].to_numpy())
        values, vectors = np.linalg.eigh(m)
        top = vectors[:, values >= values[-1] - 1e-9 * max(1.0, abs(values[-1]))]
        x = np.abs(top @ top.sum(axis=0))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "u": names, "x": x / x.max()})

    return sym.groupBy("g").applyInPandas(solve, f"g {kinds['g']}, u {kinds['u']}, x double")


def _power_iteration(sym: DataFrame, rounds: int, every: int, tol: float) -> DataFrame:
    """(g, u, x) by power iteration on A + s·I (s = a quarter of the largest weighted degree of the graph), which has
    the same leading vector and also settles on two-sided graphs. Values that don't settle within `rounds` are an error."""
    degree = sym.groupBy("g", "u").agg(F.sum("w").alias("d"))
    shift = degree.groupBy("g").agg(F.max("d").alias("shift"))
    base = materialize(degree.join(shift, "g").select("g", "u", (F.col("shift") / 4).alias("shift")), "nodes")
    x = base.select("g", "u", "shift", F.lit(1.0).alias("x"))
    for _ in range(0, rounds, every):
        before = x
        for _ in range(every):
            pulled = sym.join(x.select("g", F.col("u").alias("v"), "x"), ["g", "v"]).groupBy("g", "u").agg(F.sum(F.col("w") * F.col("x")).alias("p"))
            x = x.join(pulled, ["g", "u"]).select("g", "u", "shift", (F.col("x") * F.col("shift") + F.col("p")).alias("x"))
        top = x.groupBy("g").agg(F.max("x").alias("top"))
        x = materialize(x.join(top, "g").select("g", "u", "shift", (F.col("x") / F.col("top")).alias("x")), "power")
        gap = x.join(before.select("g", "u", F.col("x").alias("y")), ["g", "u"]).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
        if gap is None or gap < tol:
            return x.select("g", "u", "x")
    raise RuntimeError("centrality did not settle")


def eigenvector_centrality(edges: DataFrame, nodes: DataFrame, rounds: int = 600, every: int = 6, tol: float = 2e-5,
                           small: int = SMALL_GRAPH_NODES) -> DataFrame:
    """(g, node, centrality) scaled so that the largest value of each graph is 1; isolated nodes get 0.

    Graphs of up to `small` nodes are solved in one task each, larger ones by rounds over all their edges.
    """
    sym = materialize(both_ways(edges, "w"), "adjacency")
    size = materialize(sym.groupBy("g", "u").agg(F.lit(1)).groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    x = _leading_vectors(sym.join(size.filter(F.col("n") <= small).select("g"), "g", "left_semi"))
    large = size.filter(F.col("n") > small).select("g")
    if not large.isEmpty():
        x = x.unionByName(_power_iteration(materialize(sym.join(large, "g", "left_semi"), "large"), rounds, every, tol))
    return nodes.select("g", "node").join(x.select("g", F.col("u").alias("node"), F.col("x").alias("c")), ["g", "node"], "left").select(
        "g", "node", F.round(F.coalesce("c", F.lit(0.0)), 4).alias("centrality"))
