"""Density clustering of a similarity graph: spanning forest, nested components, and the most stable cut.

With one neighbour asked of a core point, the mutual reachability of two points is their distance, so the hierarchy is
that of the minimum spanning forest. It is read at fixed similarities (levels), all levels in one components job.
A cluster lives from the level it separates at to the level it falls apart at, and gathers its size times the growth of
density (1 / distance) in between; of a cluster and the clusters it splits into, the heavier side stays.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .graph import connected_components
from .lineage import materialize

LEVELS = 8


def spanning_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The edges (g, a, b, s) of the forest of greatest similarity; ties go to the smaller (a, b).

    Boruvka rounds: every component takes its best edge to another one, components that took a common edge become one,
    edges inside a component go, and of parallel ones the best stays. At least half of the components go in a round.
    """
    order = F.struct((-F.col("s")).alias("d"), "a", "b")
    cur = materialize(edges.select("g", "a", "b", "s", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-edges")
    taken = []
    for _ in range(max_rounds):
        if cur.isEmpty():
            break
        both = cur.select("g", F.col("ca").alias("c"), F.col("cb").alias("other"), order.alias("e")).unionByName(
            cur.select("g", F.col("cb").alias("c"), F.col("ca").alias("other"), order.alias("e")))
        best = both.groupBy("g", "c").agg(F.min_by(F.struct("e", "other"), "e").alias("m")).select("g", "c", "m.e", "m.other")
        best = materialize(best, "forest-best")
        taken.append(best.select("g", "e.a", "e.b", (-F.col("e.d")).alias("s")))
        parts = connected_components(best.select("g", F.col("c").alias("a"), F.col("other").alias("b"))).select("g", F.col("node").alias("c"), "component")
        to = lambda side: parts.select("g", F.col("c").alias(side), F.col("component").alias(f"{side}_new"))
        moved = cur.join(to("ca"), ["g", "ca"]).join(to("cb"), ["g", "cb"]).filter("ca_new <> cb_new")
        ends = (F.least("ca_new", "cb_new").alias("ca"), F.greatest("ca_new", "cb_new").alias("cb"))
        kept = moved.groupBy("g", *ends).agg(F.min(order).alias("e"))
        cur = materialize(kept.select("g", "e.a", "e.b", (-F.col("e.d")).alias("s"), "ca", "cb"), "forest-edges")
    else:
        raise RuntimeError("the forest did not settle")
    if not taken:
        return edges.select("g", "a", "b", "s").limit(0)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return materialize(out.distinct(), "forest")


def level_grid(epsilon: float, levels: int = LEVELS) -> list[float]:
    """Similarities from epsilon up, the last one short of 1."""
    return [round(epsilon + (1 - epsilon) * i / levels, 9) for i in range(levels)]


def density(similarity: float) -> float:
    """1 / distance of unit vectors of that similarity."""
    return 1 / math.sqrt(2 - 2 * similarity)


def nested_components(forest: DataFrame, nodes: DataFrame, grid: list[float]) -> DataFrame:
    """(level, node, comp, weight): the component of every node at every similarity of the grid. nodes: node, weight."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(t).alias("t")) for i, t in enumerate(grid)])).alias("x")
    edges = forest.select("a", "b", "s", at).filter("s >= x.t").select(F.col("x.level").alias("g"), "a", "b")
    parts = connected_components(edges).select(F.col("g").alias("level"), "node", F.col("component").alias("comp"))
    every = nodes.select("node", "weight", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("level"))
    return every.join(parts, ["level", "node"], "left").select("level", "node", F.coalesce("comp", "node").alias("comp"), "weight")


def stable_clusters(nested: DataFrame, grid: list[float], min_size: int = 2) -> DataFrame:
    """(level, comp): the clusters of the most stable cut, no two of which share a node."""
    nested = materialize(nested, "nested")
    size = nested.groupBy("level", "comp").agg(F.sum("weight").alias("size")).filter(F.col("size") >= min_size)
    # a component is named by its smallest node, whose component one level down is the parent
    up = nested.select((F.col("level") + 1).alias("level"), F.col("node").alias("comp"), F.col("comp").alias("parent"))
    tree = materialize(size.join(up, ["level", "comp"], "left"), "tree")
    gain = [0.0] + [density(b) - density(a) for a, b in zip(grid, grid[1:])]
    below = None
    steps = []
    for i in range(len(grid) - 1, -1, -1):
        own = tree.filter(F.col("level") == i).select("comp", "parent", (F.col("size") * F.lit(gain[i])).alias("mass"))
        if below is None:
            here = own.select("comp", "parent", F.round("mass", 9).alias("own"), F.lit(0.0).alias("split"))
        else:
            kids = below.groupBy(F.col("parent").alias("comp")).agg(
                F.count(F.lit(1)).alias("kids"), F.sum("own").alias("kids_own"), F.sum("split").alias("kids_split"), F.sum(F.greatest("own", "split")).alias("kids_best"))
            one, more = F.col("kids") == 1, F.col("kids") > 1
            here = own.join(kids, "comp", "left").select(
                "comp", "parent", F.round(F.col("mass") + F.when(one, F.col("kids_own")).otherwise(0.0), 9).alias("own"),
                F.round(F.when(one, F.col("kids_split")).when(more, F.col("kids_best")).otherwise(0.0), 9).alias("split"),
                F.coalesce(more, F.lit(False)).alias("splits"))
        below = materialize(here if "splits" in here.columns else here.withColumn("splits", F.lit(False)), "mass")
        steps.append(below)
    # from the top: a cluster stays if it outweighs what it splits into; otherwise its line is followed to the split
    chosen, open_ = [], None
    for i, here in enumerate(reversed(steps)):
        if open_ is None:
            tops = here.select("comp", F.lit(True).alias("top"), "own", "split", "splits")
        else:
            tops = here.join(open_, "parent").select("comp", "top", "own", "split", "splits")
        tops = materialize(tops, "cut")
        stays = F.col("top") & (F.col("own") >= F.col("split"))
        chosen.append(tops.filter(stays).select(F.lit(i).alias("level"), "comp"))
        open_ = tops.filter(~stays).select(F.col("comp").alias("parent"), F.col("splits").alias("top"))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def density_clusters(edges: DataFrame, nodes: DataFrame, epsilon: float, min_size: int = 2, levels: int = LEVELS) -> DataFrame:
    """(node, cluster): members of the stable clusters, named by their smallest node; the others are noise.

    edges: a, b, s of pairs at or above epsilon; nodes: node, weight (how many rows a node stands for). Clusters of
    fewer than min_size rows don't exist, so a lone node is one only if enough rows share it.
    """
    grid = level_grid(epsilon, levels)
    forest = spanning_forest(edges.select(F.lit(0).alias("g"), "a", "b", "s"))
    nested = materialize(nested_components(forest, nodes, grid), "nested")
    cut = stable_clusters(nested, grid, min_size)
    return nested.join(cut, ["level", "comp"]).select("node", F.col("comp").alias("cluster"))
