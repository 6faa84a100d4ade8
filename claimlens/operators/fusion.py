"""Fusion of the pair signals into edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import FAMILY_WEIGHTS
from .lineage import materialize


def effective_weights(available: dict[str, bool], base: dict[str, float] | None = None) -> dict[str, float]:
    """Weight of unavailable families shared out in proportion; all unavailable keeps the base."""
    base = base or FAMILY_WEIGHTS
    on = {f: w for f, w in base.items() if available.get(f)}
    total = sum(on.values())
    if not total:
        return dict(base)
    missing = sum(base.values()) - total
    return {f: w + w / total * missing for f, w in on.items()}


def effective_weights_table(families: DataFrame) -> DataFrame:
    """The same rule per claim over rows (claim_id, family, base_weight, available)."""
    sums = families.groupBy("claim_id").agg(
        F.sum(F.when(F.col("available"), F.col("base_weight")).otherwise(0.0)).alias("on_sum"),
        F.sum(F.when(~F.col("available"), F.col("base_weight")).otherwise(0.0)).alias("off_sum"),
    )
    w = F.col("base_weight")
    return families.join(sums, "claim_id").filter((F.col("on_sum") == 0) | F.col("available")).select(
        "claim_id", "family",
        F.when(F.col("on_sum") == 0, w).otherwise(w + w / F.col("on_sum") * F.col("off_sum")).alias("weight"),
    )


def stack_families(signals: dict[str, DataFrame | None]) -> DataFrame:
    parts = [d.select("claim_id", "a", "b", F.lit(f).alias("family"), "score") for f, d in signals.items() if d is not None]
    return reduce(DataFrame.unionByName, parts)


def fuse_edges(signals: dict[str, DataFrame | None], base: dict[str, float] | None = None, theta: float = 0.35,
               min_families: int = 2, strong: float = 0.25) -> DataFrame:
    """One row per kept pair with its total, the value of each family and the number of families above 0."""
    weights = effective_weights({f: d is not None for f, d in signals.items()}, base)
    return fuse_stacked(stack_families(signals), weights, theta, min_families, strong)


def fuse_stacked(stacked: DataFrame, weights: dict[str, float], theta: float, min_families: int, strong: float) -> DataFrame:
    value = lambda f: F.coalesce(F.max(F.when(F.col("family") == f, F.col("score"))), F.lit(0.0))
    wide = stacked.groupBy("claim_id", "a", "b").agg(
        *[value(f).alias(f) for f in FAMILY_WEIGHTS],
        F.count(F.when(F.col("score") >= strong, 1)).alias("strong"),
        F.count(F.when(F.col("score") > 0, 1)).alias("signal_count"),
    )
    total = reduce(lambda x, y: x + y, [F.lit(float(w)) * F.col(f) for f, w in weights.items()])
    # nine digits first: sums of four-digit scores must not fall off a tie or the threshold by float noise
    return (
        wide.withColumn("total", F.round(total, 9))
        .filter((F.col("total") >= theta) & (F.col("strong") >= min_families))
        .select("claim_id", "a", "b", F.round("total", 4).alias("w_total"), *FAMILY_WEIGHTS, "signal_count")
    )


def strong_edges(families: list, meta, base: dict[str, float] | None = None, theta: float = 0.35, min_families: int = 2, strong: float = 0.25,
                 reports: dict[str, dict] | None = None) -> DataFrame:
    """fuse_edges without the weak pairs: an edge is strong in `min_families` (2 or more) families, so the pairs strong in
    one family are found by its threshold search, `meta` (pairs -> scores) is worked out for those, and the values of all
    families only for what is strong in enough. `families` have name, strong(s) and of(pairs); absent ones are left out. One
    that is not `complete` may leave out pairs that are in the list of another or cannot be edges; then lists don't count votes.
    Each family's rows are written by themselves, so the driver never holds the stages of all families at once.
    """
    report = lambda f: None if reports is None else reports.setdefault(f.name, {})
    found = [materialize(f.strong(strong, report(f)).select("claim_id", "a", "b"), "strong") for f in families]
    votes = materialize(reduce(DataFrame.unionByName, found).groupBy("claim_id", "a", "b").agg(F.count(F.lit(1)).alias("votes")), "votes")
    personal = materialize(meta(votes.select("claim_id", "a", "b")), "w_meta")
    kept = votes
    if all(getattr(f, "complete", True) for f in families):
        more = personal.filter(F.col("score") >= strong).select("claim_id", "a", "b", F.lit(1).alias("more"))
        kept = votes.join(more, ["claim_id", "a", "b"], "left").filter(F.col("votes") + F.coalesce("more", F.lit(0)) >= min_families)
    pairs = materialize(kept.select(F.col("claim_id").alias("g"), "a", "b"), "pairs")
    values = {f.name: materialize(f.of(pairs), "values") for f in families}
    values["w_meta"] = personal.join(pairs.select(F.col("g").alias("claim_id"), "a", "b"), ["claim_id", "a", "b"], "left_semi")
    weights = effective_weights({f: f in values for f in FAMILY_WEIGHTS}, base)
    return fuse_stacked(stack_families(values), weights, theta, min_families, strong)
