"""Score formulas as column expressions. Scores are stored at four decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONITORED_PLATFORMS = 5  # number of post sources


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def raw_reach(impressions, authors, posts, platforms, s) -> Column:
    def damped(x):
        return F.log1p(F.greatest(x, F.lit(0)))

    return (
        s.s("reach_weight_impressions") * damped(impressions)
        + s.s("reach_weight_unique_authors") * damped(authors)
        + s.s("reach_weight_content_count") * damped(posts)
        + s.s("reach_weight_platform_spread") * platforms / MONITORED_PLATFORMS
    )


def minmax_0_100(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-9, F.lit(50.0)).otherwise(F.round((x - low) / (high - low) * 100, 4))


def raw_velocity(now: Column, before: Column, epsilon: float = 1.0) -> Column:
    return (now - before) / (before + F.lit(float(epsilon)))


def velocity_score(raw: Column, mean: Column, std: Column, z_min: float, z_max: float) -> Column:
    z = F.when(std < 1e-9, F.lit(0.0)).otherwise((raw - mean) / std)
    return F.round((clamp(z, z_min, z_max) - z_min) / (z_max - z_min) * 100, 4)


def falseness(similarity: Column, threshold: float) -> Column:
    return F.when(similarity >= threshold, F.round(clamp(similarity, 0, 1) * 100, 4))


def harm(public_safety, institutional_trust, economic, policy_disruption, s) -> Column:
    total = (
        s.s("harm_weight_public_safety") * public_safety
        + s.s("harm_weight_institutional_trust") * institutional_trust
        + s.s("harm_weight_economic") * economic
        + s.s("harm_weight_policy_disruption") * policy_disruption
    )
    return F.round(clamp(total, 0, 100), 4)


def emotional_intensity(avg_outrage, negative, positive, n_posts) -> Column:
    """NULL without posts; the reaction half is 0 when nobody reacted."""
    reactions = F.coalesce(negative, F.lit(0)) + F.coalesce(positive, F.lit(0))
    ratio = F.when(reactions > 0, F.coalesce(negative, F.lit(0)) / reactions).otherwise(F.lit(0.0))
    score = 50.0 * F.coalesce(avg_outrage, F.lit(0.0)) + 50.0 * ratio
    return F.when(n_posts > 0, F.round(clamp(score, 0, 100), 4))


def npr(supporting: Column, opposing: Column) -> Column:
    total = supporting + opposing
    return F.when(total > 0, F.round(opposing / total, 4))


def discount(npr_col: Column, total: Column, gamma: float, minimum_posts: int) -> Column:
    return F.when(npr_col.isNull() | (total < minimum_posts), F.lit(1.0)).otherwise(
        F.round(1 - F.lit(float(gamma)) * npr_col, 4)
    )


def claim_score(reach, velocity, false_, harm_, intensity, s) -> Column:
    """Weighted sum; an unknown falseness drops out and the other weights are scaled up."""
    rest = (
        s.s("weight_reach") * reach
        + s.s("weight_velocity") * velocity
        + s.s("weight_harm") * harm_
        + s.s("weight_emotional_intensity") * intensity
    )
    rest_weight = s.s("weight_reach") + s.s("weight_velocity") + s.s("weight_harm") + s.s("weight_emotional_intensity")
    total = F.when(false_.isNull(), rest / rest_weight).otherwise(rest + s.s("weight_falseness") * false_)
    return F.round(clamp(total, 0, 100), 4)


def final_score(score: Column, discount_factor: Column) -> Column:
    return F.round(score * discount_factor, 4)
