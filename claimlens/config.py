"""Runtime settings and detector parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

# Setting keys with their default text.
SETTING_DEFAULTS = {
    "scoring.weight_reach": "0.15",
    "scoring.weight_velocity": "0.15",
    "scoring.weight_falseness": "0.3",
    "scoring.weight_harm": "0.3",
    "scoring.weight_emotional_intensity": "0.1",
    "scoring.harm_weight_public_safety": "0.35",
    "scoring.harm_weight_institutional_trust": "0.3",
    "scoring.harm_weight_economic": "0.2",
    "scoring.harm_weight_policy_disruption": "0.15",
    "scoring.reach_weight_impressions": "0.25",
    "scoring.reach_weight_unique_authors": "0.25",
    "scoring.reach_weight_content_count": "0.25",
    "scoring.reach_weight_platform_spread": "0.25",
    "scoring.reach_normalization_window_days": "90",
    "scoring.velocity_interval_hours": "24",
    "scoring.npr_window_hours": "24",
    "scoring.velocity_zscore_min": "-3.0",
    "scoring.velocity_zscore_max": "3.0",
    "scoring.velocity_epsilon": "1.0",
    "scoring.discount_gamma": "0.5",
    "scoring.npr_reliability_minimum_posts": "25",
    "scoring.falseness_match_threshold": "0.55",
    "scoring.falseness_live_match_score": "75.0",
    "clustering.claim_attach_threshold": "0.55",
    "clustering.topic_attach_threshold": "0.5",
    "matchmaking.claim_prefilter_threshold": "0.35",
    "ai.debunk_segment_max_count": "3",
}
# Settings that are whole numbers, and the ceiling of one of them.
INTEGER_SETTINGS = (
    "scoring.reach_normalization_window_days",
    "scoring.npr_reliability_minimum_posts",
    "ai.debunk_segment_max_count",
)
POLICY_DISRUPTION_CEILING = 0.25


class Settings(dict):
    """Typed setting values by key; a plain dict with a few shorthands."""

    @classmethod
    def defaults(cls, **overrides) -> "Settings":
        values = {
            k: int(float(v)) if k in INTEGER_SETTINGS else float(v)
            for k, v in SETTING_DEFAULTS.items()
        }
        values.update({k.replace("__", "."): v for k, v in overrides.items()})
        return cls(values)

    def s(self, name: str):
        return self["scoring." + name]


def typed_settings(stored: DataFrame) -> DataFrame:
    """One (key, value, is_default) row per known key; blank or absent text falls back to the default."""
    spark = stored.sparkSession
    defaults = spark.createDataFrame(
        [(k, v, k in INTEGER_SETTINGS) for k, v in SETTING_DEFAULTS.items()],
        "key string, default_value string, is_int boolean",
    )
    text = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("default_value"))
    number = text.cast("double")
    number = F.when(F.col("is_int"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")).otherwise(number)
    capped = F.when(
        F.col("key") == "scoring.harm_weight_policy_disruption",
        F.least(number, F.lit(POLICY_DISRUPTION_CEILING)),
    ).otherwise(number)
    return defaults.join(stored.select("key", "value"), "key", "left").select(
        "key",
        capped.alias("value"),
        F.coalesce(F.nullif(F.col("value"), F.lit("")).isNull(), F.lit(True)).alias("is_default"),
    )


def settings_row(stored: DataFrame) -> DataFrame:
    """The same settings as one wide row, plus a flag telling whether the score weights sum to 1."""
    typed = typed_settings(stored)
    picks = [
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.replace(".", "_"))
        for k in SETTING_DEFAULTS
    ]
    weights = [k for k in SETTING_DEFAULTS if k.startswith("scoring.weight_")]
    total = sum((F.col(k.replace(".", "_")) for k in weights), F.lit(0.0))
    return typed.agg(*picks).withColumn("weights_sum_to_one", F.abs(total - 1) <= 1e-6)


def load_settings(stored: DataFrame) -> Settings:
    """Read the (at most 27) known settings once, for use as literals in a plan."""
    rows = typed_settings(stored).collect()
    return Settings({r.key: int(r.value) if r.key in INTEGER_SETTINGS else r.value for r in rows})


# Signal family weights.
FAMILY_WEIGHTS = {"w_time": 0.30, "w_text": 0.25, "w_amp": 0.20, "w_meta": 0.15, "w_struct": 0.10}


# Defaults of a detection run.
@dataclass(frozen=True)
class DetectorParameters:
    window_days: int = 7
    bin_width_seconds: int = 60
    null_model_alpha: float = 0.01
    dup_threshold: float = 0.80
    sem_threshold: float = 0.90
    min_post_length: int = 25
    edge_threshold: float = 0.35
    min_signal_families: int = 2
    family_strength: float = 0.25
    k_core: int = 3
    resolution: float = 1.0
    min_cluster_size: int = 5
    min_internal_density: float = 0.30
    weights: dict = field(default_factory=lambda: dict(FAMILY_WEIGHTS))
    provenance_half_life_hours: float = 36.0
    anchor_share: float = 0.60
    min_claim_posts: int = 20
    min_link_strength: float = 0.15
    high_score_cutoff: float = 70.0
    high_breadth_cutoff: int = 3
    medium_score_cutoff: float = 55.0
    medium_breadth_cutoff: int = 2
    candidate_cap: int | None = None
    recurrence_threshold: float = 0.50
    cadence_hours: int = 24
    velocity_trigger_threshold: float = 70.0
