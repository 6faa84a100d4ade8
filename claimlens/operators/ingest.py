"""Ingest shaping: filters, per-source top n, deduplication, assembly of post rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from .vectors import best_match


def location_filter(df: DataFrame, words=T.LOCATION_WORDS, text: str = "text") -> DataFrame:
    return df.filter(T.contains_any(F.col(text), words))


def relevance_filter(df: DataFrame, key: str, exemplars: DataFrame, exemplar_key: str, threshold: float = 0.35) -> DataFrame:
    """Rows whose best exemplar reaches the threshold; without exemplars every row stays."""
    if exemplars.filter("embedding IS NOT NULL").isEmpty():
        return df
    best = best_match(df, key, exemplars, exemplar_key, threshold)
    return df.join(best.select(key), key, "left_semi")


def top_n_per_source(df: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.col("popularity").desc(), F.col("external_ref"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def newest_per_channel(df: DataFrame, channel: str, at: str, key: str, n: int = 200) -> DataFrame:
    w = Window.partitionBy(channel).orderBy(F.col(at).desc(), F.col(key).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def dedup_external_ref(batch: DataFrame, stored: DataFrame, key: str = "post_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped): stored refs and repeats inside the batch are skipped, NULL refs never are."""
    ref = F.col("external_ref")
    refs = stored.filter(ref.isNotNull()).select("external_ref").distinct()
    named = batch.filter(ref.isNotNull())
    first = named.groupBy("external_ref").agg(F.min(key).alias(key))
    fresh = named.join(first, ["external_ref", key], "left_semi").join(refs, "external_ref", "left_anti")
    repeats = named.join(first, ["external_ref", key], "left_anti")
    known = named.join(first, ["external_ref", key], "left_semi").join(refs, "external_ref", "left_semi")
    accepted = fresh.unionByName(batch.filter(ref.isNull()))
    return accepted.select(*batch.columns), repeats.unionByName(known).select(*batch.columns)


def content_items(entries: DataFrame, labels: DataFrame, vectors: DataFrame, key: str = "post_id") -> tuple[DataFrame, DataFrame]:
    """(complete, failed): a row missing its labels goes to the failed output and is never half written."""
    joined = entries.join(labels.withColumn("_labelled", F.lit(True)), key, "left").join(vectors, "vec_id", "left")
    ok = joined.filter("_labelled").drop("_labelled")
    failed = joined.filter("_labelled IS NULL").select(*entries.columns)
    return ok, failed
