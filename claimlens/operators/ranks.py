"""Order-based facts of groups of any size, without sorting one group in one task.

A group is cut into chunks that follow the order (for example days); chunk sizes are added up, and
only the rows of one chunk are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def chunked_rank(df: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Add rn (1-based position inside the group) and group_rows. `chunk` must not decrease along the order."""
    d = df.withColumn("_chunk", chunk)
    sizes = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    before = sizes.select(*keys, "_chunk", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("group_rows"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        d.withColumn("_r", F.row_number().over(inside)).join(before, [*keys, "_chunk"])
        .withColumn("rn", F.col("_before") + F.col("_r")).drop("_chunk", "_r", "_before")
    )


def gaps(df: DataFrame, keys: list[str], at: str = "created_at") -> DataFrame:
    """(keys, gap) in seconds between neighbouring rows of a group."""
    d = df.select(*keys, F.unix_micros(at).alias("t"), F.to_date(at).alias("_day"))
    edge = d.groupBy(*keys, "_day").agg(F.max("t").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_day")
    carried = edge.select(*keys, "_day", F.lag("_last").over(w).alias("_carry"))
    inside = Window.partitionBy(*keys, "_day").orderBy("t")
    prev = d.withColumn("_p", F.lag("t").over(inside)).join(carried, [*keys, "_day"])
    return prev.select(*keys, ((F.col("t") - F.coalesce("_p", "_carry")) / 1e6).alias("gap")).filter("gap IS NOT NULL")


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of a non-negative value per group."""
    ranked = chunked_rank(df.select(*keys, value), keys, [value], F.floor(F.log2(F.col(value) + 1) * 16))
    lo, hi = F.floor((F.col("group_rows") + 1) / 2), F.floor((F.col("group_rows") + 2) / 2)
    return ranked.filter((F.col("rn") == lo) | (F.col("rn") == hi)).groupBy(*keys).agg(F.avg(value).alias(name))
