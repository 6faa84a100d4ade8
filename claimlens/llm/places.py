"""Places of rows inside their groups, for groups of any size: dealt out by range, counted in streams, stitched at the borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.lineage import materialize
from .texts import partitions


def group_key(column):
    """A string key that sorts null first, then by UTF-8 bytes of the value."""
    c = column if not isinstance(column, str) else F.col(column)
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def of_key(column: str, kind: str):
    """The value behind a group_key."""
    return F.when(F.col(column) == "0", F.lit(None)).otherwise(F.expr(f"substring({column}, 2)")).cast(kind)


def ranked(rows: DataFrame, group: str, order: list[str], name: str, totals: bool = False) -> DataFrame:
    """rows with `pos`, the place of a row in its group by `order` from 0, and with `totals` also `n`, the group's rows.

    Rows are dealt out by range of (group, order), so a group of a third of all rows lies in a third of the
    partitions. Each task numbers its stretch of every group; what lies before that stretch is added from the counts
    of the groups that begin a partition, of which there are at most as many as partitions. `group` is a string
    column without nulls. Rows equal in all sort keys may swap places.
    """
    spark = rows.sparkSession
    sort = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(partitions(spark), *sort).sortWithinPartitions(*sort)
    schema = StructType([*rows.schema.fields, StructField("__part", IntegerType()), StructField("__local", LongType()), StructField("__head", IntegerType())])

    def number(batches):
        part, last, seen, first = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            g = batch.column(batch.schema.get_field_index(group))
            first = g[0].as_py() if first is None else first
            change = np.ones(m, bool)
            change[1:] = np.asarray(pc.not_equal(g[1:], g[:-1]))
            change[0] = g[0].as_py() != last
            start = np.flatnonzero(change)
            at = np.zeros(m, np.int64)
            at[start] = start
            at = np.maximum.accumulate(at)
            local = np.arange(m) - at
            if not change[0]:
                local[: start[0] if len(start) else m] += seen
            last, seen = g[m - 1].as_py(), int(local[-1]) + 1
            head = pc.equal(g, first).cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(m, part, np.int32)), pa.array(local), head],
                schema=pa.schema([*batch.schema, pa.field("__part", pa.int32()), pa.field("__local", pa.int64()), pa.field("__head", pa.int32())]))

    placed = materialize(dealt.mapInArrow(number, schema), name)
    before = Window.partitionBy(group).orderBy("__part")
    ahead = F.coalesce(F.sum("c").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    pos = (F.col("__local") + F.coalesce("ahead", F.lit(0))).cast("bigint").alias("pos")
    counts = lambda df: df.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("c"))
    if totals:
        # a row for each group and partition it touches; both sides of the join are even in (group, partition)
        known = counts(placed).select(group, "__part", ahead.alias("ahead"), F.sum("c").over(Window.partitionBy(group)).cast("bigint").alias("n"))
        return placed.join(known, [group, "__part"]).select(*rows.columns, pos, "n")
    heads = placed.filter("__head = 1 AND __local = 0").select(group).distinct()
    # at most two rows for each partition, so sending them is bounded by a setting, not by the data
    known = counts(placed.join(F.broadcast(heads), group, "left_semi")).select(group, "__part", ahead.alias("ahead")).filter("ahead > 0")
    return placed.join(F.broadcast(known), [group, "__part"], "left").select(*rows.columns, pos)
