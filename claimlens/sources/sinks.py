"""Sinks: append-only snapshots, replace-by-key partitions, deletion of named ids."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def append_by_date(df: DataFrame, path: str, at: str) -> None:
    df.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").parquet(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace only the partitions whose key values occur in df."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def delete_by_ids(spark: SparkSession, path: str, ids: DataFrame, key: str, target: str) -> None:
    """Write the table without the named ids to a new folder (files in use are never overwritten)."""
    table = spark.read.parquet(path)
    table.join(ids.select(key).distinct(), key, "left_anti").write.mode("errorifexists").parquet(target)


class CommittedTable:
    """A table of files by partition value, with a commit record for every batch.

    A batch writes its files to a folder of its own and then one record file, which appears as a whole or not at all;
    readers take recorded folders only. So a batch that fails half-way is never seen, one that is written again under
    its id counts once, and a replacement of several partitions shows all of them at the same time. One writer at a
    time. Records are as many as batches and their partitions; files are never overwritten.
    """

    LOG = "seq bigint, batch string, part string, folder string, replaces boolean"

    def __init__(self, spark: SparkSession, path: str, schema: str, part: str):
        self.spark, self.path, self.schema, self.part = spark, path.rstrip("/"), schema, part

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.LOG)

    def _name(self):
        """A folder name for a partition value of any kind: null is one, too, and no character needs an escape."""
        return F.concat(F.lit("p"), F.md5(F.coalesce(F.concat(F.lit("v"), F.col(self.part).cast("string")), F.lit("n"))))

    def write_files(self, df: DataFrame) -> str:
        """The files of a batch, not yet part of the table; returns their folder."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn("_part", self._name()).write.partitionBy("_part").parquet(folder)
        return folder

    def commit(self, folder: str, batch: str, replaces: bool) -> None:
        parts = self.spark.read.schema(self.schema + ", _part string").parquet(folder).select(F.col("_part").alias("part")).distinct()
        seq = (self._log().agg(F.max("seq")).first()[0] or 0) + 1
        rows = parts.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(batch).alias("batch"), "part", F.lit(folder).alias("folder"), F.lit(replaces).alias("replaces"))
        # a batch written again names its earlier folder no more, even where it has no rows left in a partition
        rows = rows.unionByName(self.spark.createDataFrame([(seq, batch, None, folder, False)], self.LOG))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def append(self, df: DataFrame, batch: str) -> None:
        self.commit(self.write_files(df), batch, False)

    def replace(self, df: DataFrame, batch: str) -> None:
        """df takes the place of all rows in the partitions that it has rows for."""
        self.commit(self.write_files(df), batch, True)

    def read(self) -> DataFrame:
        log = self._log()
        newest = log.groupBy("batch").agg(F.max("seq").alias("seq"))
        valid = log.join(newest, ["batch", "seq"]).filter("part IS NOT NULL")
        since = valid.filter("replaces").groupBy("part").agg(F.max("seq").alias("since"))
        live = valid.join(since, "part", "left").filter("since IS NULL OR seq >= since").select("folder", "part").collect()
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{r.folder}/_part={r.part}" for r in live])
