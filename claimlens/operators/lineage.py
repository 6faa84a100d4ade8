"""Cutting the plan of iterative jobs by writing a table to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; only a local-mode session may fall back to a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once and read it back: survives executor loss and gives the planner real sizes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Split a scan that arrives in fewer partitions than there are cores, before heavy per-row work.

    Large tables already come in many splits and are left as they are, so no text is shuffled for them.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan
