"""Typed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import LANDED, MODEL


class Tables:
    """Lazy typed scans of the landed tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in LANDED:
            raise AttributeError(name)
        return read_table(self.spark, f"{self.folder}/{name}.parquet", name)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(LANDED.get(name) or MODEL[name]).parquet(path)
