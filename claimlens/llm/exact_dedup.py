"""Exact duplicates by content sort (operator 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.lineage import materialize
from .texts import NO_ID, WS, partitions

SALTS = 64


def squeezed(text):
    """The text without ASCII blanks."""
    for ch in WS:
        text = F.replace(text, F.lit(ch))
    return text


def _key(column: str):
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def exact_groups(docs: DataFrame, salts: int = SALTS, head: int = 48) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    Sampled splitters deal the normalised texts out by range; each partition is sorted, so equal texts lie side by
    side and neighbours are compared in full (the window on `norm`). The splitters see a short head and a hash of a
    text, never whole texts, so what the driver holds does not grow with text length. A salt from the id is the last
    range key: a text that a third of all rows share is sorted in `salts` runs, and the winners of the runs meet by
    SHA-256 without their texts.

    Null text is an empty text, and empty texts are one group. Null doc_id sorts first. Rows that repeat an id are
    members each; of rows with the same id and length one is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.char_length(text).cast("bigint").alias("size"), squeezed(text).alias("norm"))
    rows = rows.select(
        "id", "size", "norm", F.substring("norm", 1, head).alias("head"), F.xxhash64("norm").alias("h"),
        F.pmod(F.xxhash64("id", "size"), F.lit(salts)).cast("int").alias("salt"),
    )
    run = ["head", "h", "salt", "norm"]
    order = [F.col("size").desc(), F.col("id").asc_nulls_first()]
    dealt = rows.repartitionByRange(partitions(spark), "head", "h", "salt")
    w = Window.partitionBy(*run)
    local = dealt.select(
        "id", "salt", "norm",
        F.row_number().over(w.orderBy(*order)).alias("rn"),
        F.struct(F.first("size").over(w.orderBy(*order)).alias("size"), F.first("id").over(w.orderBy(*order)).alias("id")).alias("top"),
        F.count(F.lit(1)).over(w).alias("n"),
    ).select("id", "salt", "rn", "top", "n", F.sha2("norm", 256).alias("digest"))
    local = materialize(local, "sorted")  # short rows; texts are read, dealt and sorted once
    runs = local.filter("rn = 1").select("digest", "salt", "top", "n")
    best = runs.groupBy("digest").agg(
        F.sum("n").alias("group_size"),
        F.min(F.struct((-F.col("top.size")).alias("size"), F.col("top.id").alias("keep_id"), "salt")).alias("best"),
    )
    # each run learns its group's winner; the key of this join and the next holds the salt, so it stays even
    named = runs.select("digest", "salt").join(best, "digest").select("digest", "salt", "group_size", F.col("best.keep_id").alias("keep_id"), (F.col("best.salt") == F.col("salt")).alias("mine"))
    return local.join(named, ["digest", "salt"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("mine") & (F.col("rn") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups drops; of a row given twice, id and text alike, one stays."""
    cols = docs.columns
    marks = exact_groups(docs).filter("kept").select(_key("doc_id").alias("__k"), F.col("text_sha256").alias("__digest"))
    rows = docs.withColumns({"__k": _key("doc_id"), "__digest": F.sha2(squeezed(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)})
    stay = rows.join(marks, ["__k", "__digest"], "left_semi")
    first = F.row_number().over(Window.partitionBy("__k", "__digest").orderBy(F.char_length("text").desc()))
    return stay.withColumn("__rn", first).filter("__rn = 1").select(*cols)


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
