"""Shared pieces for jobs that read whole texts: scans, row keys, bounded slices, words and window minima."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

NO_ID = -(2**63)
WS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame, *more: str, spread: bool = True) -> DataFrame:
    """(k, th, text, *more): k is doc_id with null as the smallest value, th 32 bits of the text's hash, null text is empty.

    (k, th) names a row; rows that repeat an id with the same text are the same row to the joins below.
    A scan with fewer splits than cores is dealt out first; large tables keep their splits.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), text.alias("text"), *more)
    if spread:
        df = dealt(df)
    return df.select("k", F.pmod(F.xxhash64("text"), F.lit(2**32)).alias("th"), "text", *more)


def dealt(df: DataFrame) -> DataFrame:
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def id_of(k):
    """The doc_id behind a key."""
    return F.when(F.col(k) == NO_ID, F.lit(None).cast("bigint")).otherwise(F.col(k))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, column: str = "text", limit: int = 4 << 20):
    """Cut Arrow batches into row ranges of about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        width = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
        block = np.cumsum(width) // limit
        cut = np.flatnonzero(np.diff(block)) + 1
        bounds = np.concatenate(([0], cut, [batch.num_rows]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield batch.slice(int(a), int(b - a))


def texts_of(batch, column: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def numbers(batch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


class Words:
    """Words of several texts in a row: hash, text index, and place in the words joined by one space each."""

    def __init__(self, texts: list[bytes]):
        parts = [t.split() for t in texts]  # bytes.split() cuts at exactly the six ASCII blanks
        self.count = np.fromiter(map(len, parts), np.int64, len(parts))
        words = list(chain.from_iterable(parts))
        n = len(words)
        self.n = n
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.doc = np.repeat(np.arange(len(parts)), self.count)
        length = np.fromiter(map(len, words), np.int64, n)
        self.start = np.concatenate(([0], np.cumsum(length + 1)))  # of word i; start[i + 1] - 1 is its end
        self.joined = b" ".join(words) + b" "
        self.words = words

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, self.n)

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        return self.joined[self.start[i]: self.start[j] - 1] if j > i else b""


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def run_hash(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of x[i:i+width] for every i with a whole run; built by doubling, so it doesn't depend on i."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, level, block = None, 0, 0, x.astype(np.uint64)
    size = 1
    while True:
        if width & size:
            if out is None:
                out, done = block.copy(), size
            else:
                m = len(block) - done
                out = out[:m] * _ODD[(level + 3) % 9] + block[done: done + m]
                done += size
        if size * 2 > width:
            break
        block = block[:-size] * _ODD[level % 9] + block[size:]
        block ^= block >> np.uint64(29)
        size *= 2
        level += 1
    out = out[:n].copy()
    out ^= out >> np.uint64(32)
    out *= _ODD[4]
    out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i with a whole window."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size:]) if width > size else x


PLACES = np.uint64((1 << 24) - 1)


def minimiser_places(gram: np.ndarray, grams: int) -> np.ndarray:
    """Place of the smallest (leftmost among equals) of `grams` consecutive gram hashes, for every start."""
    n, step = len(gram) - grams + 1, 1 << 22
    out = [np.zeros(0, np.int64)]
    for a in range(0, n, step):  # a key holds the place inside a stretch, so a text may be of any length
        part = gram[a: min(a + step, n) + grams - 1]
        key = (part & ~PLACES) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(key, grams) & PLACES).astype(np.int64) + a)
    return np.concatenate(out)


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs in an array whose change marks a new run."""
    if len(same) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(np.diff(same)) + 1))
    return start, np.diff(np.concatenate((start, [len(same)])))


def true_runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:n]) > 0


def span_lists(batch, column: str, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """A list<struct> column as (row of each element, field, field, ...)."""
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
    flat = col.flatten()
    return (np.repeat(np.arange(len(size)), size), *(np.asarray(flat.field(n)) for n in names))
