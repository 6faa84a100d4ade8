"""SHA-256 over the ordered values of a group, fed value by value."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def ordered_digest(df: DataFrame, keys: list[str], value: str, separator: str = "|") -> DataFrame:
    """(keys, digest, n): hash of the group's values sorted and joined by the separator.

    Rows are shuffled by key and sorted inside partitions, and the hash takes them in one at a time:
    no group is ever held in memory. An order-dependent hash has to see its values in sequence.
    """
    rows = df.select(*keys, F.col(value).cast("string").alias("val")).repartition(*keys).sortWithinPartitions(*keys, "val")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys]
    schema = ", ".join(fields) + ", digest string, n bigint"

    def run(batches):
        key, h, n = None, None, 0

        def result():
            return pd.DataFrame([[*key, h.hexdigest(), n]], columns=[*keys, "digest", "n"])

        for pdf in batches:
            for here, part in pdf.groupby(keys, sort=False, dropna=False):
                if here != key:
                    if key is not None:
                        yield result()
                    key, h, n = here, hashlib.sha256(), 0
                h.update(((separator if n else "") + separator.join(part["val"])).encode("utf-8"))
                n += len(part)
        if key is not None:
            yield result()

    return rows.mapInPandas(run, schema)
