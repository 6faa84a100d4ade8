"""Account similarity parts as expressions over two account structs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

HANDLE_TEMPLATE = r"^([a-z]+)_([a-z]+)([0-9]{2,4})$"


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def handle_facts(handle: Column) -> dict[str, Column]:
    """What a handle is compared by, so that it is worked out once an account and not once a pair."""
    h = F.lower(_filled(handle))
    return {"handle": h, "digits": F.char_length(F.regexp_extract(h, HANDLE_TEMPLATE, 3)), "first3": F.left(h, F.lit(3)), "last3": F.right(h, F.lit(3))}


def handles_alike(x: dict[str, Column], y: dict[str, Column]) -> Column:
    edit = 1 - F.levenshtein(x["handle"], y["handle"]) / F.greatest(F.char_length(x["handle"]), F.char_length(y["handle"]))
    bonus = (
        F.when((x["digits"] > 0) & (x["digits"] == y["digits"]), 0.5)
        .when((x["first3"] == y["first3"]) | (x["last3"] == y["last3"]), 0.25)
        .otherwise(0.0)
    )
    return F.least(F.greatest(0.5 * edit + bonus, F.lit(0.0)), F.lit(1.0))


def handle_similarity(a: Column, b: Column) -> Column:
    return handles_alike(handle_facts(a), handle_facts(b))


def creation_proximity(a: Column, b: Column, half_life_hours: float = 36.0) -> Column:
    seconds = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1e6
    return F.exp(-seconds / 3600 / half_life_hours)


PIECE = 15  # hex digits that fit a bigint


def image_facts(image: Column) -> dict[str, Column]:
    """A hash that is hex, else NULL, and its first two pieces as numbers."""
    image = F.when(image.rlike(r"^[0-9a-fA-F]+$"), image)
    number = lambda i: F.coalesce(F.conv(F.nullif(F.substring(image, i, PIECE), F.lit("")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return {"image": image, "piece1": number(1), "piece2": number(1 + PIECE)}


def images_alike(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """1 - hamming/bits of equal-length hex hashes, compared in 15-digit pieces; NULL when not hex."""
    a, b = x["image"], y["image"]
    starts = F.sequence(F.lit(1 + 2 * PIECE), F.char_length(a), F.lit(PIECE))

    def piece(c, i):
        return F.conv(F.substring(c, i, F.lit(PIECE)), 16, 10).cast("bigint")

    more = F.aggregate(starts, F.lit(0), lambda s, i: s + F.bit_count(piece(a, i).bitwiseXOR(piece(b, i))).cast("int"))
    first = F.bit_count(x["piece1"].bitwiseXOR(y["piece1"])) + F.bit_count(x["piece2"].bitwiseXOR(y["piece2"]))
    differing = first + F.when(F.char_length(a) > 2 * PIECE, more).otherwise(0)
    return F.when(F.char_length(a) == F.char_length(b), 1 - differing / (4 * F.char_length(a)))


def image_similarity(a: Column, b: Column) -> Column:
    return images_alike(image_facts(a), image_facts(b))


def bio_similarity(a: Column, b: Column, n: int = 4) -> Column:
    """Jaccard of the distinct n-character windows (a shorter text is one). Windows are cut once per text and batch."""
    def jaccard(xs: pd.Series, ys: pd.Series) -> pd.Series:
        at, texts = pd.factorize(np.concatenate([xs.fillna(""), ys.fillna("")]).astype(object))
        grams = [{t[i:i + n] for i in range(max(len(t) - n + 1, 1))} for t in texts]
        pairs, back = np.unique(at[:len(xs)].astype(np.int64) * max(len(texts), 1) + at[len(xs):], return_inverse=True)
        ends = [divmod(int(p), len(texts)) for p in pairs]
        shared = np.array([len(grams[i] & grams[j]) for i, j in ends], dtype=np.int64)
        either = np.array([len(grams[i]) + len(grams[j]) for i, j in ends], dtype=np.int64) - shared
        return pd.Series((shared / np.maximum(either, 1))[back.ravel()])

    x, y = F.lower(_filled(a)), F.lower(_filled(b))
    return F.when(x.isNotNull() & y.isNotNull(), F.pandas_udf(jaccard, "double")(x, y))


def exact_match(a: Column, b: Column) -> Column:
    x, y = _filled(a), _filled(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, 1.0).otherwise(0.0))
