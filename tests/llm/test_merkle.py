import brute
import pytest
from pyspark.sql import functions as F

from claimlens.llm import merkle, places


def columns(frame):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def as_tuple(r):
    return (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)


@pytest.mark.parametrize("sizes", [[1], [3, 1, 28], [85]])
def test_proofs_match_brute_force(spark, sizes):
    rows, d = [], 0
    for s, n in enumerate(sizes):
        for i in range(n):
            d += 1
            rows.append((d * 7 % 1009, None if s == 1 else f"sé{s}", None if i % 5 == 0 else "en", None if i % 4 == 0 else i, [None, "", "a\nb\n", "ü" * i][i % 4]))
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = {r.doc_id: as_tuple(r) for r in merkle.proofs(frame, merkle.no_line_ends).collect()}
    want = brute.merkle(rows)
    assert got == want
    assert {v[5] for v in want.values()} == {True, False} or len(rows) < 4
    whole = merkle.proofs(frame).collect()
    assert all(r.verified and r.folded_root == r.root for r in whole)


def test_odd_rows(spark, docs, empty):
    assert merkle.proofs(empty, merkle.no_line_ends).count() == 0
    got = {r.doc_id: as_tuple(r) for r in merkle.proofs(docs, merkle.no_line_ends).collect()}
    assert got == brute.merkle(columns(docs))  # null text, empty text, null source and lang, a long text, clashing columns
    twice = docs.unionByName(docs.filter("doc_id = 5")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    out = merkle.manifest(twice).withColumn("end", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(out) == docs.count() + 2 and len({r.root for r in out}) == 1 and all(r.end == r.root for r in out)


def test_places_of_a_group_over_many_partitions(spark):
    rows = spark.range(5000).select(F.expr("case when id % 3 = 0 then 'hot' else concat('g', id % 700) end").alias("g"), F.expr("hash(id)").alias("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for totals in (False, True):
            out = places.ranked(rows, "g", ["x"], "places", totals).toPandas().sort_values(["g", "x"])
            assert (out.groupby("g").cumcount() == out.pos).all()
            assert not totals or (out.groupby("g").x.transform("size") == out.n).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
