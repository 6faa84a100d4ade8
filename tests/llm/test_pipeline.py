"""The pipeline against its parts: every stage keeps the columns, its decisions take effect, nothing else is lost."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from claimlens.llm import decontaminate, mixing, toxicity
from claimlens.llm.texts import table

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = before = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    start = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    model = toxicity.train(before, table(spark, SF, "labels"))
    assert set(seen["toxicity"]) == {r.doc_id for r in toxicity.scores(before, model).filter("predicted = 0").collect()}
    squeeze = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    best = {}
    for d, t in seen["toxicity"].items():
        key = (-len(t or ""), d)
        best[squeeze(t)] = min(best.get(squeeze(t), key), key)
    assert set(seen["exact_dedup"]) == {d for _, d in best.values()}
    groups = brute.simhash_groups(seen["exact_dedup"].items())
    assert set(seen["near_dedup"]) == {c for _, c in groups.values()}
    rows = before.filter(F.col("doc_id").isin(list(seen["near_dedup"])))
    leaked = {r.doc_id for r in decontaminate.leaks(rows, table(spark, SF, "benchmark")).collect()}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - leaked
    kept = before.filter(F.col("doc_id").isin(list(seen["decontamination"])))
    assert set(seen["mixing"]) == {r.doc_id for r in mixing.weigh(kept).filter("kept").collect()}
    assert all(start[d] == t for d, t in seen["mixing"].items())
