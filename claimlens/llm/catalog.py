"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bytes_dedup, conversations, decontaminate, exact_dedup, licenses, merkle, mixing, passages, pii, quality, simhash, toxicity, urls
from .texts import table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op3_superkmer_passages")
def op3(spark, sf_dir):
    out = passages.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_content_sort", exact_dedup.SQL)
def op9(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_simhash_grid")
def op10(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op7_column_suffixes")
def op7(spark, sf_dir):
    out = bytes_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_kneser_ney_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op8_blockmax_leaks")
def op8(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_weak_supervision_pii")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = pii.find_spans(docs, pii.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "added")).alias("spans"),
    )


@query("op2_raked_mix", mixing.SQL)
def op2(spark, sf_dir):
    return mixing.weigh(table(spark, sf_dir, "documents"))


@query("op4_licence_digests", licenses.SQL)
def op4(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op5_link_trust")
def op5(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op11_least_audit_repair")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.audits(rows, conversations.damaged(rows))


@query("op12_merkle_manifest")
def op12(spark, sf_dir):
    return merkle.proofs(table(spark, sf_dir, "documents"), merkle.no_line_ends)


@query("op13_adaptive_quality", quality.SQL)
def op13(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))
