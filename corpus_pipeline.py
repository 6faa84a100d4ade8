"""Training-data pipeline over `documents`: each stage reads the Parquet table its predecessor wrote.

toxicity, exact duplicates, near duplicates, benchmark leaks, then sampling to target weights. The first four return
the columns of documents; the last adds topic, tokens, mass and probability of the documents it samples.
"""

from __future__ import annotations

from claimlens.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from claimlens.llm.texts import table
from claimlens.operators.lineage import materialize


def drop_toxic(spark, docs, sf_dir):
    """Learns from the labelled rows of the documents it is given."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def drop_leaks(spark, docs, sf_dir):
    return decontaminate.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def sample(spark, docs, sf_dir):
    return mixing.weigh(docs, None, "text", "n_chars").filter("kept").drop("kept")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", sample)]

#: The learned and iterative stages have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
