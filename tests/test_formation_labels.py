"""A pass labels documents where they are read; no text is joined to the posts that carry it."""

from pyspark.sql import functions as F

from claimlens.operators import formation as C
from claimlens.plans import catalog_core as K
from claimlens.plans import formation_run
from claimlens.plans.views import Model


def test_labels_by_document_are_the_labels_of_posts(spark):
    docs = spark.createDataFrame([(1, "they lied and failed us"), (2, "I support this"), (3, None), (4, "plain words")], "doc_id int, text string")
    posts = spark.createDataFrame([(10 + i, d) for i, d in enumerate([1, 1, 2, 3, 4, 4, 9])], "post_id int, doc_id int")
    attached = posts.select("post_id", F.lit(7).alias("claim_id"))
    want = C.label_attached(attached, posts.join(docs, "doc_id").select("post_id", "text"))
    got = C.label_by_document(attached, posts, C.document_stances(docs))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_pass_never_writes_posts_with_texts(spark, monkeypatch):
    plans = {}
    plain = formation_run.materialize
    monkeypatch.setattr(formation_run, "materialize", lambda df, name="step": (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), plain(df, name))[1])
    K.formation(Model(spark, "/root/testdata/sf0.001"))
    assert "text#" not in plans["attached"] and "text#" in plans["stances"]
