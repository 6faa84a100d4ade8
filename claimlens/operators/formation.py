"""Claim formation: attach posts to claims, cluster the rest, build claims, assign topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .density import density_clusters
from .graph import connected_components
from .lineage import materialize
from .vectors import best_match, pairs_above, unit_vectors, vector_classes


def attach_to_claims(posts: DataFrame, vectors: DataFrame, claims: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(post_id, claim_id, similarity) for unattached posts: the best claim at or above the threshold.

    Similarity is worked out once per stored vector and then joined to the posts that carry it.
    """
    open_posts = posts.filter(F.col("claim_id").isNull() & F.col("vec_id").isNotNull())
    needed = vectors.join(open_posts.select("vec_id").distinct(), "vec_id", "left_semi")
    best = best_match(needed, "vec_id", claims.select("claim_id", "embedding"), "claim_id", threshold)
    return open_posts.select("post_id", "vec_id").join(best, "vec_id").select("post_id", "claim_id", "similarity")


def label_attached(attached: DataFrame, texts: DataFrame) -> DataFrame:
    """Stance is labelled after attaching; a post whose label failed (no text) stays unattached."""
    return attached.join(texts, "post_id").withColumn("stance", T.stance(F.col("text"))).filter("stance IS NOT NULL").drop("text")


def document_stances(texts: DataFrame) -> DataFrame:
    """(doc_id, stance): the label of each text, worked out where the text is read, so that no text is joined to posts."""
    return texts.select("doc_id", T.stance(F.col("text")).alias("stance"))


def label_by_document(attached: DataFrame, posts: DataFrame, stances: DataFrame) -> DataFrame:
    """label_attached for posts that name their text: the same rows from labels of documents."""
    return attached.join(posts.select("post_id", "doc_id"), "post_id").join(stances, "doc_id").filter("stance IS NOT NULL").drop("doc_id")


def cluster_posts(posts: DataFrame, vectors: DataFrame, epsilon: float = 0.55, min_size: int = 2) -> DataFrame:
    """(post_id, cluster): connected groups at similarity epsilon with at least min_size posts.

    Posts sharing a vector are one graph node, so copies add members and no edges.
    """
    needed = vectors.join(posts.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "embedding")
    classes = vector_classes(needed, "vec_id")
    reps = needed.join(classes.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi")
    edges = pairs_above(reps, "vec_id", epsilon, forest=True).select(F.lit(0).alias("g"), "a", "b")
    parts = connected_components(edges).select(F.col("node").alias("rep"), "component")
    placed = (
        posts.join(classes, "vec_id").join(parts, "rep", "left")
        .select("post_id", F.coalesce("component", "rep").alias("cluster"))
    )
    big = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return placed.join(big.select("cluster"), "cluster", "left_semi").select("post_id", "cluster")


def density_cluster_posts(posts: DataFrame, vectors: DataFrame, epsilon: float = 0.55, min_size: int = 2, levels: int = 8) -> DataFrame:
    """(post_id, cluster): stable density clusters of the vectors at similarity epsilon and above; noise gives no row.

    Unlike cluster_posts, two dense groups that a chain of posts connects stay two clusters.
    """
    needed = vectors.join(posts.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "embedding")
    classes = materialize(vector_classes(needed, "vec_id"), "classes")
    reps = needed.join(classes.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi")
    members = posts.join(classes, "vec_id")
    nodes = members.groupBy(F.col("rep").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    edges = pairs_above(reps, "vec_id", epsilon, forest=True).select("a", "b", F.col("similarity").alias("s"))
    found = density_clusters(edges, nodes, epsilon, min_size, levels)
    return members.join(found.withColumnRenamed("node", "rep"), "rep").select("post_id", "cluster")


def build_claims(clusters: DataFrame, posts: DataFrame, texts: DataFrame) -> DataFrame:
    """One claim per cluster: statement and vector of its earliest post, topic label, status, first time."""
    full = clusters.join(posts.select("post_id", "doc_id", "vec_id", "created_at"), "post_id")
    facts = full.groupBy("cluster").agg(
        F.min("created_at").alias("first_caught_at"), F.count(F.lit(1)).alias("post_count"),
        F.min_by(F.struct("doc_id", "vec_id"), F.struct("created_at", "post_id")).alias("lead"))
    lead = facts.select("cluster", "first_caught_at", "post_count", "lead.doc_id", "lead.vec_id")
    return lead.join(texts.select("doc_id", "text"), "doc_id").select(
        "cluster", F.col("text").alias("claim_statement"), T.topic(F.col("text")).alias("topic_label"),
        F.lit("unreviewed").alias("status"), "vec_id", "first_caught_at", "post_count")


def assign_topics(claims: DataFrame, topics: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(claim_id, topic_id, topic_name, how): name match, else nearest centroid, else a new topic by label.

    claims: claim_id, topic_label, embedding; topics: topic_id, name, embedding. All claims are matched
    against the centroids as they stand at the start of the batch. The id of a new topic follows from its name, so
    batches that run apart, or again, give the same topic the same id.
    """
    norm = lambda c: F.lower(F.trim(c))
    topics = topics.withColumn("topic_id", F.col("topic_id").cast("bigint"))
    by_name = topics.groupBy(norm("name").alias("k")).agg(F.min(F.struct("topic_id", "name")).alias("t"))
    named = claims.withColumn("k", norm("topic_label")).join(by_name, "k", "left")
    hit = named.filter("t IS NOT NULL").select("claim_id", "t.topic_id", F.col("t.name").alias("topic_name"), F.lit("name").alias("how"))
    rest = named.filter("t IS NULL").select("claim_id", "k", "topic_label", "embedding")
    best = best_match(rest, "claim_id", topics.select("topic_id", "embedding"), "topic_id", threshold)
    near = rest.select("claim_id").join(best, "claim_id").join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id").select(
        "claim_id", "topic_id", "topic_name", F.lit("centroid").alias("how"))
    left = rest.select("claim_id", "k", "topic_label").join(best.select("claim_id"), "claim_id", "left_anti")
    names = left.groupBy("k").agg(F.min(F.trim("topic_label")).alias("topic_name"))
    new = left.join(names, "k").select("claim_id", stable_id("k").alias("topic_id"), "topic_name", F.lit("new").alias("how"))
    return hit.unionByName(near).unionByName(new)


def stable_id(name: str):
    """A 60-bit id from a name: the same in every batch."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def topic_sums(claims: DataFrame) -> DataFrame:
    """(topic_id, pos, n, total): the state behind centroids, one row for each topic and dimension; claims without a
    vector or a topic don't count."""
    rows = claims.filter("topic_id IS NOT NULL AND embedding IS NOT NULL").select("topic_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("topic_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("total"))


def merged_topic_sums(*states: DataFrame) -> DataFrame:
    """States of several batches added up: a centroid is updated by the claims of a batch, not worked out again."""
    return reduce(DataFrame.unionByName, states).groupBy("topic_id", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def topic_centroids(state: DataFrame) -> DataFrame:
    """(topic_id, embedding) of a state: the mean of each topic's claims, scaled to length 1."""
    parts = state.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("total") / F.col("n")).alias("m")))).alias("parts"))
    return unit_vectors(parts.select("topic_id", F.transform("parts", lambda p: p["m"]).alias("embedding")))


def formation_summary(attached: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: claims created, claims updated, posts clustered."""
    rows = attached.select(F.lit("u").alias("kind"), F.col("claim_id").cast("string").alias("k")).unionByName(
        clusters.select(F.lit("c").alias("kind"), F.col("cluster").cast("string").alias("k")))
    per = rows.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.when(F.col("kind") == "c", 1)).alias("claims_created"),
        F.count(F.when(F.col("kind") == "u", 1)).alias("claims_updated"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("posts_clustered"))
