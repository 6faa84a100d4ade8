"""One formation pass over a model: attach, cluster, build claims, assign topics, update centroids, rescore."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import Settings
from ..operators import formation as C
from ..operators import scoring as Q
from ..operators.lineage import materialize


@dataclass
class FormationInputs:
    posts: DataFrame      # posts of the model; claim_id NULL where a post belongs to no claim yet
    vectors: DataFrame    # vec_id, embedding
    claims: DataFrame     # claims with topic_id and embedding
    topics: DataFrame     # topic_id, name
    texts: DataFrame      # doc_id, text
    corpus: DataFrame     # source_id, embedding
    topic_state: DataFrame | None = None  # sums behind the centroids; None: worked out from the claims


def form(inputs: FormationInputs, s: Settings, as_of: str, epsilon: float | None = None, min_size: int = 2, levels: int = 8) -> dict[str, DataFrame]:
    """Tables of a pass by name.

    attached, clusters: the two ways a post comes to a claim. claims: the new ones, with id and topic. topics: new topics.
    topic_state: the sums with the new claims added. posts: all posts with their claim and stance after the pass.
    scores: every claim of a topic that gained a post, scored again. summary: one row of counts. The new claims, the
    attached posts and the clusters are written once; their ids follow from what they hold, so a pass that is run again
    gives the same rows.
    """
    threshold = s["clustering.claim_attach_threshold"]
    stances = materialize(C.document_stances(inputs.texts), "stances")
    existing = inputs.claims.filter("claim_type = 'existing'")
    attached = materialize(C.label_by_document(C.attach_to_claims(inputs.posts, inputs.vectors, existing, threshold), inputs.posts, stances), "attached")
    rest = inputs.posts.filter("claim_id IS NULL AND vec_id IS NOT NULL").join(attached.select("post_id"), "post_id", "left_anti")
    clusters = materialize(C.density_cluster_posts(rest.select("post_id", "vec_id"), inputs.vectors, threshold if epsilon is None else epsilon, min_size, levels), "clusters")

    built = C.build_claims(clusters, inputs.posts, inputs.texts).join(inputs.vectors.select("vec_id", "embedding"), "vec_id")
    built = materialize(built.withColumn("claim_id", C.stable_id(F.concat(F.lit("claim:"), F.col("cluster").cast("string")))), "built")
    state = inputs.topic_state if inputs.topic_state is not None else C.topic_sums(inputs.claims)
    known = inputs.topics.select("topic_id", "name").join(C.topic_centroids(state), "topic_id", "left")
    assigned = materialize(C.assign_topics(built.select("claim_id", "topic_label", "embedding"), known, s["clustering.topic_attach_threshold"]), "assigned")
    claims = built.join(assigned, "claim_id")
    new_state = C.merged_topic_sums(state, C.topic_sums(claims.select("topic_id", "embedding")))

    came = attached.select("post_id", F.col("claim_id").alias("found"), F.col("stance").alias("said")).unionByName(
        clusters.join(built.select("cluster", "claim_id"), "cluster").join(inputs.posts.select("post_id", "doc_id"), "post_id").join(stances, "doc_id").select(
            "post_id", F.col("claim_id").alias("found"), F.col("stance").alias("said")))
    posts = inputs.posts.join(came, "post_id", "left").withColumns(
        {"claim_id": F.coalesce("claim_id", "found"), "stance": F.when(F.col("claim_id").isNull(), F.col("said")).otherwise(F.col("stance"))}).drop("found", "said")
    fresh = claims.select("claim_id", F.lit("existing").alias("claim_type"), "claim_statement", "topic_id", "status", F.col("first_caught_at").alias("created_at"), "embedding")
    all_claims = inputs.claims.unionByName(fresh, allowMissingColumns=True)
    touched = came.select(F.col("found").alias("claim_id")).distinct().join(all_claims.select("claim_id", "topic_id"), "claim_id").select("topic_id").distinct()
    touched = materialize(touched, "touched")
    in_topic = all_claims.join(touched, "topic_id", "left_semi")
    scores = Q.rescore(in_topic, posts, inputs.corpus, s, as_of)
    new_topics = assigned.filter("how = 'new'").select("topic_id", F.col("topic_name").alias("name")).distinct()
    counts = new_topics.agg(F.count(F.lit(1)).alias("topics_created")).crossJoin(touched.agg(F.count(F.lit(1)).alias("topics_rescored")))  # one row each
    return {
        "attached": attached, "clusters": clusters, "claims": claims.drop("embedding"), "topics": new_topics, "topic_state": new_state,
        "posts": posts, "scores": scores, "summary": C.formation_summary(attached, clusters).crossJoin(counts),
    }
