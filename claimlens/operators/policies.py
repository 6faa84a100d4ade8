"""Policy matching and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .vectors import best_match, top_k


def policy_text(policies: DataFrame) -> DataFrame:
    """Title, description and whole document, as embedded for matching."""
    parts = F.concat_ws("\n", "title", F.coalesce("description", F.lit("")), F.coalesce("document_text", F.lit("")))
    return policies.select("policy_id", F.regexp_replace(parts, r"^\s+|\s+$", "").alias("policy_text"))


def match_candidates(policies: DataFrame, claims: DataFrame, k: int | None = None, threshold: float = 0.35, key: str = "policy_id") -> DataFrame:
    """Existing claims at or above the threshold for each policy (or named vector); with k, the k most similar of them."""
    existing = claims.filter("claim_type = 'existing'").select("claim_id", "embedding")
    return top_k(policies.select(key, "embedding"), key, existing, "claim_id", k, threshold)


def confirm_matches(candidates: DataFrame, policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates where a title word of more than three letters occurs in the statement."""
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.char_length(w) > 3)
    p = policies.select("policy_id", words.alias("words"))
    c = claims.select("claim_id", F.lower("claim_statement").alias("s"))
    joined = candidates.join(p, "policy_id").join(c, "claim_id")
    return joined.filter(F.exists("words", lambda w: F.contains(F.col("s"), w))).select(*candidates.columns)


def rerun_set(policies: DataFrame, existing_links: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Policies to (re)match: never matched, failed last time, or forced."""
    done = existing_links.select("policy_id").distinct().withColumn("done", F.lit(True))
    out = policies.select("policy_id", "last_error").join(done, "policy_id", "left")
    cond = F.col("done").isNull() | F.col("last_error").isNotNull()
    if forced is not None:
        out = out.join(forced.select("policy_id").distinct().withColumn("forced", F.lit(True)), "policy_id", "left")
        cond = cond | F.coalesce("forced", F.lit(False))
    return out.filter(cond).select("policy_id")


def supersede_links(old: DataFrame, confirmed: DataFrame, rerun: DataFrame) -> DataFrame:
    """Links after a run: those of re-run policies are replaced, all others stay."""
    kept = old.join(rerun, "policy_id", "left_anti").select("policy_id", "claim_id", F.lit("kept").alias("origin"))
    new = confirmed.join(rerun, "policy_id", "left_semi").select("policy_id", "claim_id", F.lit("new").alias("origin"))
    return kept.unionByName(new)


def supersede_predicted(claims: DataFrame, rerun: DataFrame) -> DataFrame:
    """Claims after a run: predicted claims of re-run policies are gone."""
    doomed = claims.filter("claim_type = 'non_existing'").join(rerun, "policy_id", "left_semi").select("claim_id")
    return claims.join(doomed, "claim_id", "left_anti")


def match_counts(policies: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    linked = links.groupBy("policy_id").agg(F.count(F.lit(1)).alias("linked"))
    predicted = claims.filter("claim_type = 'non_existing'").groupBy("policy_id").agg(F.count(F.lit(1)).alias("predicted"))
    zero = F.lit(0).cast("bigint")
    return policies.select("policy_id").join(linked, "policy_id", "left").join(predicted, "policy_id", "left").select(
        "policy_id", F.coalesce("linked", zero).alias("matched_claims"), F.coalesce("predicted", zero).alias("predicted_claims"))


def nearest_policy(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Most similar policy that has a vector; when none has one, the newest policy; none at all gives no row."""
    if policies.filter("embedding IS NOT NULL").isEmpty():
        newest = policies.orderBy(F.col("created_at").desc(), F.col("policy_id")).select("policy_id").first()
        out = claims.select("claim_id", F.lit(newest["policy_id"] if newest else None).cast(policies.schema["policy_id"].dataType).alias("policy_id"))
        return out.filter("policy_id IS NOT NULL")
    return best_match(claims, "claim_id", policies, "policy_id").select("claim_id", "policy_id")


def retrieve_fault_lines(queries: DataFrame, key: str, fault_lines: DataFrame, k: int = 3) -> DataFrame:
    """(key, fault_line_id, similarity, rank): the k nearest fault lines of each query."""
    found = top_k(queries, key, fault_lines, "fault_line_id", k)
    w = Window.partitionBy(key).orderBy(F.col("similarity").desc(), F.col("fault_line_id"))
    return found.withColumn("rank", F.row_number().over(w))


def named_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the stored vectors that rows name: what depends on the vector only is worked out once for
    each and then joined to the rows."""
    return vectors.join(rows.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "embedding")


def uncovered_context(blocks: DataFrame, key: str, covered: DataFrame) -> DataFrame:
    """Grounding block plus the statements already matched, all of them: one text per policy is what is asked for."""
    listed = covered.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_id", "claim_statement"))), lambda x: F.concat(F.lit("- "), x["claim_statement"])), "\n").alias("listed"))
    # Fixed value: the sentence in front of the list.
    head = "\n\nClaims already matched to this policy (predict something NOT already covered by these):\n"
    return blocks.join(listed, key, "left").select(key, F.concat("block", F.coalesce(F.concat(F.lit(head), "listed"), F.lit(""))).alias("context"))
