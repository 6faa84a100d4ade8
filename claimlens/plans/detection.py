"""One detection run over all its claims: scope, signals, fusion, communities, gate, metrics, evidence."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import FAMILY_WEIGHTS, DetectorParameters
from ..operators import evidence as V
from ..operators import graph as X
from ..operators import metrics as M
from ..operators import signals as N
from ..operators import textdup as D
from ..operators.fusion import effective_weights, fuse_edges, strong_edges
from ..operators.gate import offtopic_clusters, relevance_gate
from ..operators.lineage import materialize


@dataclass
class Inputs:
    posts: DataFrame            # posts of the model, with doc_id
    claims: DataFrame
    texts: DataFrame            # doc_id, text
    accounts: DataFrame
    vectors: DataFrame | None = None      # doc_id, embedding
    followers: DataFrame | None = None    # account_id, follows; None = family unavailable
    exclusions: DataFrame | None = None   # entry: an account id or a handle
    phrases: DataFrame | None = None      # phrase
    earlier_members: DataFrame | None = None   # network_id, account_id of stored networks
    age_baseline: DataFrame | None = None      # age_hours


def text_links(units: DataFrame, vectors: DataFrame | None, tau_dup: float, tau_sem: float) -> DataFrame:
    near = D.near_duplicate_texts(units, tau_dup)
    if vectors is None:
        return D.duplicate_links(near)
    near = materialize(near.select("text_a", "text_b"), "near")
    by_text = units.filter("doc_id = text_id").select("text_id").join(vectors.withColumnRenamed("doc_id", "text_id"), "text_id")
    classes, pairs = D.semantic_duplicate_texts(materialize(by_text, "text-vectors"), tau_sem)
    return D.duplicate_links(near, classes, pairs)


def pair_families(scope: DataFrame, eligible: DataFrame, links: DataFrame, candidates: DataFrame, followers: DataFrame | None, accounts: DataFrame, p: DetectorParameters) -> list:
    """The families of a run that has data for them; account similarity follows from their pairs."""
    traits = N.edge_traits(scope, eligible, candidates, accounts, p.bin_width_seconds)
    weights = effective_weights({f: f != "w_struct" or followers is not None for f in FAMILY_WEIGHTS}, p.weights)
    bounds = N.EdgeBounds(traits, weights, p.edge_threshold, p.family_strength, p.provenance_half_life_hours)
    out = [N.TimeFamily(scope, p.bin_width_seconds, p.null_model_alpha, bounds), N.TextFamily(eligible, links), N.AmpFamily(scope, bounds)]
    return out if followers is None else [*out, N.StructFamily(candidates, followers, bounds)]


def edge_table(scope: DataFrame, eligible: DataFrame, links: DataFrame, candidates: DataFrame, followers: DataFrame | None, accounts: DataFrame,
               p: DetectorParameters, reports: dict[str, dict] | None = None) -> DataFrame:
    """Fused edges. With two families required, account similarity cannot make an edge where no other family is strong,
    and only strong pairs are searched for; a run that lets one family alone make an edge lists all pairs."""
    if p.min_signal_families >= 2:
        families = pair_families(scope, eligible, links, candidates, followers, accounts, p)
        meta = lambda pairs: N.w_meta(pairs, accounts, p.provenance_half_life_hours)
        return strong_edges(families, meta, p.weights, p.edge_threshold, p.min_signal_families, p.family_strength, reports)
    signals = {
        "w_time": N.w_time(scope, p.bin_width_seconds, p.null_model_alpha), "w_text": N.w_text(eligible, links), "w_amp": N.w_amp(scope),
        "w_struct": None if followers is None else N.w_struct(candidates, followers),
        "w_meta": N.w_meta(N.candidate_account_pairs(candidates), accounts, p.provenance_half_life_hours)}
    return fuse_edges(signals, p.weights, p.edge_threshold, p.min_signal_families, p.family_strength)


class Tables(Mapping):
    """Tables by name, each built when it is first read; a step that several tables share is built once."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def detect(inputs: Inputs, start: str, end: str, as_of: str, p: DetectorParameters = DetectorParameters()) -> Tables:
    """Tables of a run by name; each is a DataFrame ready to be written by claim or network, and built when it is asked for."""
    cand = N.candidate_posts(inputs.posts, inputs.claims, start, end)
    excluded = None if inputs.exclusions is None else materialize(N.listed_accounts(inputs.exclusions, inputs.accounts), "excluded")
    candidates = materialize(N.select_candidates(cand, excluded, p.candidate_cap), "candidates")
    scope = materialize(N.in_scope(cand, candidates), "scope")
    hours, network_id = p.window_days * 24.0, F.concat_ws(":", F.col("g").cast("string"), F.col("community")).alias("network_id")
    claim_id = F.col("g").alias("claim_id")

    def eligible():
        return materialize(D.eligible_posts(scope, t["units"], p.min_post_length, inputs.phrases), "eligible")

    def links():
        return materialize(text_links(D.units_of(t["units"], t["eligible"]), inputs.vectors, p.dup_threshold, p.sem_threshold), "links")

    def edges():
        return materialize(edge_table(scope, t["eligible"], t["links"], candidates, inputs.followers, inputs.accounts, p), "edges")

    def shape():
        return materialize(X.retain(X.community_shape(t["core"], t["parts"]), p.min_cluster_size, p.min_internal_density), "shape")

    def members():
        member_rows = t["parts"].join(t["shape"].select("g", "community"), ["g", "community"], "left_semi")
        return materialize(member_rows.select(network_id, claim_id, F.col("node").alias("account_id")), "members")

    def network_shape():
        return t["shape"].select(network_id, claim_id, "density", "conductance")

    def gate():
        totals = N.total_posts(inputs.posts, t["members"], start, end)
        return materialize(relevance_gate(t["members"], t["net_posts"], totals, p.anchor_share, p.min_claim_posts, p.min_link_strength), "gate")

    def metrics():
        w_time = N.w_time_of(scope, t["members"], p.bin_width_seconds, p.null_model_alpha)
        return materialize(M.signal_breadth(M.coordination_score(
            M.synchrony(t["net_posts"], w_time), M.duplication(t["net_posts"], t["net_eligible"], t["links"]), M.cohesion(t["network_shape"]),
            M.provenance_anomaly(t["members"], inputs.accounts, as_of, inputs.age_baseline), M.automation(t["members"], t["net_posts"], hours))), "scores")

    def passed():
        return t["members"].join(t["gate"].filter("passed").select("network_id"), "network_id", "left_semi")

    def of_passed(posts: DataFrame) -> DataFrame:
        return posts.join(t["passed"].select("network_id").distinct(), "network_id", "left_semi")

    def parents():
        known = t["passed"].select("network_id", "account_id")
        order = t["passed"].select("network_id", "claim_id").distinct()
        seq = order.select("network_id", F.concat(F.lit("1:"), F.lpad(F.col("claim_id").cast("string"), 20, "0"), F.lit(":"), F.col("network_id")).alias("seq"))
        if inputs.earlier_members is not None:
            known = known.unionByName(inputs.earlier_members)
            seq = seq.unionByName(inputs.earlier_members.select("network_id").distinct().withColumn("seq", F.concat(F.lit("0:"), "network_id")))
        return V.recurrence_parent(known, seq, p.recurrence_threshold).join(order.select("network_id"), "network_id", "left_semi")

    def networks():
        cut = candidates.groupBy("claim_id").agg(F.max("truncated").alias("truncated"))
        table = (
            V.network_table(t["passed"], t["net_posts"]).join(t["metrics"], "network_id").join(t["network_shape"].drop("claim_id"), "network_id")
            .join(cut, "claim_id"))
        missing = int(inputs.followers is None)
        banded = M.confidence_band(table, F.col("truncated"), missing, p.high_score_cutoff, p.high_breadth_cutoff, p.medium_score_cutoff, p.medium_breadth_cutoff)
        if excluded is not None:
            banded = banded.join(M.allowlist_suppressed(t["passed"], excluded), "network_id", "left")
        return banded.join(V.fingerprint(t["passed"], t["terms"]), "network_id").join(parents(), "network_id", "left")

    def annex():
        rates = V.duplication_rate(of_passed(t["net_posts"]), of_passed(t["net_eligible"]), t["links"])
        return V.account_annex(t["passed"], of_passed(t["net_posts"]), t["edges"], rates, inputs.accounts, V.network_centrality(t["edges"], t["passed"]))

    t = Tables(
        candidates=lambda: candidates, units=lambda: D.text_units(inputs.texts.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")),
        eligible=eligible, links=links, edges=edges,
        core=lambda: X.k_core(t["edges"].select(F.col("claim_id").alias("g"), "a", "b", F.col("w_total").alias("w")), p.k_core),
        parts=lambda: X.communities(t["core"], p.resolution), shape=shape, members=members, network_shape=network_shape,
        net_posts=lambda: materialize(M.network_posts(scope, t["members"]), "netposts"), net_eligible=lambda: M.network_posts(t["eligible"], t["members"]),
        gate=gate, metrics=metrics, passed=passed, networks=networks, offtopic=lambda: offtopic_clusters(t["gate"], t["metrics"]),
        terms=lambda: V.top_terms(t["net_posts"], inputs.texts),
        evidence_posts=lambda: V.duplicate_groups(of_passed(t["net_posts"]), of_passed(t["net_eligible"]), t["links"], inputs.texts),
        bursts=lambda: V.burst_timeline(of_passed(t["net_posts"])), edge_snapshot=lambda: V.edge_snapshot(t["edges"], t["passed"]), annex=annex,
        comparison=lambda: V.comparison_accounts(candidates, t["members"], N.total_posts(inputs.posts, candidates, start, end)),
        snapshot=lambda: V.snapshot_digest(t["evidence_posts"], as_of))
    return t
