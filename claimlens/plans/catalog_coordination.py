"""Registered queries: coordination signals, fusion, graph, metrics, evidence, run tables, streams.

Metrics and evidence are checked on fixed groups (accounts of one nation active on one claim), so
that they do not depend on the community search.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..config import FAMILY_WEIGHTS, DetectorParameters
from ..functions import text as T
from ..operators import evidence as V
from ..operators import graph as X
from ..operators import metrics as M
from ..operators import scoring as Q
from ..operators import signals as N
from ..operators import textdup as D
from ..operators.fusion import effective_weights_table
from ..operators.gate import offtopic_clusters, relevance_gate
from ..operators.lineage import materialize, new_path
from ..sources import sinks
from ..streaming import streams as ST
from .catalog_core import SETTINGS, claims_v, corpus_v
from .detection import Inputs, detect, edge_table, text_links
from .registry import query
from .views import AS_OF, VIEW_SQL, Model

START = "2024-01-01 00:00:00"
WINDOW_HOURS = 720.0
P = DetectorParameters(window_days=30, bin_width_seconds=3600, sem_threshold=0.40, edge_threshold=0.20)


def _listed(m: Model, accounts: DataFrame) -> DataFrame:
    """(entry): accounts by id, and the handles of a few others."""
    named = lambda rule: m.customer.filter(rule).select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("entry"))
    handles = accounts.join(named("c_acctbal > 9990").withColumnRenamed("entry", "account_id"), "account_id", "left_semi").select(F.col("handle").alias("entry"))
    return named("c_acctbal < -500").unionByName(handles)


class Run:
    """Shared steps of the checks below; each is built on first use."""

    def __init__(self, m: Model):
        self.m = m
        self._made = {}

    def _once(self, name, make, write=False):
        if name not in self._made:
            df = make()
            self._made[name] = materialize(df, name) if write else df
        return self._made[name]

    def accounts(self):
        return self._once("accounts", lambda: self.m.accounts, True)

    def cand(self):
        return self._once("cand", lambda: N.candidate_posts(self.m.posts, self.m.claims, START, AS_OF))

    def exclusions(self):
        return N.listed_accounts(_listed(self.m, self.accounts()), self.accounts())

    def candidates(self):
        return self._once("candidates", lambda: N.select_candidates(self.cand(), self.exclusions(), P.candidate_cap), True)

    def scope(self):
        return self._once("scope", lambda: N.in_scope(self.cand(), self.candidates()), True)

    def units(self):
        return self._once("units", lambda: D.text_units(self.m.documents))

    def phrases(self):
        low = self.m.labels.filter("quality = 0").select("doc_id")
        return self.m.documents.join(low, "doc_id", "left_semi").select(F.col("text").alias("phrase"))

    def eligible(self):
        return self._once("eligible", lambda: D.eligible_posts(self.scope(), self.units(), P.min_post_length, self.phrases()), True)

    def vectors(self):
        n = self.m.embeddings.count()
        return self.m.documents.select("doc_id", (F.col("doc_id") % n).alias("vec_id")).join(self.m.embeddings, "vec_id").select("doc_id", "embedding")

    def links(self):
        return self._once("links", lambda: text_links(D.units_of(self.units(), self.eligible()), self.vectors(), P.dup_threshold, P.sem_threshold), True)

    def edges(self):
        def make():
            return edge_table(self.scope(), self.eligible(), self.links(), self.candidates(), self.m.followers, self.accounts(), P)

        return self._once("edges", make, True)

    def graph(self):
        return self.edges().select(F.col("claim_id").alias("g"), "a", "b", F.col("w_total").alias("w"))

    def members(self):
        """(network_id, claim_id, account_id, community_id): accounts of one nation active on one claim."""
        active = self.scope().select("claim_id", "account_id").distinct()
        net = F.concat_ws("-", F.col("claim_id").cast("string"), F.col("community_id").cast("string"))
        return self._once("members", lambda: active.join(self.m.groups, "account_id").select(net.alias("network_id"), "claim_id", "account_id", "community_id"), True)

    def net_posts(self):
        return self._once("net_posts", lambda: M.network_posts(self.scope(), self.members()), True)

    def net_eligible(self):
        return self._once("net_eligible", lambda: M.network_posts(self.eligible(), self.members()), True)

    def shape(self):
        member = self.members().select(F.col("claim_id").alias("g"), F.col("account_id").alias("node"), F.col("community_id").alias("community"))
        return X.community_shape(self.graph(), member)

    def network_shape(self):
        return self.shape().select(F.concat_ws("-", F.col("g").cast("string"), F.col("community").cast("string")).alias("network_id"), "members", "density", "conductance")

    def member_w_time(self):
        return N.w_time_of(self.scope(), self.members(), P.bin_width_seconds, P.null_model_alpha)

    def totals(self):
        return N.total_posts(self.m.posts, self.candidates(), START, AS_OF)

    def baseline(self):
        age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("created_at_platform")) / 3.6e9
        return self.accounts().select(age.alias("age_hours"))

    def metrics(self):
        return self._once("metrics", lambda: M.coordination_score(
            M.synchrony(self.net_posts(), self.member_w_time(), 3600), M.duplication(self.net_posts(), self.net_eligible(), self.links()),
            M.cohesion(self.network_shape()), M.provenance_anomaly(self.members(), self.accounts(), AS_OF, self.baseline()),
            M.automation(self.members(), self.net_posts(), WINDOW_HOURS)), True)

    def gate(self):
        return relevance_gate(self.members(), self.net_posts(), self.totals(), 0.30, 8, 0.15)

    def evidence(self):
        return V.duplicate_groups(self.net_posts(), self.net_eligible(), self.links(), self.m.documents)


_RUNS: dict[tuple[str, str], Run] = {}


def shared_run(m: Model) -> Run:
    """One run per session and folder: its written stage tables serve every query below, as in a real run."""
    key = (m.spark.sparkContext.applicationId, m.tables.folder)
    if key not in _RUNS:
        _RUNS[key] = Run(m)
    return _RUNS[key]


def run_query(name):
    def register(fn):
        query(name)(lambda m: fn(shared_run(m)))
        return fn

    return register


# --- scope and signals ----------------------------------------------------------------------------


@run_query("n01_candidate_posts")
def _(r):
    return r.cand().select("claim_id", "account_id", "post_id", "source")


@run_query("n02_select_candidates")
def _(r):
    return r.candidates()


@run_query("n03_total_posts")
def _(r):
    return r.totals()


@run_query("n04_account_dimension")
def _(r):
    seen = r.m.posts.filter("author_id IS NOT NULL").select(F.when(F.col("source") == "radio", F.concat(F.lit("radio-"), "author_id")).otherwise(F.col("author_id")).alias("account_id"))
    return N.account_dimension(seen, r.accounts())


@run_query("n05_w_time")
def _(r):
    return N.w_time(r.scope(), P.bin_width_seconds, P.null_model_alpha)


@run_query("n06_normalize_text")
def _(r):
    norm = T.normalize_text(F.col("text"))
    return r.m.documents.select("doc_id", F.md5(norm).alias("norm_md5"), F.char_length(norm).alias("norm_length"))


@run_query("n07_eligible_posts")
def _(r):
    return r.eligible().select("claim_id", "account_id", "post_id", "text_id")


@run_query("n08_near_duplicates")
def _(r):
    copies = r.units().groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"))
    near = D.near_duplicate_texts(r.units(), P.dup_threshold)
    a = copies.select(F.col("text_id").alias("text_a"), F.col("copies").alias("copies_a"))
    b = copies.select(F.col("text_id").alias("text_b"), F.col("copies").alias("copies_b"))
    return near.join(a, "text_a").join(b, "text_b").select("text_a", "text_b", F.round("jaccard", 6).alias("jaccard"), "copies_a", "copies_b")


@run_query("n09_semantic_duplicates")
def _(r):
    by_text = r.units().filter("doc_id = text_id").select("text_id").join(r.vectors().withColumnRenamed("doc_id", "text_id"), "text_id")
    classes, pairs = D.semantic_duplicate_texts(by_text, P.sem_threshold)
    size = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(size.select(F.col("rep").alias("a"), F.col("n").alias("texts_a")), "a").join(size.select(F.col("rep").alias("b"), F.col("n").alias("texts_b")), "b").select(
        F.col("a").alias("text_a"), F.col("b").alias("text_b"), F.round("similarity", 6).alias("similarity"), "texts_a", "texts_b")


@run_query("n10_w_text")
def _(r):
    return N.w_text(r.eligible(), r.links())


@run_query("n11_w_amp")
def _(r):
    return N.w_amp(r.scope())


def _parts(r, *cols):
    return N.group_parts(r.members(), r.accounts()).select("claim_id", "a", "b", *[F.round(c, 6).alias(c) for c in cols])


@run_query("n12_handle_similarity")
def _(r):
    return _parts(r, "handle")


@run_query("n13_creation_proximity")
def _(r):
    return _parts(r, "creation")


@run_query("n14_image_similarity")
def _(r):
    return _parts(r, "image")


@run_query("n15_bio_similarity")
def _(r):
    return _parts(r, "bio")


@run_query("n16_w_meta")
def _(r):
    return N.meta_score(N.group_parts(r.members(), r.accounts()))


@run_query("n17_w_struct")
def _(r):
    return N.w_struct(r.candidates(), r.m.followers)


@run_query("n18_pair_key")
def _(r):
    pairs = N.pair_key(r.m.followers.withColumn("other", F.concat(F.lit("u"), F.col("follows").cast("string"))), "account_id", "other")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _families(r):
    """Which families each claim has data for, and the base weights."""
    per = r.scope().groupBy("claim_id").agg(
        F.countDistinct("account_id").alias("accounts"), F.count(F.lit(1)).alias("posts"), F.count("outbound_url").alias("urls"))
    rule = {"w_time": F.col("accounts") >= 70, "w_text": F.col("posts") >= 100, "w_amp": F.col("urls") >= 25, "w_meta": F.lit(True), "w_struct": F.col("accounts") >= 75}
    rows = [F.struct(F.lit(f).alias("family"), F.lit(w).alias("base_weight"), rule[f].alias("available")) for f, w in FAMILY_WEIGHTS.items()]
    return per.select("claim_id", F.explode(F.array(*rows)).alias("f")).select("claim_id", "f.*")


@run_query("n19_effective_weights")
def _(r):
    return effective_weights_table(_families(r)).withColumn("weight", F.round("weight", 6))


@run_query("n20_fuse_edges")
def _(r):
    return r.edges()


# --- graph ----------------------------------------------------------------------------------------


@run_query("x01_k_core")
def _(r):
    return X.k_core(r.graph(), P.k_core).select(F.col("g").alias("claim_id"), "a", "b", "w")


@run_query("x02_connected_components")
def _(r):
    return X.connected_components(r.graph()).select(F.col("g").alias("claim_id"), "node", "component")


@run_query("x03_communities")
def _(r):
    core = X.k_core(r.graph(), P.k_core)
    return X.communities(core, P.resolution).select(F.col("g").alias("claim_id"), "node", "community")


@run_query("x04_retain")
def _(r):
    return X.retain(r.shape(), 4, 0.30).select(F.col("g").alias("claim_id"), "community", "members", "edges", "density")


@run_query("x05_conductance")
def _(r):
    return r.shape().select(F.col("g").alias("claim_id"), "community", "conductance")


@run_query("n21_relevance_gate")
def _(r):
    return r.gate()


@run_query("n22_offtopic_clusters")
def _(r):
    return offtopic_clusters(r.gate(), r.metrics())


# --- metrics --------------------------------------------------------------------------------------


@run_query("m01_synchrony")
def _(r):
    return M.synchrony(r.net_posts(), r.member_w_time(), 3600).withColumn("sy", F.round("sy", 4))


@run_query("m02_duplication")
def _(r):
    return M.duplication(r.net_posts(), r.net_eligible(), r.links()).withColumn("du", F.round("du", 4))


@run_query("m03_cohesion")
def _(r):
    return M.cohesion(r.network_shape()).select("network_id", F.round("co", 4).alias("co"))


@run_query("m04_tightest_window")
def _(r):
    return M.tightest_window(r.members(), r.accounts(), 24.0 * 20).withColumn("window_share", F.round("window_share", 6))


@run_query("m05_template_and_image_share")
def _(r):
    return M.template_and_image_share(r.members(), r.accounts()).select("network_id", F.round("template_share", 6).alias("template_share"), F.round("image_share", 6).alias("image_share"))


@run_query("m06_age_percentile_inverted")
def _(r):
    return M.age_percentile_inverted(r.members(), r.accounts(), r.baseline(), AS_OF).withColumn("age_inverted", F.round("age_inverted", 6))


@run_query("m07_provenance_anomaly")
def _(r):
    return M.provenance_anomaly(r.members(), r.accounts(), AS_OF, r.baseline()).withColumn("pr", F.round("pr", 4))


@run_query("m08_interpost_regularity")
def _(r):
    return M.interpost_regularity(r.net_posts()).withColumn("regularity", F.round("regularity", 6))


@run_query("m09_activity_parts")
def _(r):
    a = M.activity_parts(r.net_posts(), WINDOW_HOURS)
    return a.select("network_id", "account_id", *[F.round(c, 6).alias(c) for c in ("circadian", "rate", "reshare_ratio")])


@run_query("m10_automation")
def _(r):
    return M.automation(r.members(), r.net_posts(), WINDOW_HOURS).withColumn("au", F.round("au", 4))


@run_query("m11_coordination_score")
def _(r):
    return r.metrics()


@run_query("m12_signal_breadth")
def _(r):
    return M.signal_breadth(r.metrics()).select("network_id", "signal_breadth")


@run_query("m13_confidence_band")
def _(r):
    busy = F.col("total_posts") >= 12
    return M.confidence_band(M.signal_breadth(r.metrics()), busy, 0, 45.0, 2, 35.0, 1).select("network_id", "confidence_band")


@run_query("m14_allowlist_suppressed")
def _(r):
    allow = r.m.customer.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("account_id"))
    return M.allowlist_suppressed(r.members(), allow)


# --- evidence -------------------------------------------------------------------------------------


@run_query("v01_burst_timeline")
def _(r):
    return V.burst_timeline(r.net_posts(), 86400)


@run_query("v02_duplicate_groups")
def _(r):
    return r.evidence()


@run_query("v03_duplication_rate")
def _(r):
    return V.duplication_rate(r.net_posts(), r.net_eligible(), r.links())


@run_query("v04_account_annex")
def _(r):
    rates = V.duplication_rate(r.net_posts(), r.net_eligible(), r.links())
    return V.account_annex(r.members(), r.net_posts(), r.edges(), rates, r.accounts())


@run_query("v05_eigenvector_centrality")
def _(r):
    return V.network_centrality(r.edges(), r.members())


@run_query("v06_edge_snapshot")
def _(r):
    return V.edge_snapshot(r.edges(), r.members())


@run_query("v07_network_table")
def _(r):
    return V.network_table(r.members(), r.net_posts())


@run_query("v08_snapshot_digest")
def _(r):
    hashed = r.m.documents.select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return V.snapshot_digest(r.net_posts().join(hashed, "doc_id"), AS_OF)


@run_query("v09_top_terms")
def _(r):
    return V.top_terms(r.net_posts(), r.m.documents)


@run_query("v10_fingerprint")
def _(r):
    return V.fingerprint(r.members(), V.top_terms(r.net_posts(), r.m.documents))


@run_query("v11_recurrence_parent")
def _(r):
    order = r.members().select("network_id", (F.col("claim_id") * 100 + F.col("community_id")).alias("seq")).distinct()
    return V.recurrence_parent(r.members(), order, 0.50)


@run_query("v12_comparison_accounts")
def _(r):
    small = r.members().groupBy("network_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select("network_id")
    return V.comparison_accounts(r.candidates(), r.members().join(small, "network_id", "left_semi"), r.totals())


@run_query("v13_run_summary")
def _(r):
    run_claims = r.m.claims.select(F.col("topic_id").alias("run_id"), "claim_id").unionByName(
        r.m.claims.select(F.col("topic_id").alias("run_id"), (F.col("claim_id") + 1000000).alias("claim_id")))
    missing = _families(r).filter("NOT available").select("claim_id", "family")
    return V.run_summary(run_claims, r.m.claims, r.candidates(), missing)


@run_query("v14_purge_evidence")
def _(r):
    named = r.members().groupBy("network_id").agg(F.count(F.lit(1)).alias("n")).filter("n < 3").select("network_id")
    return V.purge_evidence(V.burst_timeline(r.net_posts(), 86400), named)


@run_query("v14_purge_counts")
def _(r):
    """Rows of the five evidence tables that a purge of the small networks takes and leaves."""
    named = r.members().groupBy("network_id").agg(F.count(F.lit(1)).alias("n")).filter("n < 3").select("network_id")
    tables = {"posts": r.net_posts(), "bursts": V.burst_timeline(r.net_posts(), 86400), "edges": V.edge_snapshot(r.edges(), r.members()), "accounts": r.members(), "terms": V.top_terms(r.net_posts(), r.m.documents)}
    return V.purge_all(tables, named)[1]


def _detection(r):
    """The whole run on the model, with the parameters of the checks above and gates that fit its few posts an account."""
    def make():
        m = r.m
        inputs = Inputs(m.posts, m.claims, m.documents, r.accounts(), r.vectors(), m.followers, exclusions=_listed(m, r.accounts()), phrases=r.phrases())
        return detect(inputs, START, AS_OF, AS_OF, replace(P, min_cluster_size=4, anchor_share=0.30, min_claim_posts=8))

    return r._once("detection", make)


@run_query("run_detection")
def _(r):
    """The communities a whole run found, with their scores and what the gate said of them."""
    out = _detection(r)
    scores = out["metrics"].select("network_id", "sy", "du", "co", "pr", "au", "coordination_score", "signal_breadth")
    return out["gate"].join(scores, "network_id")


@run_query("run_detection_claims")
def _(r):
    """What a whole run examined in each claim, up to the communities: accounts, edges, and the core."""
    out = _detection(r)
    core = out["core"]
    nodes = core.select("g", F.explode(F.array("a", "b")).alias("node")).distinct().groupBy(F.col("g").alias("claim_id")).agg(F.count(F.lit(1)).alias("core_accounts"))
    edges = out["edges"].groupBy("claim_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w_total"), 6).alias("weight"))
    accounts = out["candidates"].groupBy("claim_id").agg(F.count(F.lit(1)).alias("accounts"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return accounts.join(edges, "claim_id", "left").join(nodes, "claim_id", "left").select("claim_id", "accounts", zero("edges"), zero("core_accounts"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


# --- sinks and streams ----------------------------------------------------------------------------


@query("s14_write_and_delete")
def _(m):
    """Append snapshots by date, replace the dates that have alerts, then delete the watched claims' rows."""
    spark = m.spark
    path, out = new_path(spark, "snapshots"), new_path(spark, "kept")
    sinks.append_by_date(m.snapshots, path, "recorded_at")
    days = m.alerts.select(F.to_date("added_at").alias("day")).distinct()
    fresh = m.snapshots.withColumn("date", F.to_date("recorded_at")).join(days, F.col("date") == F.col("day"), "left_semi").withColumn("final_score", F.lit(0.0))
    sinks.replace_partitions(fresh, path, "date")
    sinks.delete_by_ids(spark, path, m.alerts, "claim_id", out)
    return spark.read.parquet(out).select("claim_id", "final_score", "recorded_at")


@query("s14_committed_table")
def _(m):
    """The same appends, replacement and deletion with commit records; a batch is written twice, and one is not committed."""
    spark = m.spark
    table = sinks.CommittedTable(spark, new_path(spark, "committed"), "claim_id bigint, final_score double, recorded_at timestamp, date date", "date")
    rows = m.snapshots.withColumn("date", F.to_date("recorded_at"))
    for batch in ("a", "a"):
        table.append(rows, batch)
    table.write_files(rows)
    days = m.alerts.select(F.to_date("added_at").alias("day")).distinct()
    table.replace(rows.join(days, F.col("date") == F.col("day"), "left_semi").withColumn("final_score", F.lit(0.0)), "b")
    return table.read().join(m.alerts.select("claim_id").distinct(), "claim_id", "left_anti").select("claim_id", "final_score", "recorded_at")


def _post_stream(m: Model) -> DataFrame:
    """The posts view over a stream of the events file."""
    events = ST.read_stream(m.spark, m.tables.folder, "events", glob="events.parquet")
    tokens = {"nd": m.documents.count(), "nv": m.embeddings.count(), "nb": m.benchmark.count()}
    return m.spark.sql(VIEW_SQL["posts"].format(g="", events="{events}", **tokens), events=events)


@query("t01_stream_ingest")
def _(m):
    claims = claims_v(m).filter("claim_type = 'existing'")
    return ST.run_ingest(_post_stream(m), m.embeddings, claims, SETTINGS["clustering.claim_attach_threshold"])


@query("t01_stream_scores")
def _(m):
    """Scores after a stream: its facts are all the rescore reads."""
    facts = Q.FactStore(m.spark, new_path(m.spark, "stream-facts"))
    claims = claims_v(m)
    ST.run_ingest(_post_stream(m), m.embeddings, claims.filter("claim_type = 'existing'"), SETTINGS["clustering.claim_attach_threshold"], facts=facts, texts=m.documents)
    return facts.rescore(claims, corpus_v(m), SETTINGS, AS_OF).select("claim_id", *Q.SCORE_COLUMNS)


@query("t02_stream_topic_volume")
def _(m):
    return ST.run_updates(ST.topic_volume(_post_stream(m), m.claims), ["topic_id", "bucket_start"], "volume")


@query("t03_stream_pushback")
def _(m):
    return ST.run_updates(ST.pushback(_post_stream(m)), ["claim_id", "window_end"], "pushback")


@query("t04_stream_bursts")
def _(m):
    return ST.burst_scores(ST.run_updates(ST.minute_bins(_post_stream(m)), ["claim_id", "bin_start"], "bins"))


@query("t03_stream_dormancy")
def _(m):
    """The last volumes of every claim; those whose window has run empty are dormant."""
    rows = ST.run_append(ST.pushback_now(_post_stream(m)), "dormancy", "update")
    return rows.groupBy("claim_id").agg(F.max_by(F.struct("supporting", "opposing", "is_dormant"), "at").alias("r")).select("claim_id", "r.*")


@query("t04_stream_burst_updates")
def _(m):
    return ST.run_append(ST.burst_updates(_post_stream(m)), "burst-updates")
