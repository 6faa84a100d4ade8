"""Explicit schemas (DDL text) of the landed tables and of the claim-monitoring model; nothing is inferred."""


LANDED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

MODEL = {
    "posts": "post_id bigint, doc_id bigint, vec_id bigint, source string, author_id string, external_ref string, "
    "impressions bigint, negative_reactions int, positive_reactions int, outrage_score double, claim_id bigint, "
    "stance string, sentiment string, outbound_url string, outbound_domain string, reshared_post_id string, "
    "quoted_post_id string, replied_to_post_id string, is_native_reshare boolean, created_at timestamp",
    "claims": "claim_id bigint, claim_type string, claim_statement string, topic_id bigint, status string, "
    "policy_id bigint, vec_id bigint, harm_public_safety double, harm_institutional_trust double, "
    "harm_economic double, harm_policy_disruption double, created_at timestamp",
    "score_snapshots": "claim_id bigint, final_score double, recorded_at timestamp",
    "topic_volume": "topic_id bigint, bucket_start timestamp, supporting_volume bigint",
    "settings": "key string, value string",
    "candidates": "text string, source string, author_id string, location string, external_ref string, "
    "created_at timestamp, popularity_score double",
    "edges": "claim_id bigint, account_a string, account_b string, w_total double, w_time double, w_text double, "
    "w_amp double, w_meta double, w_struct double, signal_count int",
}
