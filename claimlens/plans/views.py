"""The claim-monitoring model laid over the landed tables.

Each text is one SELECT that both Spark and the checking engine read; only the tokens in braces
differ: table names, the global-replace flag, and the row counts used to spread keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import Tables

AS_OF = "2024-01-31 00:00:00"

VIEW_SQL = {
    "posts": """
SELECT e.event_id AS post_id, e.event_id % {nd} AS doc_id, (e.event_id % {nd}) % {nv} AS vec_id,
 CASE e.event_type WHEN 'click' THEN 'social' WHEN 'view' THEN 'forum' WHEN 'signup' THEN 'radio' WHEN 'error' THEN 'rss' ELSE 'other' END AS source,
 CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE concat('u', cast(e.user_id AS varchar(20))) END AS author_id,
 CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE concat('ref:', cast(e.event_id - e.event_id % 2 AS varchar(20))) END AS external_ref,
 cast(floor(e.value * 10) AS bigint) AS impressions,
 cast(regexp_replace(e.props, '[^0-9]', ''{g}) AS int) AS negative_reactions,
 99 - cast(regexp_replace(e.props, '[^0-9]', ''{g}) AS int) AS positive_reactions,
 cast(e.event_id * 7919 % 101 AS double) / 100 AS outrage_score,
 CASE WHEN e.event_id % 13 = 0 THEN NULL WHEN e.event_id % 3 = 0 THEN 0 ELSE e.event_id % {nb} END AS claim_id,
 CASE WHEN e.event_id % 13 = 0 THEN NULL WHEN e.event_id % 7 < 4 THEN 'supporting' WHEN e.event_id % 7 < 6 THEN 'opposing' ELSE 'neutral' END AS stance,
 CASE WHEN e.event_id % 9 < 3 THEN 'negative' WHEN e.event_id % 9 < 5 THEN 'positive' WHEN e.event_id % 9 < 8 THEN 'neutral' ELSE NULL END AS sentiment,
 CASE WHEN e.event_id % 4 = 0 THEN concat('https://s', cast(e.event_id % 7 AS varchar(20)), '.example.org/', cast(e.event_id % 500 AS varchar(20))) ELSE NULL END AS outbound_url,
 CASE WHEN e.event_id % 4 = 0 THEN concat('s', cast(e.event_id % 7 AS varchar(20)), '.example.org') ELSE NULL END AS outbound_domain,
 CASE WHEN e.event_id % 11 = 0 THEN concat('p', cast(e.event_id % 400 AS varchar(20))) ELSE NULL END AS reshared_post_id,
 CASE WHEN e.event_id % 19 = 0 THEN concat('p', cast(e.event_id % 600 AS varchar(20))) ELSE NULL END AS quoted_post_id,
 CASE WHEN e.event_id % 23 = 0 THEN concat('p', cast(e.event_id % 700 AS varchar(20))) ELSE NULL END AS replied_to_post_id,
 e.event_id % 22 = 0 AS is_native_reshare,
 cast(e.ts AS timestamp) AS created_at
FROM {events} e""",
    "claims": """
SELECT b.item_id AS claim_id, CASE WHEN b.item_id % 3 = 2 THEN 'non_existing' ELSE 'existing' END AS claim_type,
 b.text AS claim_statement, b.item_id % 5 AS topic_id,
 CASE b.item_id % 4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'active' WHEN 2 THEN 'inactive' ELSE 'action_taken' END AS status,
 CASE WHEN b.item_id % 3 = 2 THEN (b.item_id * 7) % {np} ELSE NULL END AS policy_id,
 (b.item_id * 11) % {nv} AS vec_id,
 cast(b.item_id * 37 % 101 AS double) AS harm_public_safety, cast(b.item_id * 53 % 101 AS double) AS harm_institutional_trust,
 cast(b.item_id * 71 % 101 AS double) AS harm_economic, cast(b.item_id * 89 % 101 AS double) AS harm_policy_disruption,
 cast(e.ts AS timestamp) AS created_at
FROM {benchmark} b JOIN {events} e ON e.event_id = b.item_id""",
    "accounts": """
SELECT concat('u', cast(c.c_custkey AS varchar(20))) AS account_id,
 concat(lower(c.c_mktsegment), '_', CASE WHEN c.c_custkey % 6 = 5 THEN 'x' ELSE concat('w', CASE WHEN c.c_custkey % 2 = 0 THEN lpad(cast(c.c_custkey % 100 AS varchar(20)), 2, '0') ELSE lpad(cast(c.c_custkey % 1000 AS varchar(20)), 3, '0') END) END) AS handle,
 o.first_order AS created_at_platform,
 CASE WHEN c.c_custkey % 3 = 0 THEN NULL WHEN c.c_custkey % 50 = 1 THEN 'not-hex' ELSE substr(md5(cast(c.c_nationkey AS varchar(20))),1,16) END AS profile_hash,
 CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE concat(lower(c.c_mktsegment), ' watcher from ', n.n_name) END AS bio,
 n.n_name AS declared_location, CASE c.c_custkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'app' ELSE NULL END AS client_app
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT o_custkey, cast(min(o_orderdate) AS timestamp) AS first_order FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "snapshots": """
SELECT event_id % {nb} AS claim_id, value / 5 AS final_score, cast(ts AS timestamp) AS recorded_at FROM {events}""",
    "policies": """
SELECT p.p_partkey AS policy_id, p.p_name AS title, CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE concat(p.p_brand, ' ', p.p_type) END AS description,
 d.text AS document_text, cast(o.o_orderdate AS date) AS rolled_out_date,
 CASE WHEN p.p_partkey % 9 = 4 THEN NULL ELSE (p.p_partkey * 3 + 7) % {nv} END AS vec_id,
 CASE WHEN p.p_partkey % 7 = 2 THEN 'fetch failed' ELSE NULL END AS last_error, cast(e.ts AS timestamp) AS created_at
FROM {part} p JOIN {orders} o ON o.o_orderkey = p.p_partkey JOIN {events} e ON e.event_id = p.p_partkey
LEFT JOIN {documents} d ON d.doc_id = p.p_partkey""",
    "topics": """
SELECT n_nationkey AS topic_id, n_name AS name, cast(n_nationkey AS bigint) * 13 % {nv} AS vec_id FROM {nation}""",
    "corpus": """
SELECT vec_id AS source_id, vec_id FROM {embeddings} WHERE label >= 5""",
    "fault_lines": """
SELECT vec_id AS fault_line_id, concat('community ', cast(vec_id % 7 AS varchar(5))) AS community_name,
 concat('theme ', cast(vec_id % 5 AS varchar(5))) AS grievance_theme,
 CASE WHEN vec_id % 3 = 0 THEN NULL ELSE concat('note ', cast(vec_id AS varchar(20))) END AS description, vec_id
FROM {embeddings} WHERE label IN (3, 4)""",
    "alerts": """
SELECT l.doc_id % {nb} AS claim_id, cast(min(e.ts) AS timestamp) AS added_at
FROM {labels} l JOIN {events} e ON e.event_id = l.doc_id WHERE l.toxic = 1 GROUP BY l.doc_id % {nb}""",
    "policy_links": """
SELECT DISTINCT l.l_orderkey % {nb} AS claim_id, l.l_partkey AS policy_id FROM {lineitem} l""",
    "followers": """
SELECT DISTINCT concat('u', cast(o.o_custkey AS varchar(20))) AS account_id, l.l_suppkey AS follows
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""",
    "groups": """
SELECT concat('u', cast(c_custkey AS varchar(20))) AS account_id, cast(c_nationkey AS bigint) AS community_id FROM {customer}""",
}

_COUNTS = {"nd": "documents", "nv": "embeddings", "nb": "benchmark", "np": "part"}
_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duckdb_view(name: str) -> str:
    tokens = {t: t for t in _TABLES}
    tokens.update({k: f"(SELECT count(*) FROM {t})" for k, t in _COUNTS.items()})
    return VIEW_SQL[name].format(g=", 'g'", **tokens).strip()


def spark_view(t: Tables, name: str) -> DataFrame:
    """Run a view text on Spark. The counts come from parquet footers, not from a data pass."""
    text = VIEW_SQL[name]
    tokens = {k: str(getattr(t, table).count()) for k, table in _COUNTS.items() if "{%s}" % k in text}
    used = {x: getattr(t, x) for x in _TABLES if "{%s}" % x in text}
    keep = {x: "{%s}" % x for x in used}
    return t.spark.sql(text.format(g="", **tokens, **keep), **used)


class Model:
    """Lazy access to the model views and the landed tables of one folder."""

    def __init__(self, spark, folder: str):
        self.tables = Tables(spark, folder)
        self.spark = spark
        self._cache = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            if name not in self._cache:
                self._cache[name] = spark_view(self.tables, name)
            return self._cache[name]
        return getattr(self.tables, name)
