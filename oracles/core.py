"""Twins: sources and ingest, labels, claim formation, scoring, boards, policies, pair check."""

import math

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
NB = "(SELECT count(*) FROM benchmark)"


def has(col, words):
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(col):
    return f"trim(regexp_replace(regexp_replace({col}, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g'))"


def decoded(col):
    x = f"regexp_replace({col}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"'), ("&#039;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


STANCE = (
    "CASE WHEN {c} IS NULL THEN NULL WHEN " + has("{c}", ("not true", "debunk", "false", "incorrect", "myth"))
    + " THEN 'opposing' WHEN contains(lower({c}), 'unrelated') THEN 'neutral' ELSE 'supporting' END"
)
SENTIMENT = (
    "CASE WHEN {c} IS NULL THEN NULL WHEN " + has("{c}", ("hidden tax", "secretly", "scam", "corrupt", "toxic"))
    + " THEN 'negative' WHEN " + has("{c}", ("great", "thank", "approve", "improve", "happy")) + " THEN 'positive' ELSE 'neutral' END"
)
TOPIC = (
    "CASE WHEN " + has("{c}", ("erp", "congestion", "toll")) + " THEN 'Road Pricing & Transit' WHEN " + has("{c}", ("tree", "mrt", "monas"))
    + " THEN 'Transit Construction' WHEN " + has("{c}", ("flood", "banjir", "ciliwung")) + " THEN 'Flooding & Waterways' WHEN "
    + has("{c}", ("waste", "sunter", "smoke")) + " THEN 'Waste & Pollution' ELSE 'General' END"
)
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
PLACES = (
    "jakarta", "dki", "sudirman", "thamrin", "kampung pulo", "penjaringan", "muara angke", "muara baru", "sunter", "cakung", "kota tua",
    "monas", "blok m", "kampung melayu", "ciliwung", "hathe", "lesion", "enthe",
)
DOT = "round(list_dot_product({a}.v, {b}.v), 9)"


def best(left, lid, right, rid, where="1=1", k=1):
    """Top-k rows of right for every row of left; both have a double list v."""
    return (
        f"SELECT {lid}, {rid}, sim, rn FROM (SELECT l.{lid}, r.{rid}, {DOT.format(a='l', b='r')} AS sim, "
        f"row_number() OVER (PARTITION BY l.{lid} ORDER BY {DOT.format(a='l', b='r')} DESC, r.{rid}) AS rn "
        f"FROM {left} l JOIN {right} r ON l.v IS NOT NULL AND r.v IS NOT NULL) x WHERE rn <= {k} AND {where}"
    )


def clamp(x, lo=0, hi=100):
    return f"least(greatest({x}, {lo}), {hi})"


CTES = {
    "emb": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "claims_v": "SELECT c.*, e.v FROM v_claims c LEFT JOIN emb e USING (vec_id)",
    "existing_v": "SELECT * FROM claims_v WHERE claim_type = 'existing'",
    "policies_v": "SELECT p.*, e.v FROM v_policies p LEFT JOIN emb e USING (vec_id)",
    "corpus_v": "SELECT c.source_id, e.v FROM v_corpus c JOIN emb e USING (vec_id)",
    "faults_v": "SELECT f.*, e.v FROM v_fault_lines f JOIN emb e USING (vec_id)",
    "topics_v": "SELECT t.*, e.v FROM v_topics t LEFT JOIN emb e USING (vec_id)",
    "open_posts": "SELECT * FROM v_posts WHERE claim_id IS NULL",
    "open_vecs": "SELECT DISTINCT p.vec_id, e.v FROM open_posts p JOIN emb e USING (vec_id)",
    "open_best": best("open_vecs", "vec_id", "existing_v", "claim_id", "sim >= 0.25"),
    "attached": "SELECT p.post_id, b.claim_id, b.sim, p.doc_id FROM open_posts p JOIN open_best b USING (vec_id)",
    "reach_in": f"""SELECT c.claim_id, c.topic_id, c.claim_type, coalesce(CAST(sum(p.impressions) AS BIGINT), 0) AS impressions, count(DISTINCT p.author_id) AS unique_authors,
 count(p.post_id) AS post_count, count(DISTINCT p.source) AS platforms
FROM v_claims c LEFT JOIN v_posts p ON p.claim_id = c.claim_id AND p.stance = 'supporting' AND p.created_at >= {AS_OF} - INTERVAL 90 DAY GROUP BY ALL""",
    "reach_raw": """SELECT claim_id, topic_id, 0.25 * ln(1 + impressions) + 0.25 * ln(1 + unique_authors) + 0.25 * ln(1 + post_count) + 0.25 * platforms / 5 AS raw_reach
FROM reach_in WHERE claim_type = 'existing'""",
    "reach": """SELECT claim_id, topic_id, CASE WHEN hi - lo < 1e-9 THEN 50.0 ELSE round((raw_reach - lo) / (hi - lo) * 100, 4) END AS reach_score
FROM (SELECT *, min(raw_reach) OVER (PARTITION BY topic_id) AS lo, max(raw_reach) OVER (PARTITION BY topic_id) AS hi FROM reach_raw) x""",
    "pagg": f"""SELECT claim_id,
 count(*) FILTER (stance = 'supporting' AND created_at >= {AS_OF} - INTERVAL 72 HOUR) AS volume_now,
 count(*) FILTER (stance = 'supporting' AND created_at >= {AS_OF} - INTERVAL 144 HOUR AND created_at < {AS_OF} - INTERVAL 72 HOUR) AS volume_before,
 count(*) FILTER (stance = 'supporting' AND created_at >= {AS_OF} - INTERVAL 72 HOUR) AS sup72,
 count(*) FILTER (stance = 'opposing' AND created_at >= {AS_OF} - INTERVAL 72 HOUR) AS opp72,
 avg(outrage_score) FILTER (stance = 'supporting') AS o_sup, sum(negative_reactions) FILTER (stance = 'supporting') AS n_sup,
 sum(positive_reactions) FILTER (stance = 'supporting') AS p_sup, count(*) FILTER (stance = 'supporting') AS c_sup,
 avg(outrage_score) FILTER (stance = 'opposing') AS o_opp, sum(negative_reactions) FILTER (stance = 'opposing') AS n_opp,
 sum(positive_reactions) FILTER (stance = 'opposing') AS p_opp, count(*) FILTER (stance = 'opposing') AS c_opp
FROM v_posts WHERE claim_id IS NOT NULL GROUP BY claim_id""",
    "ei": """SELECT claim_id,
 CASE WHEN c_sup > 0 THEN round(least(greatest(50 * coalesce(o_sup, 0) + 50 * CASE WHEN n_sup + p_sup > 0 THEN n_sup / (n_sup + p_sup) ELSE 0 END, 0), 100), 4) END AS ei_supporting,
 CASE WHEN c_opp > 0 THEN round(least(greatest(50 * coalesce(o_opp, 0) + 50 * CASE WHEN n_opp + p_opp > 0 THEN n_opp / (n_opp + p_opp) ELSE 0 END, 0), 100), 4) END AS ei_opposing
FROM pagg""",
    "tvol": """SELECT c.topic_id, date_trunc('hour', p.created_at) AS bucket_start, count(*) AS supporting_volume
FROM v_posts p JOIN v_claims c USING (claim_id) WHERE p.stance = 'supporting' GROUP BY 1, 2""",
    "vbase": """SELECT topic_id, CASE WHEN count(*) >= 3 THEN avg(g) ELSE 0 END AS m, CASE WHEN count(*) >= 3 THEN stddev_pop(g) ELSE 0 END AS sd
FROM (SELECT topic_id, (supporting_volume - lag(supporting_volume) OVER w) / (lag(supporting_volume) OVER w + 1.0) AS g FROM tvol
 WINDOW w AS (PARTITION BY topic_id ORDER BY bucket_start)) x GROUP BY topic_id""",
    "vel": """SELECT claim_id, raw_velocity, round((least(greatest(CASE WHEN sd < 1e-9 THEN 0 ELSE (raw_velocity - m) / sd END, -3.0), 3.0) + 3.0) / 6.0 * 100, 4) AS velocity_score
FROM (SELECT c.claim_id, (coalesce(volume_now, 0) - coalesce(volume_before, 0)) / (coalesce(volume_before, 0) + 1.0) AS raw_velocity, coalesce(m, 0.0) AS m, coalesce(sd, 0.0) AS sd
 FROM v_claims c LEFT JOIN pagg USING (claim_id) LEFT JOIN vbase USING (topic_id) WHERE claim_type = 'existing') x""",
    "corpus_best": best("existing_v", "claim_id", "corpus_v", "source_id"),
    "false8": """SELECT c.claim_id, b.sim, CASE WHEN b.sim >= 0.28 THEN round(least(greatest(b.sim, 0), 1) * 100, 4) END AS score
FROM v_claims c LEFT JOIN corpus_best b USING (claim_id) WHERE claim_type = 'existing'""",
    "verdict": f"""SELECT doc_id % {NB} AS claim_id, count(*) FILTER (toxic = 1 OR quality = 0) * 3 > count(*) AS v FROM labels GROUP BY 1""",
    "false9": """SELECT claim_id, coalesce(score, CASE WHEN v THEN 75.0 END) AS falseness_score FROM false8 LEFT JOIN verdict USING (claim_id)""",
    "harm": """SELECT claim_id, round(least(greatest(0.35 * harm_public_safety + 0.3 * harm_institutional_trust + 0.2 * harm_economic + 0.15 * harm_policy_disruption, 0), 100), 4) AS harm_score FROM v_claims""",
    "npr": """SELECT c.claim_id, c.claim_type, coalesce(sup72, 0) AS supporting, coalesce(opp72, 0) AS opposing,
 CASE WHEN coalesce(sup72, 0) + coalesce(opp72, 0) > 0 THEN round(opp72 / (sup72 + opp72), 4) END AS npr FROM v_claims c LEFT JOIN pagg USING (claim_id)""",
    "disc": """SELECT *, CASE WHEN npr IS NULL OR supporting + opposing < 10 THEN 1.0 ELSE round(1 - 0.5 * npr, 4) END AS discount_factor FROM npr""",
    "score_parts": """SELECT c.claim_id, reach_score, velocity_score, falseness_score, harm_score, coalesce(ei_supporting, 0.0) AS emotional_intensity_score, ei_opposing,
 npr, npr IS NULL AS is_dormant, discount_factor
FROM v_claims c LEFT JOIN reach USING (claim_id) LEFT JOIN vel USING (claim_id) LEFT JOIN false9 USING (claim_id) LEFT JOIN harm USING (claim_id)
 LEFT JOIN ei USING (claim_id) LEFT JOIN disc d USING (claim_id) WHERE c.claim_type = 'existing'""",
    "score_one": """SELECT *, round(least(greatest(CASE WHEN falseness_score IS NULL
 THEN (0.15 * coalesce(reach_score, 0) + 0.15 * velocity_score + 0.3 * harm_score + 0.1 * emotional_intensity_score) / 0.7
 ELSE 0.15 * coalesce(reach_score, 0) + 0.15 * velocity_score + 0.3 * harm_score + 0.1 * emotional_intensity_score + 0.3 * falseness_score END, 0), 100), 4) AS claim_score FROM score_parts""",
    "scored": """SELECT c.*, reach_score, velocity_score, falseness_score, harm_score, emotional_intensity_score, ei_opposing, npr, is_dormant, discount_factor, claim_score,
 round(claim_score * discount_factor, 4) AS final_score FROM v_claims c LEFT JOIN score_one USING (claim_id)""",
    "counts": """SELECT claim_id, count(*) FILTER (stance = 'supporting') AS supporting_count, count(*) FILTER (stance = 'opposing') AS opposing_count
FROM v_posts WHERE claim_id IS NOT NULL GROUP BY claim_id""",
    "flags": "SELECT claim_id, claim_id IN (SELECT claim_id FROM v_alerts) AS alert_on FROM v_claims",
    "tops": """SELECT claim_id, author_id, post_count, rank FROM (SELECT claim_id, author_id, count(*) AS post_count,
 CAST(row_number() OVER (PARTITION BY claim_id ORDER BY count(*) DESC, author_id) AS INT) AS rank
 FROM v_posts WHERE stance = 'supporting' AND author_id IS NOT NULL AND claim_id IS NOT NULL GROUP BY 1, 2) x WHERE rank <= 5""",
    "pol_best": best("policies_v", "policy_id", "existing_v", "claim_id", "sim >= 0.10", "1000000000"),
    "confirmed": """SELECT b.policy_id, b.claim_id, c.claim_statement FROM pol_best b JOIN v_policies p USING (policy_id) JOIN v_claims c USING (claim_id)
WHERE len(list_filter(string_split(lower(p.title), ' '), lambda w: length(w) > 3 AND contains(lower(c.claim_statement), w))) > 0""",
    "rerun": """SELECT policy_id FROM v_policies WHERE policy_id NOT IN (SELECT policy_id FROM v_policy_links) OR last_error IS NOT NULL OR title LIKE 'red%'""",
    "retrieved": best("policies_v", "policy_id", "faults_v", "fault_line_id", k=3),
    "blocks": """SELECT policy_id, string_agg('- [' || community_name || '] ' || grievance_theme || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY rn)
 || chr(10) || '- [Additional context] rolled out nationally' AS block FROM retrieved JOIN v_fault_lines USING (fault_line_id) GROUP BY policy_id""",
    "chk": """SELECT p.post_id, p.vec_id, p.author_id, epoch_us(p.created_at) AS t, epoch_us(a.created_at_platform) AS c FROM v_posts p LEFT JOIN v_accounts a ON a.account_id = p.author_id""",
    "simv": f"""SELECT a.vec_id AS va, b.vec_id AS vb FROM emb a JOIN emb b ON {DOT.format(a='a', b='b')} >= 0.42""",
    "pairs2": """SELECT a.post_id AS pa, b.post_id AS pb FROM chk a JOIN chk b ON a.post_id < b.post_id AND abs(a.t - b.t) <= 600000000
UNION SELECT a.post_id, b.post_id FROM chk a JOIN simv s ON s.va = a.vec_id JOIN chk b ON b.vec_id = s.vb AND a.post_id < b.post_id""",
    "flagged": """SELECT * FROM (SELECT pa AS post_a, pb AS post_b,
 round(CASE WHEN is_t THEN 0.35 ELSE 0 END + CASE WHEN is_x THEN 0.40 ELSE 0 END + CASE WHEN is_c THEN 0.25 ELSE 0 END, 4)::DOUBLE AS score,
 concat_ws(',', CASE WHEN is_t THEN 'burst_timing' END, CASE WHEN is_x THEN 'text_similarity' END, CASE WHEN is_c THEN 'account_creation_clustering' END) AS reasons
FROM (SELECT pa, pb, abs(a.t - b.t) <= 600000000 AS is_t, s.va IS NOT NULL AS is_x, coalesce(abs(a.c - b.c) <= 86400000000, false) AS is_c
 FROM pairs2 JOIN chk a ON a.post_id = pa JOIN chk b ON b.post_id = pb LEFT JOIN simv s ON s.va = a.vec_id AND s.vb = b.vec_id) x) y WHERE score >= 0.6""",
    "fl_sym": "SELECT post_a AS u, post_b AS v FROM flagged UNION ALL SELECT post_b, post_a FROM flagged",
    "fl_comp": """SELECT u, min(w) AS cluster FROM fl_walk GROUP BY u""",
    "fl_walk": "SELECT u, u AS w FROM fl_sym UNION SELECT s.u, x.w FROM fl_walk x JOIN fl_sym s ON s.v = x.u WHERE x.w < s.u",
    "pclusters": """SELECT cluster, count(*) AS posts, count(DISTINCT author_id) AS authors FROM fl_comp JOIN v_posts ON post_id = u GROUP BY cluster""",
    "pc": """SELECT p.cluster, posts, authors, coordination_score, reasons FROM pclusters p JOIN (
 SELECT cluster, round(avg(score), 4) AS coordination_score,
  concat_ws(',', CASE WHEN bool_or(contains(reasons, 'account_creation_clustering')) THEN 'account_creation_clustering' END, CASE WHEN bool_or(contains(reasons, 'burst_timing')) THEN 'burst_timing' END,
   CASE WHEN bool_or(contains(reasons, 'text_similarity')) THEN 'text_similarity' END) AS reasons
 FROM flagged JOIN fl_comp ON u = post_a GROUP BY cluster) e USING (cluster)""",
    "rest_posts": "SELECT post_id, vec_id FROM open_posts WHERE post_id NOT IN (SELECT post_id FROM attached)",
    "rest_vecs": "SELECT DISTINCT vec_id, v FROM rest_posts JOIN emb USING (vec_id)",
    "r_sym": f"SELECT a.vec_id AS u, b.vec_id AS v FROM rest_vecs a JOIN rest_vecs b ON a.vec_id <> b.vec_id WHERE {DOT.format(a='a', b='b')} >= 0.40",
    "r_walk": "SELECT vec_id AS u, vec_id AS w FROM rest_vecs UNION SELECT s.u, x.w FROM r_walk x JOIN r_sym s ON s.v = x.u WHERE x.w < s.u",
    "clusters": """SELECT post_id, cluster FROM (SELECT post_id, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM rest_posts JOIN (SELECT u AS vec_id, min(w) AS cluster FROM r_walk GROUP BY 1) c USING (vec_id)) x WHERE n >= 2""",
    "rss_items": f"""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS feed, CASE WHEN page_id % 4 = 0 THEN CAST(page_id AS VARCHAR) END AS id, CASE WHEN page_id % 4 = 1 THEN '' ELSE url END AS link,
 {strip(TITLE)} AS title, {strip('html')} AS summary, CASE WHEN page_id % 5 <> 0 THEN {AS_OF} - to_days(CAST(page_id % 100 AS INT)) END AS published FROM pages""",
    "batch_all": f"""SELECT post_id, created_at, CASE WHEN external_ref IS NOT NULL THEN 'doc:' || CAST(post_id % (SELECT count(*) FROM documents) - post_id % 2 AS VARCHAR) END AS external_ref FROM v_posts""",
    "lbl": f"""SELECT CAST(claim_id AS BIGINT) AS claim_id, CASE WHEN claim_id % 4 = 0 THEN ' nation_' || CAST(claim_id % 30 AS VARCHAR) || ' ' ELSE 'Topic ' || CAST(claim_id % 3 AS VARCHAR) END AS topic_label, v FROM claims_v""",
    "t_named": "SELECT l.claim_id, t.topic_id, t.name FROM lbl l JOIN v_topics t ON lower(trim(t.name)) = lower(trim(l.topic_label))",
    "t_rest": "SELECT * FROM lbl WHERE claim_id NOT IN (SELECT claim_id FROM t_named)",
    "t_best": best("t_rest", "claim_id", "topics_v", "topic_id", "sim >= 0.20"),
}


def density_parts(epsilon=0.40, least=2, levels=8):
    """Nested components of the left-over posts at each similarity, and the most stable cut, level by level."""
    grid = [round(epsilon + (1 - epsilon) * i / levels, 9) for i in range(levels)]
    dense = [1 / math.sqrt(2 - 2 * t) for t in grid]
    gain = [0.0] + [b - a for a, b in zip(dense, dense[1:])]
    out = {
        "d_rep": "SELECT vec_id, v, min(vec_id) OVER (PARTITION BY v) AS rep FROM rest_vecs",
        "d_node": "SELECT rep, count(*) AS weight FROM rest_posts JOIN d_rep USING (vec_id) GROUP BY 1",
        "d_sim": f"SELECT a.rep AS u, b.rep AS v, round({DOT.format(a='a', b='b')}, 9) AS s FROM d_rep a JOIN d_rep b ON a.vec_id = a.rep AND b.vec_id = b.rep AND a.rep <> b.rep WHERE {DOT.format(a='a', b='b')} >= {epsilon - 1e-6}",
        "d_grid": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(grid)) + ") x(l, t)",
        "d_walk": "SELECT l, rep AS u, rep AS w FROM d_node, d_grid UNION SELECT x.l, s.u, x.w FROM d_walk x JOIN d_grid g ON g.l = x.l JOIN d_sim s ON s.v = x.u AND s.s >= g.t WHERE x.w < s.u",
        "d_comp": "SELECT l, u, min(w) AS comp FROM d_walk GROUP BY l, u",
        "d_tree": f"""SELECT c.l, c.comp, sum(weight) AS size, any_value(p.comp) AS parent FROM d_comp c JOIN d_node ON rep = c.u LEFT JOIN d_comp p ON p.l = c.l - 1 AND p.u = c.comp
 GROUP BY c.l, c.comp HAVING sum(weight) >= {least}""",
        f"d_up_{levels - 1}": f"SELECT comp, parent, round(size * {gain[-1]!r}, 9)::DOUBLE AS own, 0.0::DOUBLE AS split, false AS splits FROM d_tree WHERE l = {levels - 1}",
        "d_cut_0": "SELECT *, true AS top FROM d_up_0",
    }
    for i in range(levels - 2, -1, -1):
        out[f"d_up_{i}"] = f"""SELECT t.comp, t.parent, round(size * {gain[i]!r} + CASE WHEN n = 1 THEN o ELSE 0 END, 9)::DOUBLE AS own, round(CASE WHEN n = 1 THEN s WHEN n > 1 THEN b ELSE 0 END, 9)::DOUBLE AS split,
 coalesce(n > 1, false) AS splits FROM d_tree t LEFT JOIN (SELECT parent AS comp, count(*) AS n, sum(own) AS o, sum(split) AS s, sum(greatest(own, split)) AS b FROM d_up_{i + 1} GROUP BY 1) k USING (comp) WHERE t.l = {i}"""
        j = levels - 1 - i
        out[f"d_cut_{j}"] = f"SELECT h.*, p.splits AS top FROM d_up_{j} h JOIN d_cut_{j - 1} p ON h.parent = p.comp WHERE NOT (p.top AND p.own >= p.split)"
    out["d_chosen"] = " UNION ALL ".join(f"SELECT {i} AS l, comp FROM d_cut_{i} WHERE top AND own >= split" for i in range(levels))
    return out


CTES.update(density_parts())
CTES.update({
    "f_clusters": "SELECT post_id, c.comp AS cluster FROM rest_posts JOIN d_rep USING (vec_id) JOIN d_comp c ON c.u = rep JOIN d_chosen x ON x.l = c.l AND x.comp = c.comp",
    "f_built": f"""SELECT cluster, CAST('0x' || substr(md5('claim:' || cluster), 1, 15) AS BIGINT) AS claim_id, text, {TOPIC.format(c='text')} AS topic_label, n AS post_count, v FROM (
 SELECT f.cluster, p.*, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY created_at, p.post_id) AS r FROM f_clusters f JOIN v_posts p USING (post_id)) x JOIN documents USING (doc_id) JOIN emb USING (vec_id) WHERE r = 1""",
    "f_mean": "SELECT topic_id, pos, avg(x[pos]) AS m FROM (SELECT topic_id, v AS x, unnest(range(1, len(v) + 1)) AS pos FROM v_claims JOIN emb USING (vec_id)) y GROUP BY 1, 2",
    "f_state": "SELECT topic_id, pos - 1 AS pos, m / sqrt(sum(m * m) OVER (PARTITION BY topic_id)) AS x FROM f_mean",
    "f_cents": "SELECT topic_id, list(x ORDER BY pos) AS v FROM f_state GROUP BY 1",
    "f_named": "SELECT b.claim_id, t.topic_id, t.name FROM f_built b JOIN v_topics t ON lower(trim(t.name)) = lower(trim(b.topic_label))",
    "f_rest": "SELECT * FROM f_built WHERE claim_id NOT IN (SELECT claim_id FROM f_named)",
    "f_best": best("f_rest", "claim_id", "f_cents", "topic_id", "sim >= 0.20"),
    "f_topics": """SELECT claim_id, topic_id, name AS topic_name, 'name' AS how FROM f_named UNION ALL SELECT claim_id, b.topic_id, t.name, 'centroid' FROM f_best b JOIN v_topics t USING (topic_id)
 UNION ALL SELECT claim_id, CAST('0x' || substr(md5(lower(trim(topic_label))), 1, 15) AS BIGINT), min(trim(topic_label)) OVER (PARTITION BY lower(trim(topic_label))), 'new' FROM f_rest WHERE claim_id NOT IN (SELECT claim_id FROM f_best)""",
    "f_said": "SELECT claim_id FROM attached UNION SELECT claim_id FROM f_built",
    "f_touched": "SELECT DISTINCT topic_id FROM (SELECT topic_id FROM v_claims WHERE claim_id IN (SELECT claim_id FROM attached) UNION ALL SELECT topic_id FROM f_topics) x",
})

SQL = {
    "s01_read_tables": """SELECT 'events' AS name, count(*) AS n, round(sum(value), 2) AS total FROM events
UNION ALL SELECT 'orders', count(*), round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'documents', count(*), CAST(sum(length(text)) AS DOUBLE) FROM documents
UNION ALL SELECT 'embeddings', count(*), CAST(sum(len(embedding)) AS DOUBLE) FROM embeddings
UNION ALL SELECT 'pages', count(*), CAST(sum(length(html)) AS DOUBLE) FROM pages
UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS DOUBLE) FROM conversations""",
    "s02_rss_candidates": f"""SELECT md5(t) AS text_md5, CAST(length(t) AS INT) AS length, external_ref, created_at, popularity_score FROM (
 SELECT trim(title || '. ' || summary) AS t, 'rss:' || feed || ':' || coalesce(nullif(id, ''), nullif(link, ''), title) AS external_ref, coalesce(published, {AS_OF}) AS created_at,
 round(count(*) OVER (PARTITION BY lower(trim(title))) * 10 - greatest(epoch({AS_OF} - coalesce(published, {AS_OF})) / 3600, 0), 4) AS popularity_score FROM rss_items) x""",
    "s03_comment_candidates": f"""SELECT md5(trim(text, ' ')) AS text_md5, CASE WHEN turn % 2 = 0 THEN 'ch' || CAST(conv_id AS VARCHAR) ELSE role END AS author_id,
 'youtube:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS external_ref, {AS_OF} AS created_at, CAST(length(text) AS DOUBLE) AS popularity_score
FROM conversations WHERE trim(text, ' ') <> ''""",
    "s04_message_candidates": f"""SELECT text, channel AS author_id, 'telegram:' || channel || ':' || CAST(event_id AS VARCHAR) AS external_ref, ts AS created_at,
 CAST(floor(value) + coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, 0) * 5 AS DOUBLE) AS popularity_score
FROM (SELECT *, event_type AS channel, CASE WHEN contains(props, '5') THEN '' ELSE props END AS text, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) x
WHERE ts >= {AS_OF} - INTERVAL 120 HOUR AND text <> ''""",
    "s05_debunk_corpus": f"""SELECT claim AS title, url AS source_url, md5(coalesce(nullif(d, ''), claim)) AS content_md5, CAST(length(coalesce(nullif(d, ''), claim)) AS INT) AS length FROM (
 SELECT trim({TITLE}) AS claim, trim(url) AS url, {decoded("CASE WHEN page_id % 8 <> 4 THEN html ELSE '' END")} AS d FROM pages WHERE page_id % 4 IN (0, 1)) x
WHERE url NOT IN (SELECT url FROM pages WHERE contains(url, '/fr/'))""",
    "s06_strip_html": f"""SELECT page_id, md5({strip('html')}) AS plain_md5, CAST(length({strip('html')}) AS INT) AS plain_length, md5({decoded('html')}) AS decoded_md5, CAST(length({decoded('html')}) AS INT) AS decoded_length FROM pages""",
    "s07_hazard_lines": """SELECT user_id, '- [BMKG] ' || CASE WHEN user_id % 4 <> 0 THEN 'k' || CAST(user_id AS VARCHAR) ELSE '?' END || ', Kota: ' ||
 coalesce(string_agg(d, ', ' ORDER BY f) || ' forecast in the next ~24h.', 'no significant weather hazard forecast in the next ~24h.') AS line
FROM (SELECT user_id, d, min(r) AS f FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'Hujan Petir' WHEN 'view' THEN 'Hujan Ringan' WHEN 'purchase' THEN 'Angin Kencang' END AS d,
 row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS r FROM events) x GROUP BY 1, 2) y
WHERE user_id % 10 <> 7 GROUP BY user_id""",
    "s08_false_verdict": "SELECT doc_id, toxic = 1 OR quality = 0 AS false_verdict FROM labels",
    "s09_location_filter": f"SELECT doc_id, lang FROM documents WHERE {has('text', PLACES)}",
    "s10_relevance_filter": f"SELECT a.vec_id, a.label FROM emb a WHERE a.label <> 9 AND EXISTS (SELECT 1 FROM emb b WHERE b.label = 9 AND {DOT.format(a='a', b='b')} >= 0.25)",
    "s11_top_n_per_source": """SELECT source, post_id, external_ref, popularity, CAST(rank AS INT) AS rank FROM (SELECT source, post_id, ref AS external_ref, impressions AS popularity,
 row_number() OVER (PARTITION BY source ORDER BY impressions DESC, ref) AS rank FROM (SELECT *, coalesce(external_ref, 'post:' || CAST(post_id AS VARCHAR)) AS ref FROM v_posts) y) x WHERE rank <= 20""",
    "s12_dedup_external_ref": """SELECT post_id, external_ref, CASE WHEN external_ref IS NULL THEN 'accepted'
 WHEN external_ref IN (SELECT external_ref FROM batch_all WHERE created_at < TIMESTAMP '2024-01-20' AND external_ref IS NOT NULL) THEN 'skipped'
 WHEN row_number() OVER (PARTITION BY external_ref ORDER BY post_id) > 1 THEN 'skipped' ELSE 'accepted' END AS outcome
FROM batch_all WHERE created_at >= TIMESTAMP '2024-01-20'""",
    "s13_content_items": f"""SELECT p.post_id, p.source, p.author_id, l.stance, l.sentiment, CASE WHEN l.doc_id IS NOT NULL THEN CAST(len(e.v) AS INT) END AS dim, CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'stored' END AS outcome
FROM v_posts p LEFT JOIN (SELECT l.doc_id, {STANCE.format(c='text')} AS stance, {SENTIMENT.format(c='text')} AS sentiment FROM labels l JOIN documents d USING (doc_id)) l USING (doc_id) LEFT JOIN emb e USING (vec_id)""",
    "l01_label_stance": f"SELECT doc_id, {STANCE.format(c='text')} AS stance FROM documents",
    "l02_label_sentiment": f"SELECT doc_id, {SENTIMENT.format(c='text')} AS sentiment FROM documents",
    "l03_outrage_score": f"""SELECT doc_id, CASE WHEN {has('text', ('hidden tax', 'secretly'))} THEN 0.8 ELSE 0.4 END::DOUBLE AS outrage_score,
 CASE WHEN len(toks) > 0 THEN round(len(list_filter(toks, lambda w: w IN ('the', 'and', 'les', 'und', 'der'))) / len(toks), 6) ELSE 0.0 END AS outrage_density
FROM (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS toks FROM documents) x""",
    "l04_topic_label": f"SELECT doc_id, {TOPIC.format(c='text')} AS topic_label FROM documents",
    "l05_sentiment_share": """SELECT date_trunc('day', created_at)::TIMESTAMP AS period, count(*) AS posts, round(count(*) FILTER (sentiment = 'negative') / count(*), 4) AS negative_share,
 round(count(*) FILTER (sentiment = 'positive') / count(*), 4) AS positive_share, round(count(*) FILTER (sentiment = 'neutral') / count(*), 4) AS neutral_share FROM v_posts GROUP BY 1""",
    "l06_text_vectors": """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents),
tf AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS INT) AS pos, count(*) AS tf FROM w WHERE w <> '' GROUP BY ALL),
df AS (SELECT pos, count(*) AS df FROM tf GROUP BY pos),
x AS (SELECT doc_id, pos, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS x FROM tf JOIN df USING (pos))
SELECT doc_id, pos, round(x / n, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS n FROM x) y WHERE n > 0 AND x <> 0""",
    "l07_cluster_statement": """SELECT claim_id, row_number() OVER w AS position, post_id, md5(text) AS text_md5, first_value(md5(text)) OVER w AS statement_md5, 'General' AS topic_label
FROM v_posts JOIN documents USING (doc_id) WHERE claim_id IS NOT NULL WINDOW w AS (PARTITION BY claim_id ORDER BY created_at, post_id)""",
    "l08_cap_segments": """SELECT claim_id, segment_name, position, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY position, segment_name) - 1 AS rank FROM (
 SELECT l_orderkey AS claim_id, l_returnflag || l_linestatus AS segment_name, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2) x) y""",
    "l09_grounding_block": "SELECT policy_id, block FROM blocks",
    "l09_grounding_summary": """SELECT 1 AS part, CAST(fault_line_id AS BIGINT) AS id, '- ' || community_name || ': ' || grievance_theme AS line FROM v_fault_lines
UNION ALL SELECT 2, CAST(topic_id AS BIGINT), name FROM v_topics""",
    "c01_attach_to_claims": f"SELECT a.post_id, a.claim_id, round(a.sim, 6) AS similarity, {STANCE.format(c='d.text')} AS stance FROM attached a JOIN documents d USING (doc_id)",
    "c02_cluster_posts": "SELECT post_id, cluster FROM clusters",
    "c02_density_clusters": "SELECT post_id, c.comp AS cluster FROM rest_posts JOIN d_rep USING (vec_id) JOIN d_comp c ON c.u = rep JOIN d_chosen x ON x.l = c.l AND x.comp = c.comp",
    "c04_topic_state": "SELECT topic_id, CAST(pos AS INT) AS pos, round(x, 6) AS x FROM f_state",
    "run_formation": """SELECT (SELECT count(DISTINCT cluster) FROM f_clusters) AS claims_created, (SELECT count(DISTINCT claim_id) FROM attached) AS claims_updated,
 (SELECT count(*) FROM f_clusters) + (SELECT count(*) FROM attached) AS posts_clustered, (SELECT count(DISTINCT topic_id) FROM f_topics WHERE how = 'new') AS topics_created, (SELECT count(*) FROM f_touched) AS topics_rescored""",
    "run_formation_claims": "SELECT cluster, claim_id, md5(text) AS statement_md5, post_count, topic_id, topic_name, how FROM f_built JOIN f_topics USING (claim_id)",
    "c07_formation_summary": "SELECT (SELECT count(DISTINCT cluster) FROM clusters) AS claims_created, (SELECT count(DISTINCT claim_id) FROM attached) AS claims_updated, (SELECT count(*) FROM clusters) + (SELECT count(*) FROM attached) AS posts_clustered",
    "c03_build_claims": f"""SELECT claim_id AS cluster, text AS claim_statement, {TOPIC.format(c='text')} AS topic_label, 'unreviewed' AS status, vec_id, created_at AS first_caught_at, n AS post_count
FROM (SELECT *, count(*) OVER (PARTITION BY claim_id) AS n, row_number() OVER (PARTITION BY claim_id ORDER BY created_at, post_id) AS r FROM v_posts WHERE claim_id IS NOT NULL) x JOIN documents USING (doc_id) WHERE r = 1""",
    "c04_assign_topics": """SELECT claim_id, topic_id, name AS topic_name, 'name' AS how FROM t_named
UNION ALL SELECT claim_id, b.topic_id, t.name, 'centroid' FROM t_best b JOIN v_topics t USING (topic_id)
UNION ALL SELECT claim_id, CAST('0x' || substr(md5(lower(trim(topic_label))), 1, 15) AS BIGINT), min(trim(topic_label)) OVER (PARTITION BY lower(trim(topic_label))), 'new' FROM t_rest WHERE claim_id NOT IN (SELECT claim_id FROM t_best)""",
    "c05_centroid": """SELECT label, CAST(pos - 1 AS INT) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (
 SELECT label, pos, avg(v[pos]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS pos FROM emb) x GROUP BY 1, 2) y""",
    "c06_topic_volume": "SELECT topic_id, bucket_start::TIMESTAMP AS bucket_start, supporting_volume FROM tvol",
    "q01_reach_inputs": f"""SELECT c.claim_id, coalesce(CAST(sum(p.impressions) AS BIGINT), 0) AS impressions, count(DISTINCT p.author_id) AS unique_authors, count(p.post_id) AS post_count, count(DISTINCT p.source) AS platforms
FROM v_claims c LEFT JOIN v_posts p ON p.claim_id = c.claim_id AND p.stance = 'supporting' AND p.created_at >= {AS_OF} - INTERVAL 20 DAY GROUP BY c.claim_id""",
    "q02_raw_reach": "SELECT claim_id, round(raw_reach, 6) AS raw_reach FROM reach_raw",
    "q03_minmax_per_topic": "SELECT claim_id, topic_id, reach_score FROM reach",
    "q04_volume_windows": "SELECT claim_id, volume_now, volume_before FROM pagg",
    "q05_raw_velocity": "SELECT claim_id, round(raw_velocity, 6) AS raw_velocity FROM vel",
    "q06_velocity_baseline": "SELECT topic_id, round(m, 6) AS baseline_mean, round(sd, 6) AS baseline_std FROM vbase",
    "q07_velocity_score": "SELECT claim_id, velocity_score FROM vel",
    "q08_falseness_corpus": "SELECT claim_id, round(sim, 6) AS similarity, score AS falseness_score FROM false8",
    "q09_falseness_fallback": "SELECT claim_id, CAST(falseness_score AS DOUBLE) AS falseness_score FROM false9",
    "q10_harm_score": "SELECT claim_id, harm_score FROM harm",
    "q11_apply_harm_overrides": f"""SELECT c.claim_id, ps AS harm_public_safety, ec AS harm_economic, confirmed AS harm_confirmed, CASE WHEN c.claim_type = 'existing' THEN h END AS harm_score,
 CASE WHEN c.claim_type = 'existing' THEN round(round(least(greatest(CASE WHEN f.score IS NULL THEN (0.15 * coalesce(reach_score, 0) + 0.15 * velocity_score + 0.3 * h + 0.1 * coalesce(ei_supporting, 0)) / 0.7
  ELSE 0.15 * coalesce(reach_score, 0) + 0.15 * velocity_score + 0.3 * h + 0.1 * coalesce(ei_supporting, 0) + 0.3 * f.score END, 0), 100), 4) * discount_factor, 4) END AS final_score
FROM (SELECT *, round(0.35 * ps + 0.3 * harm_institutional_trust + 0.2 * ec + 0.15 * harm_policy_disruption, 4) AS h FROM (
 SELECT c.*, CASE WHEN o.tox = 1 THEN 90.0 ELSE harm_public_safety END::DOUBLE AS ps, CASE WHEN o.q = 0 THEN 12.5 ELSE harm_economic END::DOUBLE AS ec, o.cid IS NOT NULL AS confirmed
 FROM v_claims c LEFT JOIN (SELECT doc_id % {NB} AS cid, max(toxic) AS tox, min(quality) AS q FROM labels GROUP BY 1) o ON o.cid = c.claim_id) y) c
LEFT JOIN reach USING (claim_id) LEFT JOIN vel USING (claim_id) LEFT JOIN false8 f USING (claim_id) LEFT JOIN ei USING (claim_id) LEFT JOIN disc d USING (claim_id)""",
    "q12_emotional_intensity": "SELECT claim_id, ei_supporting FROM ei",
    "q13_ei_opposing": "SELECT claim_id, ei_opposing FROM ei",
    "q14_npr": "SELECT claim_id, supporting, opposing, npr, npr IS NULL AS is_dormant FROM npr",
    "q15_discount": "SELECT claim_id, CAST(discount_factor AS DOUBLE) AS discount_factor FROM disc",
    "q16_claim_score": "SELECT claim_id, claim_score FROM scored",
    "q17_final_score": "SELECT claim_id, final_score FROM scored",
    "q18_rescore": """SELECT claim_id, claim_type, topic_id, reach_score, velocity_score, falseness_score, harm_score, emotional_intensity_score, ei_opposing, npr, is_dormant, discount_factor, claim_score, final_score FROM scored""",
    "q18_incremental_rescore": """SELECT claim_id, claim_type, topic_id, reach_score, velocity_score, falseness_score, harm_score, emotional_intensity_score, ei_opposing, npr, is_dormant, discount_factor, claim_score, final_score FROM scored""",
    "q19_score_snapshots": f"SELECT claim_id, final_score, {AS_OF} AS recorded_at FROM scored WHERE final_score IS NOT NULL",
    "d01_existing_board": """SELECT claim_id, claim_statement, topic_id, status, final_score, coalesce(supporting_count, 0) AS supporting_count, coalesce(opposing_count, 0) AS opposing_count, alert_on, total
FROM (SELECT *, count(*) OVER () AS total FROM scored WHERE claim_type = 'existing' AND topic_id IN (0, 1, 2, 3) AND claim_statement ILIKE '%th%' ORDER BY final_score DESC NULLS LAST, claim_id LIMIT 20 OFFSET 3) x
LEFT JOIN counts USING (claim_id) JOIN flags USING (claim_id)""",
    "d02_non_existing_board": """SELECT claim_id, claim_statement, topic_id, policy_id, created_at, CAST(NULL AS DOUBLE) AS final_score, false AS alert_on, count(*) OVER () AS total
FROM v_claims WHERE claim_type = 'non_existing' AND claim_statement ILIKE '%en%' ORDER BY created_at DESC, claim_id LIMIT 20 OFFSET 2""",
    "d03_statement_counts": "SELECT claim_id, supporting_count, opposing_count FROM counts",
    "d04_alert_flags": "SELECT claim_id, alert_on FROM flags",
    "d05_top_accounts": "SELECT claim_id, author_id, post_count, rank FROM tops",
    "d06_claim_detail": """SELECT s.* EXCLUDE (vec_id, policy_id), coalesce(supporting_posts, 0) AS supporting_posts, coalesce(opposing_posts, 0) AS opposing_posts, coalesce(neutral_posts, 0) AS neutral_posts,
 first_supporting, first_opposing, first_neutral, top_accounts, coalesce(policies, 0) AS policies, first_policy, t.name AS topic_name, alert_on
FROM scored s LEFT JOIN (SELECT claim_id, count(*) FILTER (stance = 'supporting') AS supporting_posts, count(*) FILTER (stance = 'opposing') AS opposing_posts, count(*) FILTER (stance = 'neutral') AS neutral_posts,
 first(post_id ORDER BY created_at, post_id) FILTER (stance = 'supporting') AS first_supporting, first(post_id ORDER BY created_at, post_id) FILTER (stance = 'opposing') AS first_opposing,
 first(post_id ORDER BY created_at, post_id) FILTER (stance = 'neutral') AS first_neutral FROM v_posts WHERE claim_id IS NOT NULL GROUP BY claim_id) l USING (claim_id)
LEFT JOIN (SELECT claim_id, string_agg(author_id, ',' ORDER BY rank) AS top_accounts FROM tops GROUP BY claim_id) a USING (claim_id)
LEFT JOIN (SELECT claim_id, count(*) AS policies, min(policy_id) AS first_policy FROM v_policy_links GROUP BY claim_id) k USING (claim_id)
LEFT JOIN v_topics t USING (topic_id) LEFT JOIN flags USING (claim_id) WHERE claim_type = 'existing'""",
    "d06_claim_posts": "SELECT claim_id, stance, post_id, row_number() OVER (PARTITION BY claim_id, stance ORDER BY created_at, post_id) AS position FROM v_posts WHERE claim_id IS NOT NULL",
    "d07_predicted_detail": "SELECT c.claim_id, c.claim_statement, c.status, c.policy_id, p.title AS policy_title FROM v_claims c LEFT JOIN v_policies p USING (policy_id) WHERE claim_type = 'non_existing'",
    "d08_watchlist": """SELECT claim_id, claim_statement, coalesce(final_score, 0.0) AS final_score, CASE WHEN coalesce(final_score, 0) >= 45 THEN 'over_threshold' ELSE 'under_threshold' END AS threshold_status, added_at,
 count(*) OVER () AS total FROM v_alerts JOIN scored USING (claim_id) WHERE claim_statement ILIKE '%an%' ORDER BY added_at DESC, claim_id LIMIT 15 OFFSET 1""",
    **{
        f"d09_score_trend_{g}": f"""SELECT claim_id, bucket, min(min(recorded_at)) OVER (PARTITION BY bucket) AS recorded_at, CAST(sum(CAST(final_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_score
FROM (SELECT *, {k} AS bucket FROM v_snapshots WHERE claim_id IN (SELECT claim_id FROM v_alerts)) x GROUP BY claim_id, bucket"""
        for g, k in {
            "day": "strftime(recorded_at, '%Y-%m-%d')", "week": "strftime(recorded_at, '%G-W%V')",
            "month": "strftime(recorded_at, '%Y-%m')", "year": "strftime(recorded_at, '%Y')",
        }.items()
    },
    "d10_policy_board": """SELECT policy_id, title, latest IS NOT NULL AS has_activity, coalesce(latest, created_at) AS sort_time, count(*) OVER () AS total FROM v_policies
LEFT JOIN (SELECT policy_id, max(created_at) AS latest FROM (SELECT l.policy_id, c.created_at FROM v_policy_links l JOIN v_claims c USING (claim_id) UNION ALL SELECT policy_id, created_at FROM v_claims WHERE policy_id IS NOT NULL) x GROUP BY 1) y USING (policy_id)
WHERE title ILIKE '%widget%' AND year(rolled_out_date) IN (1995, 1996, 1997, 2023, 2024) ORDER BY has_activity DESC, sort_time DESC, policy_id LIMIT 50 OFFSET 5""",
    "d11_policy_detail": """SELECT p.policy_id, claim_id, claim_statement, status, kind, p.title FROM (
 SELECT l.policy_id, c.claim_id, claim_statement, status, 'linked' AS kind FROM v_policy_links l JOIN v_claims c USING (claim_id) WHERE claim_type = 'existing'
 UNION ALL SELECT policy_id, claim_id, claim_statement, status, 'predicted' FROM v_claims WHERE policy_id IS NOT NULL) x JOIN v_policies p USING (policy_id)""",
    "d12_policy_status": "SELECT policy_id, CASE WHEN rolled_out_date <= DATE '1997-01-01' THEN 'rolled_out' ELSE 'not_rolled_out' END AS policy_status FROM v_policies",
    "d13_topic_list": "SELECT topic_id, name FROM v_topics ORDER BY name, topic_id",
    "d13_fault_line_list": "SELECT fault_line_id, community_name, grievance_theme, description FROM v_fault_lines ORDER BY community_name, fault_line_id",
    "p01_policy_text": r"""SELECT policy_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS length FROM (
 SELECT policy_id, regexp_replace(title || chr(10) || coalesce(description, '') || chr(10) || coalesce(document_text, ''), '^\s+|\s+$', '', 'g') AS t FROM v_policies) x""",
    "p02_match_candidates": "SELECT policy_id, claim_id, round(sim, 6) AS similarity FROM pol_best",
    "p03_confirm_matches": "SELECT policy_id, claim_id FROM confirmed",
    "p04_policy_links": """SELECT policy_id, claim_id, 'kept' AS origin FROM v_policy_links WHERE policy_id NOT IN (SELECT policy_id FROM rerun)
UNION ALL SELECT policy_id, claim_id, 'new' FROM confirmed WHERE policy_id IN (SELECT policy_id FROM rerun)""",
    "p04_supersede_predicted": "SELECT claim_id, claim_type, policy_id FROM v_claims WHERE NOT (claim_type = 'non_existing' AND coalesce(policy_id IN (SELECT policy_id FROM rerun), false))",
    "p05_match_counts": """SELECT policy_id, coalesce(l, 0) AS matched_claims, coalesce(r, 0) AS predicted_claims FROM v_policies
LEFT JOIN (SELECT policy_id, count(*) AS l FROM v_policy_links GROUP BY 1) x USING (policy_id) LEFT JOIN (SELECT policy_id, count(*) AS r FROM v_claims WHERE claim_type = 'non_existing' GROUP BY 1) y USING (policy_id)""",
    "p06_nearest_policy": "SELECT claim_id, policy_id FROM (" + best("claims_v", "claim_id", "policies_v", "policy_id") + ") b",
    "p07_retrieve_fault_lines": "SELECT policy_id, fault_line_id, CAST(rn AS INT) AS rank, round(sim, 6) AS similarity FROM retrieved",
    "p08_uncovered_context": """SELECT policy_id, block || coalesce(chr(10) || chr(10) || 'Claims already matched to this policy (predict something NOT already covered by these):' || chr(10) || listed, '') AS context
FROM blocks LEFT JOIN (SELECT policy_id, string_agg('- ' || claim_statement, chr(10) ORDER BY claim_id) AS listed FROM confirmed GROUP BY 1) x USING (policy_id)""",
    "b01_flag_pairs": "SELECT post_a, post_b, score, reasons FROM flagged",
    "b02_cluster_members": "SELECT cluster, post_id, author_id FROM fl_comp JOIN v_posts ON post_id = u",
    "b02_pair_clusters": "SELECT cluster, posts, authors, coordination_score, reasons FROM pc",
    "b03_risk_score": """SELECT least(round(0.5 * sum(posts) / (SELECT count(*) FROM v_posts) + 0.5 * max(coordination_score), 4), 1.0) AS risk_score,
 count(*) > 0 AND least(round(0.5 * sum(posts) / (SELECT count(*) FROM v_posts) + 0.5 * max(coordination_score), 4), 1.0) >= 0.5 AS likely_coordinated, count(*) AS clusters FROM pc""",
}


def _settings_sql():
    """Stored text of the i-th key comes from the i-th nation; blank or absent text means the default."""
    from claimlens.config import INTEGER_SETTINGS, SETTING_DEFAULTS

    picks = []
    for i, (key, default) in enumerate(SETTING_DEFAULTS.items()):
        stored = f"(SELECT CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey % 8 + 0.75 END FROM nation WHERE n_nationkey = {i})"
        value = f"CAST(coalesce({stored}, {default}) AS DOUBLE)"
        if key in INTEGER_SETTINGS:
            value = f"trunc({value})"
        if key == "scoring.harm_weight_policy_disruption":
            value = f"least({value}, 0.25)"
        picks.append(f"{value} AS {key.replace('.', '_')}")
    weights = " + ".join(k.replace(".", "_") for k in SETTING_DEFAULTS if k.startswith("scoring.weight_"))
    return f"SELECT *, abs({weights} - 1) <= 1e-6 AS weights_sum_to_one FROM (SELECT {', '.join(picks)}) x"


SQL["q20_load_config"] = _settings_sql()
