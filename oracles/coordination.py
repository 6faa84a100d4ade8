"""Twins: coordination signals, fusion, graph, metrics, evidence, run tables, streams."""

from .core import AS_OF, DOT, SPACE

Z = "2.3263478740408408"
NORM = "lower(text)"
for pattern, by in (
    ("https?://" + SPACE.replace("[", "[^") + "+", "<url>"), (r"@[\p{L}\p{N}_]+", "<mention>"),
    (r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{1f1e6}-\x{1f1ff}]+", ""),
    ("!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{2,}", "."), (",{2,}", ","), (SPACE + "+", " "),
):
    NORM = f"regexp_replace({NORM}, '{pattern}', '{by}', 'g')"
NORM = f"trim({NORM})"
TEMPLATE = "^([a-z]+)_([a-z]+)([0-9]{2,4})$"


def grams(c):
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - 3, 1) + 1), lambda i: substr({c}, i, 4)))"


def chunks(c):
    """Hex text as two integers of at most 15 and 1 digits."""
    return [f"CAST('0x' || substr({c}, 1, 15) AS BIGINT)", f"CAST('0x' || substr({c}, 16, 1) AS BIGINT)"]


def filled(c):
    return f"nullif({c}, '')"


HEXA = "regexp_full_match(a.profile_hash, '[0-9a-fA-F]+') AND regexp_full_match(b.profile_hash, '[0-9a-fA-F]+') AND length(a.profile_hash) = length(b.profile_hash)"
BITS = " + ".join(f"bit_count(xor({x}, {y}))" for x, y in zip(chunks("a.profile_hash"), chunks("b.profile_hash")))
FAMILIES = ("w_time", "w_text", "w_amp", "w_meta", "w_struct")
WEIGHTS = {"w_time": 0.30, "w_text": 0.25, "w_amp": 0.20, "w_meta": 0.15, "w_struct": 0.10}
MEAN = lambda *c: (
    "(" + " + ".join(f"coalesce({x}, 0)" for x in c) + ") / nullif(" + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in c) + ", 0)"
)
PARTS = ("creation", "handle", "image", "bio", "location", "client")
META = f"""SELECT p.claim_id, p.a, p.b,
 exp(-abs(epoch_us(a.created_at_platform) - epoch_us(b.created_at_platform)) / 1e6 / 3600 / 36) AS creation,
 least(greatest(0.5 * (1 - levenshtein(lower(a.handle), lower(b.handle)) / greatest(length(a.handle), length(b.handle)))
  + CASE WHEN length(regexp_extract(lower(a.handle), '{TEMPLATE}', 3)) > 0 AND length(regexp_extract(lower(a.handle), '{TEMPLATE}', 3)) = length(regexp_extract(lower(b.handle), '{TEMPLATE}', 3)) THEN 0.5
   WHEN substr(lower(a.handle), 1, 3) = substr(lower(b.handle), 1, 3) OR right(lower(a.handle), 3) = right(lower(b.handle), 3) THEN 0.25 ELSE 0 END, 0), 1)::DOUBLE AS handle,
 CASE WHEN {HEXA} THEN 1 - ({BITS}) / (4 * length(a.profile_hash)) END AS image,
 CASE WHEN a.bio IS NOT NULL AND b.bio IS NOT NULL THEN len(list_intersect({grams('lower(a.bio)')}, {grams('lower(b.bio)')})) / len(list_distinct(list_concat({grams('lower(a.bio)')}, {grams('lower(b.bio)')}))) END AS bio,
 CASE WHEN a.declared_location IS NOT NULL AND b.declared_location IS NOT NULL THEN CASE WHEN a.declared_location = b.declared_location THEN 1.0 ELSE 0.0 END END::DOUBLE AS location,
 CASE WHEN a.client_app IS NOT NULL AND b.client_app IS NOT NULL THEN CASE WHEN a.client_app = b.client_app THEN 1.0 ELSE 0.0 END END::DOUBLE AS client
FROM {"{pairs}"} p LEFT JOIN v_accounts a ON a.account_id = p.a LEFT JOIN v_accounts b ON b.account_id = p.b"""


def core_rounds(k, rounds):
    """The pruning rounds written out; the last two must agree (checked by the query)."""
    ctes = {"core_0": "SELECT claim_id, a, b, w_total FROM fused"}
    for i in range(1, rounds + 1):
        e = f"core_{i - 1}"
        ctes[f"core_{i}"] = f"""SELECT e.* FROM {e} e WHERE
 (SELECT count(*) FROM {e} d WHERE d.claim_id = e.claim_id AND (d.a = e.a OR d.b = e.a)) >= {k} AND (SELECT count(*) FROM {e} d WHERE d.claim_id = e.claim_id AND (d.a = e.b OR d.b = e.b)) >= {k}"""
    return ctes


CORE_ROUNDS = 8
TEXT_LIST = f"SELECT doc_id, {NORM} AS norm FROM documents"

CTES = {
    "cand": f"""SELECT *, author_id AS account_id FROM v_posts WHERE claim_id IN (SELECT claim_id FROM v_claims WHERE claim_type = 'existing') AND stance = 'supporting' AND author_id IS NOT NULL
 AND source <> 'rss' AND created_at BETWEEN TIMESTAMP '2024-01-01' AND {AS_OF}""",
    "excl": """SELECT 'u' || CAST(c_custkey AS VARCHAR) AS account_id FROM customer WHERE c_acctbal < -500
 UNION SELECT account_id FROM v_accounts WHERE handle IN (SELECT handle FROM v_accounts JOIN customer ON account_id = 'u' || CAST(c_custkey AS VARCHAR) WHERE c_acctbal > 9990)""",
    "scope": "SELECT * FROM cand WHERE account_id NOT IN (SELECT account_id FROM excl)",
    "candidates": """SELECT claim_id, account_id, count(*) AS n_posts, count(*) OVER (PARTITION BY claim_id) AS candidates, false AS truncated FROM scope GROUP BY 1, 2""",
    "totals": f"""SELECT author_id AS account_id, count(*) AS total_posts FROM v_posts WHERE created_at BETWEEN TIMESTAMP '2024-01-01' AND {AS_OF} AND author_id IN (SELECT account_id FROM candidates) GROUP BY 1""",
    "tbins": "SELECT claim_id, account_id, CAST(floor(epoch(created_at) / 3600) AS BIGINT) AS bin, count(*) AS n FROM scope GROUP BY ALL",
    "tacc": "SELECT claim_id, account_id, count(*) AS act, sum(n) AS posts FROM tbins GROUP BY ALL",
    "tsize": "SELECT claim_id, v, count(*) AS h, sum(sum(v)) OVER (PARTITION BY claim_id) AS dummy FROM (SELECT claim_id, bin, count(*) AS v FROM tbins GROUP BY ALL) x GROUP BY claim_id, v",
    "ttot": "SELECT claim_id, sum(v * h) AS t FROM tsize GROUP BY claim_id",
    "tobs": """SELECT x.claim_id, x.account_id AS a, y.account_id AS b, count(*) AS obs FROM tbins x JOIN tbins y ON x.claim_id = y.claim_id AND x.bin = y.bin AND x.account_id < y.account_id GROUP BY ALL""",
    "w_time": f"""SELECT claim_id, a, b, round(least((obs - mean) / (least(pa, pb) - mean), 1.0), 4) AS score FROM (
 SELECT o.claim_id, o.a, o.b, o.obs, x.posts AS pa, y.posts AS pb,
  sum(s.h * least(1.0, s.v / t.t * x.act) * least(1.0, s.v / t.t * y.act)) AS mean,
  sum(s.h * least(1.0, s.v / t.t * x.act) * least(1.0, s.v / t.t * y.act) * least(1.0, s.v / t.t * x.act) * least(1.0, s.v / t.t * y.act)) AS sec
 FROM tobs o JOIN tacc x ON x.claim_id = o.claim_id AND x.account_id = o.a JOIN tacc y ON y.claim_id = o.claim_id AND y.account_id = o.b
 JOIN tsize s ON s.claim_id = o.claim_id JOIN ttot t ON t.claim_id = o.claim_id GROUP BY ALL) z
WHERE obs > mean + {Z} * sqrt(greatest(mean - sec, 0)) AND least(pa, pb) > mean AND round((obs - mean) / (least(pa, pb) - mean), 4) > 0""",
    "norms": TEXT_LIST,
    "units": "SELECT doc_id, norm, length(norm) AS norm_length, min(doc_id) OVER (PARTITION BY norm) AS text_id FROM norms",
    "phrases": f"SELECT DISTINCT {NORM} AS norm FROM documents JOIN labels USING (doc_id) WHERE quality = 0",
    "usable": "SELECT doc_id, text_id FROM units WHERE norm_length >= 25 AND norm NOT IN (SELECT norm FROM phrases)",
    "elig": "SELECT s.claim_id, s.account_id, s.post_id, s.created_at, u.text_id FROM scope s JOIN usable u USING (doc_id) WHERE NOT s.is_native_reshare",
    "chars": "SELECT text_id, norm, string_split(norm, '') AS c FROM units WHERE doc_id = text_id AND norm <> ''",
    "shing": """SELECT text_id, CASE WHEN len(c) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4])) END AS sh FROM chars""",
    "shinh": "SELECT text_id, len(sh) AS n, list_transform(sh, lambda x: hash(x)) AS sh FROM shing",
    "stok": "SELECT text_id, n, unnest(sh) AS h FROM shinh",
    "sdf": "SELECT h, count(*) AS df FROM stok GROUP BY h HAVING count(*) > 1",
    # a set pair at 0.8 or more shares one of the first n - ceil(0.8 n) + 1 shingles in any common order
    "spre": """SELECT text_id, n, h FROM (SELECT text_id, n, h, df, row_number() OVER (PARTITION BY text_id ORDER BY coalesce(df, 1), h) AS pos FROM stok LEFT JOIN sdf USING (h)) x WHERE pos <= n - ceil(0.8 * n) + 1 AND df > 1""",
    "scand": "SELECT DISTINCT a.text_id AS ta, b.text_id AS tb FROM spre a JOIN spre b ON a.h = b.h AND a.text_id < b.text_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)",
    "near": """SELECT text_a, text_b, inter / (na + nb - inter) AS jaccard FROM (SELECT a.text_id AS text_a, b.text_id AS text_b, a.n AS na, b.n AS nb, len(list_intersect(a.sh, b.sh)) AS inter
 FROM scand JOIN shinh a ON a.text_id = ta JOIN shinh b ON b.text_id = tb) x WHERE inter / (na + nb - inter) >= 0.8""",
    "tvec": "SELECT u.text_id, CAST(e.embedding AS DOUBLE[]) AS v, e.vec_id FROM units u JOIN embeddings e ON e.vec_id = u.doc_id % (SELECT count(*) FROM embeddings) WHERE u.doc_id = u.text_id",
    "tclass": "SELECT text_id, v, min(text_id) OVER (PARTITION BY v) AS rep FROM tvec",
    "sem": f"SELECT a.rep AS ra, b.rep AS rb, {DOT.format(a='a', b='b')} AS sim FROM (SELECT DISTINCT rep, v FROM tclass) a JOIN (SELECT DISTINCT rep, v FROM tclass) b ON a.rep < b.rep WHERE {DOT.format(a='a', b='b')} >= 0.40",
    "links": """SELECT text_a, text_b FROM near
UNION SELECT least(x.text_id, y.text_id), greatest(x.text_id, y.text_id) FROM tclass x JOIN tclass y ON x.rep = y.rep AND x.text_id < y.text_id
UNION SELECT least(x.text_id, y.text_id), greatest(x.text_id, y.text_id) FROM sem JOIN tclass x ON x.rep = ra JOIN tclass y ON y.rep = rb""",
    "lsym": "SELECT text_a AS s, text_b AS t FROM links UNION ALL SELECT text_b, text_a FROM links",
    "esize": "SELECT claim_id, account_id, count(*) AS m FROM elig GROUP BY ALL",
    "epairs": """SELECT x.claim_id, x.account_id AS a, y.account_id AS b FROM elig x JOIN elig y ON x.claim_id = y.claim_id AND x.account_id < y.account_id AND x.text_id = y.text_id
UNION ALL SELECT x.claim_id, x.account_id, y.account_id FROM elig x JOIN lsym l ON l.s = x.text_id JOIN elig y ON y.claim_id = x.claim_id AND y.text_id = l.t AND x.account_id < y.account_id""",
    "w_text": """SELECT p.claim_id, a, b, round(least(1.0, p.n / least(x.m, y.m)), 4) AS score FROM (SELECT claim_id, a, b, count(*) AS n FROM epairs GROUP BY ALL) p
JOIN esize x ON x.claim_id = p.claim_id AND x.account_id = a JOIN esize y ON y.claim_id = p.claim_id AND y.account_id = b""",
    "targ": """SELECT DISTINCT claim_id, account_id, target FROM (SELECT claim_id, account_id, unnest([ 'reshare:' || reshared_post_id, 'quote:' || quoted_post_id, 'reply:' || replied_to_post_id, 'url:' || outbound_url, 'domain:' || outbound_domain]) AS target FROM scope) x WHERE target IS NOT NULL""",
    "tidf": """SELECT claim_id, target, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM targ JOIN (SELECT claim_id, count(DISTINCT account_id) AS n FROM targ GROUP BY 1) c USING (claim_id) GROUP BY claim_id, target, n""",
    "tw": "SELECT t.*, idf, sqrt(sum(idf * idf) OVER (PARTITION BY claim_id, account_id)) AS nrm FROM targ t JOIN tidf USING (claim_id, target)",
    "w_amp": """SELECT x.claim_id, x.account_id AS a, y.account_id AS b, round(least(1.0, sum(x.idf * y.idf) / (any_value(x.nrm) * any_value(y.nrm))), 4) AS score
FROM tw x JOIN tw y ON x.claim_id = y.claim_id AND x.target = y.target AND x.account_id < y.account_id GROUP BY ALL""",
    "mem": """SELECT DISTINCT CAST(s.claim_id AS VARCHAR) || '-' || CAST(g.community_id AS VARCHAR) AS network_id, s.claim_id, s.account_id, g.community_id FROM scope s JOIN v_groups g USING (account_id)""",
    "gpairs": "SELECT x.claim_id, x.account_id AS a, y.account_id AS b FROM mem x JOIN mem y ON x.network_id = y.network_id AND x.account_id < y.account_id",
    "meta_parts": META.replace("{pairs}", "gpairs"),
    "fown": """SELECT c.claim_id, c.account_id, f.follows, count(*) OVER (PARTITION BY c.claim_id, f.follows) AS owners FROM candidates c JOIN v_followers f USING (account_id)""",
    "sraw": "SELECT x.claim_id, x.account_id AS a, y.account_id AS b, sum(1 / ln(x.owners + 1)) AS s FROM fown x JOIN fown y ON x.claim_id = y.claim_id AND x.follows = y.follows AND x.account_id < y.account_id GROUP BY ALL",
    "w_struct": "SELECT claim_id, a, b, round(s / max(s) OVER (PARTITION BY claim_id), 4) AS score FROM sraw",
    "four": "SELECT *, 'w_time' AS family FROM w_time UNION ALL SELECT *, 'w_text' FROM w_text UNION ALL SELECT *, 'w_amp' FROM w_amp UNION ALL SELECT *, 'w_struct' FROM w_struct",
    "mpairs": "SELECT DISTINCT claim_id, a, b FROM four WHERE score >= 0.25",
    "mparts": META.replace("{pairs}", "mpairs"),
    "w_meta": f"SELECT claim_id, a, b, round({MEAN(*PARTS)}, 4) AS score, 'w_meta' AS family FROM mparts",
    "five": "SELECT * FROM four UNION ALL SELECT * FROM w_meta WHERE score > 0",
    "wide": "SELECT claim_id, a, b, " + ", ".join(f"coalesce(max(score) FILTER (family = '{f}'), 0.0)::DOUBLE AS {f}" for f in FAMILIES)
    + ", count(*) FILTER (score >= 0.25) AS strong, count(*) FILTER (score > 0) AS signal_count FROM five GROUP BY ALL",
    "wide9": f"SELECT *, CAST({' + '.join(f'{w} * {f}' for f, w in WEIGHTS.items())} AS DECIMAL(18,9)) AS total FROM wide",
    "fused": f"SELECT claim_id, a, b, round(total, 4)::DOUBLE AS w_total, {', '.join(FAMILIES)}, signal_count FROM wide9 WHERE total >= 0.20 AND strong >= 2",
    **core_rounds(3, CORE_ROUNDS),
    "e_sym": "SELECT claim_id, a AS u, b AS v FROM fused UNION ALL SELECT claim_id, b, a FROM fused",
    "e_walk": "SELECT DISTINCT claim_id, u, u AS w FROM e_sym UNION SELECT s.claim_id, s.u, x.w FROM e_walk x JOIN e_sym s ON s.claim_id = x.claim_id AND s.v = x.u WHERE x.w < s.u",
    "gedge": """SELECT f.*, x.community_id AS ca, y.community_id AS cb FROM fused f LEFT JOIN mem x ON x.claim_id = f.claim_id AND x.account_id = a LEFT JOIN mem y ON y.claim_id = f.claim_id AND y.account_id = b""",
    "shape": """SELECT m.claim_id, m.community_id AS community, m.network_id, m.members, coalesce(e.n, 0) AS edges,
 CASE WHEN members < 2 THEN 0.0 ELSE round(coalesce(e.n, 0) / (members * (members - 1) / 2), 4) END AS density,
 CASE WHEN 2 * coalesce(ins, 0) + coalesce(cut, 0) > 0 THEN round(coalesce(cut, 0) / (2 * coalesce(ins, 0) + coalesce(cut, 0)), 4) ELSE 0.0 END::DOUBLE AS conductance
FROM (SELECT claim_id, community_id, network_id, count(*) AS members FROM mem GROUP BY ALL) m
LEFT JOIN (SELECT claim_id, ca AS community_id, count(*) AS n, sum(w_total) AS ins FROM gedge WHERE ca = cb GROUP BY ALL) e USING (claim_id, community_id)
LEFT JOIN (SELECT claim_id, c AS community_id, sum(w_total) AS cut FROM (SELECT claim_id, ca AS c, w_total FROM gedge WHERE ca IS DISTINCT FROM cb UNION ALL SELECT claim_id, cb, w_total FROM gedge WHERE ca IS DISTINCT FROM cb) z GROUP BY ALL) k USING (claim_id, community_id)""",
    "npost": "SELECT s.*, m.network_id, m.community_id FROM scope s JOIN mem m USING (claim_id, account_id)",
    "nelig": "SELECT e.*, m.network_id FROM elig e JOIN mem m USING (claim_id, account_id)",
    "nown": "SELECT network_id, account_id, count(*) AS n FROM npost GROUP BY ALL",
    "gate": """SELECT network_id, members, claim_posts, round(anc, 4) AS anchoring_share, round(ovl, 4) AS overlap_ratio,
 CASE WHEN anc < 0.30 THEN 'anchoring' WHEN claim_posts < 8 THEN 'evidence_volume' WHEN ovl < 0.15 THEN 'link_strength' END AS failed_test FROM (
 SELECT network_id, count(*) AS members, CAST(sum(n) AS BIGINT) AS claim_posts, count(*) FILTER (n >= 2) / count(*) AS anc, sum(n) / sum(coalesce(total_posts, n)) AS ovl
 FROM nown LEFT JOIN totals USING (account_id) GROUP BY 1) x""",
    "nbins": "SELECT network_id, CAST(floor(epoch(created_at) / 3600) AS BIGINT) AS bin, count(*) AS c FROM npost GROUP BY ALL",
    "nburst": """SELECT network_id, CAST(sum(CASE WHEN c > m + 3 * sd THEN c ELSE 0 END) AS BIGINT) AS posts_in_burst, CAST(sum(c) AS BIGINT) AS total_posts FROM (SELECT *, avg(c) OVER (PARTITION BY network_id) AS m, stddev_pop(c) OVER (PARTITION BY network_id) AS sd FROM nbins) x GROUP BY 1""",
    "nwt": """SELECT x.network_id, avg(score) AS mean_w FROM w_time w JOIN mem x ON x.claim_id = w.claim_id AND x.account_id = w.a JOIN mem y ON y.network_id = x.network_id AND y.account_id = w.b GROUP BY 1""",
    "sy": "SELECT network_id, posts_in_burst, total_posts, 60 * coalesce(mean_w, 0) + 40 * posts_in_burst / total_posts AS sy FROM nburst LEFT JOIN nwt USING (network_id)",
    "dupposts": """SELECT network_id, post_id, account_id, text_id, count(*) OVER (PARTITION BY network_id, text_id) > 1
 OR EXISTS (SELECT 1 FROM lsym l JOIN nelig o ON o.text_id = l.t WHERE l.s = e.text_id AND o.network_id = e.network_id) AS is_dup FROM nelig e""",
    "du": """SELECT network_id, coalesce(d, 0) AS duplicated_posts, total_posts, 100 * coalesce(d, 0) / total_posts AS du FROM (SELECT network_id, count(*) AS total_posts FROM npost GROUP BY 1) t
LEFT JOIN (SELECT network_id, count(*) AS d FROM dupposts WHERE is_dup GROUP BY 1) x USING (network_id)""",
    "macc": "SELECT m.network_id, a.* FROM mem m LEFT JOIN v_accounts a USING (account_id)",
    "win": """SELECT network_id, max(c) AS in_window, count(*) AS known FROM (SELECT network_id, count(*) OVER (PARTITION BY network_id ORDER BY created_at_platform RANGE BETWEEN CURRENT ROW AND {w} FOLLOWING) AS c FROM macc WHERE created_at_platform IS NOT NULL) x GROUP BY 1""",
    "tpl": f"""SELECT network_id, count(*) FILTER (tn >= 2 AND is_t) / count(*) AS template_share, count(*) FILTER (pn >= 2 AND profile_hash IS NOT NULL) / count(*) AS image_share FROM (
 SELECT *, count(*) OVER (PARTITION BY network_id, is_t, p, d) AS tn, count(*) OVER (PARTITION BY network_id, profile_hash) AS pn FROM (
 SELECT network_id, profile_hash, regexp_matches(lower(handle), '{TEMPLATE}') AS is_t, regexp_extract(lower(handle), '{TEMPLATE}', 1) AS p, length(regexp_extract(lower(handle), '{TEMPLATE}', 3)) AS d FROM macc) x) y GROUP BY 1""",
    "ages": f"SELECT account_id, (epoch_us({AS_OF}) - epoch_us(created_at_platform)) / 3.6e9 AS age FROM v_accounts WHERE created_at_platform IS NOT NULL",
    "medage": "SELECT network_id, age FROM (SELECT network_id, age, row_number() OVER (PARTITION BY network_id ORDER BY age) AS r, count(*) OVER (PARTITION BY network_id) AS c FROM mem JOIN ages USING (account_id)) x WHERE r = c // 2 + 1",
    "ageinv": "SELECT network_id, 1 - (SELECT count(*) FROM ages a WHERE a.age <= m.age) / (SELECT count(*) FROM ages) AS age_inverted FROM medage m",
    "pr": f"""SELECT t.network_id, CASE WHEN known >= 2 THEN in_window ELSE 0 END AS in_window, CASE WHEN known >= 2 THEN known ELSE 0 END AS known,
 100 * coalesce({MEAN('CASE WHEN known >= 2 THEN in_window / known END', 'template_share', 'image_share', 'age_inverted')}, 0) AS pr
FROM tpl t LEFT JOIN win36 USING (network_id) LEFT JOIN ageinv USING (network_id)""",
    "ngaps": "SELECT network_id, account_id, gap FROM (SELECT network_id, account_id, (epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY network_id, account_id ORDER BY created_at)) / 1e6 AS gap FROM npost) x WHERE gap IS NOT NULL",
    "reg": """SELECT network_id, account_id, CASE WHEN any_value(hi) = any_value(lo) THEN 1.0 ELSE 1 + sum(c / m * ln(c / m)) / ln(any_value(k)) END AS regularity FROM (
 SELECT network_id, account_id, lo, hi, m, k, slot, count(*) AS c FROM (
  SELECT *, CASE WHEN hi > lo THEN least(floor((gap - lo) / ((hi - lo) / k)), k - 1) ELSE 0 END AS slot FROM (
   SELECT *, min(gap) OVER w AS lo, max(gap) OVER w AS hi, count(*) OVER w AS m, least(10, count(*) OVER w) AS k FROM ngaps WINDOW w AS (PARTITION BY network_id, account_id)) x WHERE m >= 2) y GROUP BY ALL) z GROUP BY 1, 2""",
    "acts": """SELECT network_id, account_id, count(DISTINCT hour(created_at)) / 24 AS circadian, least(count(*) / 30.0 / 50.0, 1.0)::DOUBLE AS rate, count(*) FILTER (is_native_reshare OR reshared_post_id IS NOT NULL) / count(*) AS reshare_ratio FROM npost GROUP BY 1, 2""",
    "au": f"""SELECT network_id, 100 * avg({MEAN('regularity', 'circadian', 'rate', 'reshare_ratio')}) AS au, any_value(h) AS active_hours FROM acts LEFT JOIN reg USING (network_id, account_id)
JOIN (SELECT network_id, count(DISTINCT hour(created_at)) AS h FROM npost GROUP BY 1) t USING (network_id) GROUP BY 1""",
    "met": """SELECT s.network_id, round(sy, 2) AS sy, round(du, 2) AS du, round(100 * (1 - conductance), 2) AS co, round(pr, 2) AS pr, round(au, 2) AS au,
 round(CAST(least(greatest(0.25 * sy + 0.25 * du + 0.20 * (100 * (1 - conductance)) + 0.15 * pr + 0.15 * au, 0), 100) AS DECIMAL(18,9)), 2)::DOUBLE AS coordination_score,
 posts_in_burst, s.total_posts, duplicated_posts, in_window, known, active_hours
FROM sy s JOIN du USING (network_id) JOIN shape USING (network_id) JOIN pr USING (network_id) JOIN au USING (network_id)""",
    "breadth": "SELECT *, CAST((sy >= 50)::INT + (du >= 50)::INT + (co >= 50)::INT + (pr >= 50)::INT + (au >= 50)::INT AS INT) AS signal_breadth FROM met",
    "dbins": "SELECT network_id, time_bucket(INTERVAL 1 DAY, created_at)::TIMESTAMP AS bin_start, count(*) AS post_count FROM npost GROUP BY ALL",
    # of n bins with sum s and sum of squares q, whole numbers: c > mean + 3 deviations says n c - s > 3 sqrt(n q - s s)
    "bursts": """SELECT network_id, bin_start, post_count, CASE WHEN v > 0 THEN round(CAST(CAST(d AS DOUBLE) / sqrt(CAST(v AS DOUBLE)) AS DECIMAL(18,9)), 4)::DOUBLE ELSE 0.0 END AS zscore,
 d > 0 AND d * d > 9 * v AS is_anomalous
FROM (SELECT *, count(*) OVER w * post_count::HUGEINT - sum(post_count) OVER w AS d, count(*) OVER w * sum(post_count::HUGEINT * post_count) OVER w - sum(post_count) OVER w * sum(post_count) OVER w AS v FROM dbins WINDOW w AS (PARTITION BY network_id)) x""",
    "g_sym": "SELECT DISTINCT x.network_id, x.text_id AS u, y.text_id AS v FROM nelig x JOIN lsym l ON l.s = x.text_id JOIN nelig y ON y.network_id = x.network_id AND y.text_id = l.t",
    "g_walk": "SELECT DISTINCT network_id, text_id AS u, text_id AS w FROM nelig UNION SELECT s.network_id, s.u, x.w FROM g_walk x JOIN g_sym s ON s.network_id = x.network_id AND s.v = x.u WHERE x.w < s.u",
    "g_comp": "SELECT network_id, u AS text_id, min(w) AS comp FROM g_walk GROUP BY ALL",
    "g_group": """SELECT network_id, comp, sha256(string_agg(CAST(post_id AS VARCHAR), '|' ORDER BY CAST(post_id AS VARCHAR))) AS duplicate_group, first(post_id ORDER BY created_at, post_id) AS canonical
FROM nelig JOIN g_comp USING (network_id, text_id) GROUP BY ALL HAVING count(*) >= 2""",
    "rates": """SELECT p.network_id, p.account_id, count(*) AS posts, round(count(*) FILTER (is_dup) / count(*), 4) AS duplication_rate FROM npost p LEFT JOIN dupposts d USING (network_id, post_id) GROUP BY 1, 2""",
    "medge": "SELECT x.network_id, f.* FROM fused f JOIN mem x ON x.claim_id = f.claim_id AND x.account_id = f.a JOIN mem y ON y.network_id = x.network_id AND y.account_id = f.b",
    "words": rf"""SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g') AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{SPACE}+')) AS w FROM documents) x) y
WHERE length(term) > 3 AND term NOT IN ('the', 'a', 'an', 'is', 'are', 'was', 'were', 'this', 'that', 'it', 'in', 'on', 'for', 'of', 'to', 'and', 'with') GROUP BY ALL""",
    "terms": """SELECT network_id, term, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY n DESC, term) AS rank FROM (
 SELECT network_id, term, CAST(sum(c) AS BIGINT) AS n FROM npost JOIN words USING (doc_id) GROUP BY 1, 2) x) y WHERE rank <= 5""",
    "fam": """SELECT claim_id, unnest(['w_time', 'w_text', 'w_amp', 'w_meta', 'w_struct']) AS family, unnest([0.30, 0.25, 0.20, 0.15, 0.10])::DOUBLE AS w,
 unnest([acc >= 70, n >= 100, urls >= 25, true, acc >= 75]) AS available FROM (SELECT claim_id, count(DISTINCT account_id) AS acc, count(*) AS n, count(outbound_url) AS urls FROM scope GROUP BY 1) x""",
}
CTES["win36"] = CTES["win"].format(w="INTERVAL 36 HOUR")
CTES["win480"] = CTES.pop("win").format(w="INTERVAL 480 HOUR")

SQL = {
    "n01_candidate_posts": "SELECT claim_id, account_id, post_id, source FROM cand",
    "n02_select_candidates": "SELECT claim_id, account_id, n_posts, candidates, truncated FROM candidates",
    "n03_total_posts": "SELECT account_id, total_posts FROM totals",
    "n04_account_dimension": """SELECT sha256('unknown|' || account_id) AS account_key, * FROM (SELECT *, false AS is_new FROM v_accounts UNION ALL
 SELECT account_id, account_id, NULL, NULL, NULL, NULL, NULL, true FROM (SELECT DISTINCT CASE WHEN source = 'radio' THEN 'radio-' || author_id ELSE author_id END AS account_id FROM v_posts WHERE author_id IS NOT NULL) x
 WHERE account_id NOT IN (SELECT account_id FROM v_accounts)) y""",
    "n05_w_time": "SELECT claim_id, a, b, score FROM w_time",
    "n06_normalize_text": "SELECT doc_id, md5(norm) AS norm_md5, CAST(length(norm) AS INT) AS norm_length FROM norms",
    "n07_eligible_posts": "SELECT claim_id, account_id, post_id, text_id FROM elig",
    "n08_near_duplicates": """SELECT text_a, text_b, round(jaccard, 6) AS jaccard, x.n AS copies_a, y.n AS copies_b FROM near JOIN (SELECT text_id, count(*) AS n FROM units GROUP BY 1) x ON x.text_id = text_a JOIN (SELECT text_id, count(*) AS n FROM units GROUP BY 1) y ON y.text_id = text_b""",
    "n09_semantic_duplicates": """SELECT ra AS text_a, rb AS text_b, round(sim, 6) AS similarity, x.n AS texts_a, y.n AS texts_b FROM sem JOIN (SELECT rep, count(*) AS n FROM tclass GROUP BY 1) x ON x.rep = ra JOIN (SELECT rep, count(*) AS n FROM tclass GROUP BY 1) y ON y.rep = rb""",
    "n10_w_text": "SELECT claim_id, a, b, score FROM w_text",
    "n11_w_amp": "SELECT claim_id, a, b, score FROM w_amp",
    "n12_handle_similarity": "SELECT claim_id, a, b, round(handle, 6) AS handle FROM meta_parts",
    "n13_creation_proximity": "SELECT claim_id, a, b, round(creation, 6) AS creation FROM meta_parts",
    "n14_image_similarity": "SELECT claim_id, a, b, round(image, 6) AS image FROM meta_parts",
    "n15_bio_similarity": "SELECT claim_id, a, b, round(bio, 6) AS bio FROM meta_parts",
    "n16_w_meta": f"SELECT claim_id, a, b, round({MEAN(*PARTS)}, 4) AS score FROM meta_parts",
    "n17_w_struct": "SELECT claim_id, a, b, score FROM w_struct",
    "n18_pair_key": "SELECT least(account_id, 'u' || CAST(follows AS VARCHAR)) AS a, greatest(account_id, 'u' || CAST(follows AS VARCHAR)) AS b, count(*) AS n FROM v_followers GROUP BY 1, 2",
    "n19_effective_weights": """SELECT claim_id, family, round(w + w / on_sum * (total - on_sum), 6) AS weight FROM (SELECT *, sum(w) FILTER (available) OVER (PARTITION BY claim_id) AS on_sum, sum(w) OVER (PARTITION BY claim_id) AS total FROM fam) x WHERE available""",
    "run_detection_claims": f"""SELECT claim_id, count(*) AS accounts, coalesce(any_value(e.n), 0) AS edges, coalesce(any_value(k.n), 0) AS core_accounts, coalesce(any_value(e.w), 0.0)::DOUBLE AS weight
FROM candidates LEFT JOIN (SELECT claim_id, count(*) AS n, round(sum(w_total), 6) AS w FROM fused GROUP BY 1) e USING (claim_id)
LEFT JOIN (SELECT claim_id, count(DISTINCT u) AS n FROM (SELECT claim_id, a AS u FROM core_{CORE_ROUNDS} UNION ALL SELECT claim_id, b FROM core_{CORE_ROUNDS}) x GROUP BY 1) k USING (claim_id) GROUP BY claim_id""",
    "n20_fuse_edges": f"SELECT claim_id, a, b, w_total, {', '.join(FAMILIES)}, signal_count FROM fused",
    "x01_k_core": f"SELECT claim_id, a, b, w_total AS w FROM core_{CORE_ROUNDS} WHERE (SELECT count(*) FROM core_{CORE_ROUNDS - 1}) = (SELECT count(*) FROM core_{CORE_ROUNDS})",
    "x02_connected_components": "SELECT claim_id, u AS node, min(w) AS component FROM e_walk GROUP BY ALL",
    "x04_retain": "SELECT claim_id, community, members, edges, density FROM shape WHERE members >= 4 AND density >= 0.30",
    "x05_conductance": "SELECT claim_id, community, conductance FROM shape",
    "n21_relevance_gate": "SELECT network_id, members, claim_posts, anchoring_share, overlap_ratio, failed_test, failed_test IS NULL AS passed FROM gate",
    "n22_offtopic_clusters": "SELECT network_id, members AS account_count, claim_posts AS post_count, anchoring_share, overlap_ratio, failed_test, sy, du, co, pr, au, coordination_score FROM gate JOIN met USING (network_id) WHERE failed_test IS NOT NULL",
    "m01_synchrony": "SELECT network_id, posts_in_burst, total_posts, round(sy, 4) AS sy FROM sy",
    "m02_duplication": "SELECT network_id, duplicated_posts, total_posts, round(du, 4) AS du FROM du",
    "m03_cohesion": "SELECT network_id, round(100 * (1 - conductance), 4) AS co FROM shape",
    "m04_tightest_window": "SELECT network_id, in_window, known, CASE WHEN known >= 2 THEN round(in_window / known, 6) END AS window_share FROM win480",
    "m05_template_and_image_share": "SELECT network_id, round(template_share, 6) AS template_share, round(image_share, 6) AS image_share FROM tpl",
    "m06_age_percentile_inverted": "SELECT network_id, round(age_inverted, 6) AS age_inverted FROM ageinv",
    "m07_provenance_anomaly": "SELECT network_id, in_window, known, round(pr, 4) AS pr FROM pr",
    "m08_interpost_regularity": "SELECT network_id, account_id, round(regularity, 6) AS regularity FROM reg",
    "m09_activity_parts": "SELECT network_id, account_id, round(circadian, 6) AS circadian, round(rate, 6) AS rate, round(reshare_ratio, 6) AS reshare_ratio FROM acts",
    "m10_automation": "SELECT network_id, round(au, 4) AS au, active_hours FROM au",
    "m11_coordination_score": "SELECT network_id, sy, du, co, pr, au, coordination_score, posts_in_burst, total_posts, duplicated_posts, in_window, known, active_hours FROM met",
    "m12_signal_breadth": "SELECT network_id, signal_breadth FROM breadth",
    "m13_confidence_band": """SELECT network_id, CASE WHEN coordination_score >= 45 AND signal_breadth >= 2 THEN CASE WHEN total_posts >= 12 THEN 'medium' ELSE 'high' END WHEN coordination_score >= 35 AND signal_breadth >= 1 THEN 'medium' ELSE 'low' END AS confidence_band FROM breadth""",
    "m14_allowlist_suppressed": """SELECT network_id, count(*) FILTER (account_id IN (SELECT 'u' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))) / count(*) >= 0.6 AS suppressed FROM mem GROUP BY 1""",
    "v01_burst_timeline": "SELECT network_id, bin_start, post_count, zscore, is_anomalous FROM bursts",
    "v02_duplicate_groups": """SELECT p.network_id, p.post_id, p.account_id, p.created_at, sha256(d.text) AS content_sha256, g.duplicate_group, coalesce(p.post_id = g.canonical, false) AS is_canonical
FROM npost p JOIN documents d USING (doc_id) LEFT JOIN nelig e ON e.network_id = p.network_id AND e.post_id = p.post_id LEFT JOIN g_comp c ON c.network_id = e.network_id AND c.text_id = e.text_id LEFT JOIN g_group g ON g.network_id = c.network_id AND g.comp = c.comp""",
    "v03_duplication_rate": "SELECT network_id, account_id, posts, duplication_rate FROM rates",
    "v04_account_annex": """SELECT m.network_id, m.account_id, coalesce(a.handle, '') AS handle, r.posts AS posts_in_cluster, duplication_rate, round(g.med, 3) AS median_gap, round(h.c / 24, 4) AS circadian_coverage,
 round(coalesce(d.deg, 0) / greatest(s.n - 1, 1), 4) AS degree_centrality
FROM mem m JOIN rates r USING (network_id, account_id) LEFT JOIN v_accounts a USING (account_id) LEFT JOIN (SELECT network_id, account_id, median(gap) AS med FROM ngaps GROUP BY 1, 2) g USING (network_id, account_id)
JOIN (SELECT network_id, account_id, count(DISTINCT hour(created_at)) AS c FROM npost GROUP BY 1, 2) h USING (network_id, account_id) JOIN (SELECT network_id, count(*) AS n FROM mem GROUP BY 1) s USING (network_id)
LEFT JOIN (SELECT network_id, u AS account_id, count(*) AS deg FROM (SELECT network_id, a AS u FROM medge UNION ALL SELECT network_id, b FROM medge) z GROUP BY 1, 2) d USING (network_id, account_id)""",
    "v06_edge_snapshot": f"SELECT network_id, a AS account_a, b AS account_b, w_total, {', '.join(FAMILIES)}, signal_count FROM medge",
    "v07_network_table": """SELECT network_id, claim_id, account_count, post_count, platforms FROM (SELECT network_id, claim_id, count(*) AS account_count FROM mem GROUP BY 1, 2) m
JOIN (SELECT network_id, count(*) AS post_count, string_agg(DISTINCT source, ',' ORDER BY source) AS platforms FROM npost GROUP BY 1) p USING (network_id)""",
    "v08_snapshot_digest": f"""SELECT network_id, sha256(string_agg(h, '|' ORDER BY h)) AS snapshot_sha256, count(*) AS evidence_post_count, {AS_OF} + INTERVAL 720 DAY AS expires_at FROM (SELECT network_id, sha256(text) AS h FROM npost JOIN documents USING (doc_id)) x GROUP BY 1""",
    "v09_top_terms": "SELECT network_id, term, n, rank FROM terms",
    "v10_fingerprint": """SELECT network_id, sha256(m || '::' || coalesce(t, '')) AS fingerprint FROM (SELECT network_id, string_agg(account_id, '|' ORDER BY account_id) AS m FROM mem GROUP BY 1) x LEFT JOIN (SELECT network_id, string_agg(term, '|' ORDER BY term) AS t FROM terms GROUP BY 1) y USING (network_id)""",
    "v11_recurrence_parent": """SELECT network_id, parent AS parent_network_id, round(j, 4) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY round(j, 9) DESC, pseq) AS r FROM (
 SELECT n.network_id, p.network_id AS parent, any_value(p.claim_id * 100 + p.community_id) AS pseq, count(*) / (any_value(sn.c) + any_value(sp.c) - count(*)) AS j
 FROM mem n JOIN mem p ON n.account_id = p.account_id AND p.claim_id * 100 + p.community_id < n.claim_id * 100 + n.community_id
 JOIN (SELECT network_id, count(*) AS c FROM mem GROUP BY 1) sn ON sn.network_id = n.network_id JOIN (SELECT network_id, count(*) AS c FROM mem GROUP BY 1) sp ON sp.network_id = p.network_id GROUP BY 1, 2) x WHERE j >= 0.5) y WHERE r = 1""",
    "v12_comparison_accounts": """WITH big AS (SELECT network_id, claim_id, count(*) AS cap FROM mem GROUP BY ALL HAVING count(*) >= 4),
free AS (SELECT c.claim_id, c.account_id, coalesce(t.total_posts, 0) AS total_posts FROM candidates c LEFT JOIN totals t USING (account_id) WHERE (c.claim_id, c.account_id) NOT IN (SELECT (m.claim_id, m.account_id) FROM mem m JOIN big USING (network_id))),
rk AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY total_posts DESC, account_id) AS rank FROM free)
SELECT network_id, account_id, total_posts, CAST(rank AS INT) AS rank FROM big JOIN rk USING (claim_id) WHERE rank <= cap""",
    "v13_run_summary": """SELECT topic_id AS run_id, count(*) AS claims, CAST(coalesce(sum(n), 0) AS BIGINT) AS candidates, false AS truncated, coalesce((SELECT string_agg(DISTINCT family, ',' ORDER BY family) FROM fam JOIN v_claims x USING (claim_id) WHERE NOT available AND x.topic_id = c.topic_id), '') AS missing_families, 'completed' AS status
FROM v_claims c LEFT JOIN (SELECT claim_id, count(*) AS n FROM candidates GROUP BY 1) k USING (claim_id) WHERE claim_type = 'existing' GROUP BY c.topic_id""",
    "v14_purge_evidence": "SELECT network_id, bin_start, post_count, zscore, is_anomalous FROM bursts WHERE network_id IN (SELECT network_id FROM mem GROUP BY 1 HAVING count(*) >= 3)",
    "v14_purge_counts": "WITH named AS (SELECT network_id FROM mem GROUP BY 1 HAVING count(*) < 3)\n" + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) FILTER (network_id IN (FROM named)) AS purged, count(*) FILTER (network_id NOT IN (FROM named)) AS kept FROM {table}"
        for name, table in {"posts": "npost", "bursts": "bursts", "edges": "medge", "accounts": "mem", "terms": "terms"}.items()),
    "s14_write_and_delete": """SELECT claim_id, CASE WHEN CAST(recorded_at AS DATE) IN (SELECT CAST(added_at AS DATE) FROM v_alerts) THEN 0.0 ELSE final_score END AS final_score, recorded_at FROM v_snapshots WHERE claim_id NOT IN (SELECT claim_id FROM v_alerts)""",
    "s14_committed_table": """SELECT claim_id, CASE WHEN CAST(recorded_at AS DATE) IN (SELECT CAST(added_at AS DATE) FROM v_alerts) THEN 0.0 ELSE final_score END AS final_score, recorded_at FROM v_snapshots WHERE claim_id NOT IN (SELECT claim_id FROM v_alerts)""",
    "t01_stream_ingest": """SELECT p.post_id, p.external_ref, p.created_at, coalesce(p.claim_id, b.claim_id) AS claim_id FROM v_posts p LEFT JOIN open_best b ON b.vec_id = p.vec_id AND p.claim_id IS NULL
WHERE p.external_ref IS NULL OR p.post_id = (SELECT min(post_id) FROM v_posts q WHERE q.external_ref = p.external_ref)""",
    "t02_stream_topic_volume": "SELECT topic_id, bucket_start::TIMESTAMP AS bucket_start, supporting_volume FROM tvol",
    "t03_stream_pushback": """SELECT claim_id, window_end, count(*) FILTER (stance = 'supporting') AS supporting, count(*) FILTER (stance = 'opposing') AS opposing FROM (
 SELECT claim_id, stance, date_trunc('hour', created_at) + to_hours(CAST(unnest(range(1, 25)) AS INT)) AS window_end FROM v_posts WHERE claim_id IS NOT NULL AND stance IN ('supporting', 'opposing')) x GROUP BY ALL""",
    "t04_stream_bursts": """SELECT claim_id, bin_start, post_count, CASE WHEN sd > 0 THEN round((post_count - m) / sd, 4) ELSE 0.0 END AS zscore, post_count > m + 3 * sd AS is_anomalous FROM (
 SELECT *, avg(post_count) OVER w AS m, stddev_pop(post_count) OVER w AS sd FROM (SELECT claim_id, date_trunc('minute', created_at)::TIMESTAMP AS bin_start, count(*) AS post_count FROM v_posts WHERE claim_id IS NOT NULL AND stance = 'supporting' GROUP BY ALL) x WINDOW w AS (PARTITION BY claim_id)) y""",
}
