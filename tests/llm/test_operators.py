import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import bytes_dedup, decontaminate, exact_dedup, licenses, mixing, passages, pii, simhash, toxicity, urls


def with_nulls(docs):
    """A null id and a row given twice."""
    more = docs.filter("doc_id = 5")
    return docs.unionByName(more).unionByName(more.withColumn("doc_id", F.lit(None).cast("bigint")))


def test_passages_match_brute_force(docs, rows, empty):
    got = {r.doc_id: r for r in passages.without_repeats(docs).withColumn("sha", F.sha2("kept_text", 256)).collect()}
    assert {d: (r.n_words, r.n_removed, r.sha) for d, r in got.items()} == brute.passages(rows)
    assert sum(r.n_removed for r in got.values()) > 0
    assert passages.without_repeats(empty).count() == 0
    assert passages.without_repeats(with_nulls(docs)).count() == len(rows) + 2


def test_hot_minimisers_change_nothing(docs):
    hot = passages.hot_minimisers(docs, least=0)
    spans = lambda h: sorted((r.k, p) for r in passages.bucket_repeats(passages.super_kmers(docs, hot=h)).collect() for p in range(r.start, r.start + r.n))
    assert len(hot) and spans(hot) == spans(None)


@pytest.mark.parametrize("hot", [5000, 1])
def test_bytes_match_brute_force(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(bytes_dedup.repeated_windows, "__defaults__", (400, 200, hot))
    out = bytes_dedup.without_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out} == brute.byte_runs(rows)
    assert bytes_dedup.without_repeats(empty).count() == 0


def test_column_insertion_finds_equal_windows():
    rng = random.Random(1)
    gram = b"g" * 20
    texts = [bytes(rng.choice(b"ab") for _ in range(8)) + gram + bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(60)]
    s, c = bytes_dedup.column_insert(np.zeros(60, np.int64), texts, np.full(60, 8), 26, 20)
    window = lambda i, l: texts[i][8 - l: 34 - l]
    want = {(i, l) for l in range(0, 7) for i in range(60) if any(j != i and window(i, l) == window(j, l) for j in range(60)) and len(window(i, l)) == 26}
    assert set(zip(s.tolist(), c.tolist())) == want


def test_simhash_matches_brute_force(docs, rows, empty):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == brute.simhash_groups(rows)
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(with_nulls(docs))
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in got.values()})


def test_grid_loses_no_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(4)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & mask).bit_count() <= 4}

    def groups(pairs):
        root = {f: f for f in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {f: find(f) for f in signed}

    for block in (4096, 4):  # the second cuts every cell into blocks
        got = {(r.a, r.b) for r in simhash.links(frame, 4, block).collect()}
        assert got <= want and groups(got) == groups(want)


def test_exact_groups(docs, rows, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    norm = {d: "".join((t or "").split()) if (t or "").isascii() else (t or "").replace(" ", "") for d, t in rows}
    for d, t in rows:
        group = [x for x, _ in rows if norm[x] == norm[d]]
        keep = min(group, key=lambda x: (-len(dict(rows)[x] or ""), x))
        assert (got[d].keep_id, got[d].group_size, got[d].kept) == (keep, len(group), keep == d)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.keep_one(with_nulls(docs))
    assert kept.columns == docs.columns and kept.count() == len(set(norm.values()))


def test_base_spans():
    t = "x a.b@c.d.example, y@z call +1 (555) 555-0100 or 10.2.3.4 or 999.1.1.1 or 4111 1111 1111 1111 or 4111 1111 1111 1112 ü q@r.st"
    found = [("email", "a.b@c.d.example"), ("email", "q@r.st"), ("ip", "10.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 555-0100")]
    assert [(k, t[a:b]) for k, a, b in pii.base_spans(t)] == found


def test_long_secrets_are_taken_whole():
    key = "eyJ" + "aB3." * 100
    assert [m.group(1) for m in pii.SECRET.finditer(f"token = '{key}', more")] == [key]


def test_proposals_of_long_texts_take_linear_time():
    import time

    text = "".join(f"write to bob{i} at mail{i % 7} dot example dot com or 0{i % 10}0-555-{i:07}, 10.0.0.{i % 256} " for i in range(12_000))
    took = []
    for n in (len(text) // 4, len(text)):
        t0 = time.perf_counter()
        part = text[:n]
        base = pii.base_spans(part)
        found = pii.proposals(part, base)
        took.append(time.perf_counter() - t0)
    assert len(found) > 5_000 and took[1] < 10 * took[0] + 0.5
    spans = sorted((a, b) for _, a, b in found + base)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_labelers_agree_more_on_what_they_agree_on():
    counts = [("secret", (0, 1, 2, 1, 1), 31, 90), ("secret", (0, 0, 2, 2, 0), 31, 60), ("secret", (0, 0, 2, 1, 1), 7, 10)]
    p = pii.estimate(counts)
    assert p[0] > 0.9 > p[1]
    model = pii.fit(counts)
    assert model.personal("secret", (0, 1, 2, 1, 1), 31) > 0 > model.personal("secret", (0, 0, 2, 2, 0), 31)


def test_pii_rows(docs, rows, empty):
    model = pii.train(docs)
    assert pii.find_spans(docs, model).count() == len(rows)
    assert pii.find_spans(empty, pii.train(empty)).count() == 0


def test_toxicity_learns_planted_words(spark, empty):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(80)]
    data, marks = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vile", "nasty"])
        data.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    frame, labels = spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    out = [(r.held_out, r.predicted, r.toxic) for r in toxicity.scores(frame, model).join(labels, "doc_id").collect()]
    held = [(p, t) for h, p, t in out if h]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    assert toxicity.scores(empty, model).count() == 0
    assert toxicity.train(empty, labels.limit(0)).words.size == 0
    # a model that is joined instead of sent scores alike
    joined = toxicity.train(frame, labels, sent=0)
    assert joined.table is not None and joined.words.size == 0 and model.words.size > 0
    score = lambda m: {r.doc_id: r.score for r in toxicity.scores(frame, m).collect()}
    a, b = score(model), score(joined)
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-9 for d in a)
    assert toxicity.keep_clean(frame.unionByName(frame.filter("doc_id < 3")), joined).columns == frame.columns
    assert toxicity.scores(empty, joined).count() == 0


def test_contexts_are_counted_in_full(spark):
    rng = random.Random(6)
    rows = [(" ".join(rng.choice(["c d", f"x{rng.randrange(300)}"]) for _ in range(60)), i % 2) for i in range(60)]
    want = {}
    for text, toxic in rows:
        w = text.split()
        for i in range(1, len(w)):
            if (w[i - 1], w[i]) == ("c", "d"):
                want.setdefault(toxic, set()).add(w[i - 2] if i > 1 else None)
    counts = toxicity.class_counts(spark.createDataFrame(rows, "text string, toxic int"))
    key = int(toxicity._grams([b"c d"])[3][1].astype(np.int64))
    got = counts.filter((F.col("kind") == 2) & (F.col("key") == key)).first()
    assert (got.nt, got.no) == (len(want[1]), len(want[0])) and min(got.nt, got.no) > 100


def test_leaks(spark, docs, empty):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(["the", "of", *[f"q{j}" for j in range(300)]]) for _ in range(30))) for i in range(100)] + [(100, None), (101, "")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    hay = [(i, " ".join(f"h{rng.randrange(500)}" for _ in range(100)) + (" " + items[i][1].upper() if i % 3 == 0 else "") + " end of text") for i in range(30)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(hay, "doc_id bigint, text string"), table).collect()}
    assert got == {(i, i) for i in range(30) if i % 3 == 0}
    assert decontaminate.leaks(docs, table).count() == 0 and decontaminate.leaks(empty, table).count() == 0
    assert decontaminate.keep_unleaked(docs, table.limit(0)).count() == docs.count()


def test_mixing_meets_marginals(spark, empty):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 3 == 0], "xyz"[i % 5 % 3]) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = mixing.weigh(frame).toPandas()
    assert len(out) == 300 and out.probability.between(0, 1).all()
    total = out.tokens.sum()
    for m, power in (("source", 0.5), ("lang", 0.7)):
        want = out.groupby(m).tokens.sum() ** power
        want = want / want.sum() * total
        assert (abs(out.groupby(m).mass.sum() - want) < 0.01 * want + 0.5).all()
    assert mixing.weigh(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s")], frame.schema)
    assert [r.tokens for r in mixing.weigh(odd).collect()] == [1, 1, 1]


def test_mixing_settles_on_correlated_cells(spark):
    rng = random.Random(8)
    cells = [(s, l, t, 200 if i % 3 == j else rng.randrange(20, 60)) for i, s in enumerate("abcd") for j, l in enumerate("xyz") for t in ("prose", "web") if rng.random() < 0.75]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    out = mixing.rake(frame, mixing.Mix()).toPandas()
    for m in mixing.MARGINALS:
        want = out.groupby(m).tokens.sum() ** getattr(mixing.Mix(), m)
        want = want / want.sum() * out.tokens.sum()
        assert (abs(out.groupby(m).mass.sum() / want - 1) < 1e-8).all(), m
    assert abs((out.tokens * out.probability).sum() / out.tokens.sum() - 0.5) < 1e-9
    # each source in one language: no masses meet both targets
    frame = spark.createDataFrame([("a", "x", "prose", 1), ("b", "y", "prose", 2)], frame.schema)
    with pytest.warns(UserWarning, match="largest relative miss"):
        assert mixing.rake(frame, mixing.Mix()).count() == 2


def test_licences(docs, empty):
    got = {(r.doc_id, r.unit, r.license_id) for r in licenses.scan(docs).collect()}
    assert got == {(14, "document", "Apache-2.0"), (14, "paragraph", "Apache-2.0"), (14, "line", "Apache-2.0")}
    assert licenses.scan(empty).count() == 0


def test_licence_blocks_own_lists_and_spellings(spark):
    header = next(t for i, t in licenses.KNOWN if i == "Apache-2.0" and len(t) > 200)
    words, lines = header.split(), []
    while words:
        lines.append(" * " + " ".join(words[:9]))
        words = words[9:]
    code = "/*\n * Copyright 2020 Some One\n *\n" + "\n".join(lines) + "\n */\nint main() { return 0; }\n"
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 200).removeprefix("MIT License ")
    rows = [(1, code), (2, "Read me.\n\nMIT LICENCE\n" + mit.replace(". ", ".\n") + "\n\nThe end."), (None, "Licensed under the MIT License."), (None, "Licensed under the MIT License."), (3, None), (4, "dedicated to all")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.unit, r.license_id, r.n) for r in licenses.scan(frame).collect()}
    assert got == {(1, "comment", "Apache-2.0", 1), (2, "paragraph", "MIT", 1), *((None, u, "MIT", 2) for u in ("document", "paragraph", "line"))}
    own = licenses.digests(spark, (("PD", "Dedicated to all"), ("L", "license license")))
    more = frame.unionByName(spark.createDataFrame([(5, "licence licence")], frame.schema))
    assert {(r.doc_id, r.license_id) for r in licenses.scan(more, own).collect()} == {(4, "PD"), (5, "L")}


def test_urls(spark):
    pages = [(1, "http://a.example.net/en/1", ""), (2, "http://b.net/x", ""), (3, None, None), (4, "no scheme", ""), (5, "https://Blog.Example.com/de/z?q#f", ""),
             (6, "http://spam.info/", '<a href="http://b.net/x">'), (7, "http://good.info/", ""), (8, "http://a.example.net/en/2", '<a href="http://good.info/">')]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in out.items()} == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("b.net", "/x", "net/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("blog.example.com", "/de/z", "example.com/de/", "block"), 6: ("spam.info", "/", None, "block"), 7: ("good.info", "/", None, "allow"),
        8: ("a.example.net", "/en/2", "example.net/en/", "allow")}
    assert out[7].trust > 0 and out[6].distrust > 0


def test_rank_of_dead_ends_goes_back_each_round(spark):
    edges = [("s", f"d{i}") for i in range(6)] + [("t", "d0"), ("t", "d7")]
    hosts = sorted({h for e in edges for h in e})
    seed = np.array([0.5 if h in "st" else 0.0 for h in hosts])
    rank = seed
    for _ in range(300):
        got = np.zeros(len(hosts))
        for a, b in edges:
            got[hosts.index(b)] += rank[hosts.index(a)] / sum(x == a for x, _ in edges)
        rank = (1 - 0.3 * got.sum()) * seed + 0.3 * got
    out = urls.pagerank(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("s", 0.5), ("t", 0.5)], "host string, seed double"), 0.3, 1000, "rank")
    out = {r.host: r["rank"] for r in out.collect()}
    assert np.allclose([out[h] for h in hosts], rank, atol=1e-9)
    assert abs(sum(out.values()) - 1) < 1e-9
    with pytest.raises(RuntimeError, match="settled"):
        urls.pagerank(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("s", 1.0)], "host string, seed double"), 0.3, 1, "rank")


def test_ratios_match_brute_force(spark):
    """Every word and bigram of 60 texts against Kneser-Ney sums over plain dictionaries."""
    import math
    from collections import defaultdict

    import numpy as np

    rng = random.Random(8)
    texts = [(" ".join(rng.choice([f"a{min(rng.randrange(40), rng.randrange(40))}", f"b{rng.randrange(300)}"]) for _ in range(rng.randrange(50))), i % 3 == 0) for i in range(60)]
    before, lefts = defaultdict(set), defaultdict(set)  # of (side, word) and of (side, first word, word)
    for text, toxic in texts:
        w = text.split()
        for i, x in enumerate(w):
            h, far = w[i - 1] if i else None, w[i - 2] if i > 1 else None
            for side in ("nt" if toxic else "no", "ns"):
                before[side, x].add(h)
                lefts[side, h, x].add(far)
    n1, n2 = ({k: len(v) for k, v in d.items()} for d in (before, lefts))

    def off(counts):
        have = [sum(1 for c in counts if c == i) for i in (1, 2, 3, 4)]
        return toxicity.discounts(*have)

    d1 = {s: off([c for (side, _), c in n1.items() if side == s]) for s in ("nt", "no", "ns")}
    d2 = {s: off([c for (side, *_), c in n2.items() if side == s]) for s in ("nt", "no", "ns")}
    cut = lambda c, d: (c - d[min(c, 3) - 1]) if c else 0.0
    all1 = {s: [c for (side, _), c in n1.items() if side == s] for s in d1}
    vocabulary = {w for _, w in n1}

    def word(s, w, low):
        free = sum(d1[s][min(c, 3) - 1] for c in all1[s]) / sum(all1[s])
        return max(cut(n1.get((s, w), 0), d1[s]), 0) / sum(all1[s]) + free * low

    shared = {w: word("ns", w, 1 / (len(vocabulary) + 1)) for w in vocabulary}

    def bigram(s, h, w, low):
        row = [c for (side, a, _), c in n2.items() if side == s and a == h]
        return (max(cut(n2.get((s, h, w), 0), d2[s]), 0) + sum(d2[s][min(c, 3) - 1] for c in row) * low) / sum(row) if row else low

    h32 = {x: int(toxicity._grams([x.encode()])[2][0]) for x in vocabulary} | {None: 0}
    want = {}
    for w in vocabulary:
        want[1, h32[w]] = math.log(word("nt", w, shared[w]) / word("no", w, shared[w]))
    for _, h, w in n2:
        both = bigram("ns", h, w, shared[w])
        p = [bigram(s, h, w, both * word(s, w, shared[w]) / shared[w]) for s in ("nt", "no")]
        want[2, h32[w] << 32 | h32[h]] = math.log(p[0] / p[1])
    frame = spark.createDataFrame([(t, int(x)) for t, x in texts], "text string, toxic int")
    table, unknown = toxicity.ratio_table(toxicity.class_counts(frame))
    got = {(r.kind, int(np.uint64(r.key % 2**64))): r.one if r.kind == 1 else r.two for r in table.collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len({round(v, 6) for v in got.values()}) > 100 and math.isfinite(unknown)


def test_toxicity_edges(spark, docs, empty):
    """Null and empty texts, null ids, repeated rows, ids labelled twice, no labels, one class only."""
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 16)] + [(4, 1), (None, 1)], "doc_id bigint, toxic int")
    for labels in (marks, marks.limit(0), marks.filter("toxic = 0")):
        model = toxicity.train(with_nulls(docs), labels)
        out = toxicity.scores(with_nulls(docs), model).collect()
        assert len(out) == docs.count() + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1 == len({r.score for r in out if r.doc_id in (5, None)})
    assert toxicity.labelled(docs, marks, (0, 1, 2, 3)).filter("toxic = 1").count() == 9
