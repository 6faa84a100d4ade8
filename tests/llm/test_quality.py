import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from claimlens.llm import quality


def twin(frame):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in frame.select("doc_id", "text", "lang", "source").collect()],
                 schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])))
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    return sorted(con.sql(f"SELECT {names} FROM ({quality.SQL})").fetchall(), key=repr)


def plain(text, k=5):
    w = text.encode().split()
    grams = [tuple(w[i: i + k]) for i in range(len(w) - k + 1)]
    return len({i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(k)})


def test_rows_match_their_twin(spark, docs, empty):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "and", "blä", "Stone", "😀", *[f"w{i}" for i in range(40)]])
    made = []
    for i in range(160):
        words = [word() for _ in range(rng.randrange(8, 60))]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        if i % 20 == 1:
            words = [w for w in words for _ in range(3)]
        if i % 20 == 2:
            words = words + words[:6] + ["x"] + words[:6]
        sep = rng.choice([" ", "\n", "\x0b ", " "])
        made.append((100 + i, sep.join(words), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", None]), 0, 1, "x", "y", "z"))
    frame = docs.unionByName(spark.createDataFrame(made, docs.schema)).unionByName(docs.filter("doc_id = 5")).unionByName(docs.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint")))
    out = quality.judge(frame)
    got = out.collect()
    assert sorted((tuple(r) for r in got), key=repr) == twin(frame)
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    for r in got:
        if len(texts[r.doc_id]) < 5000:
            assert r.n_repeat_words == plain(texts[r.doc_id]), r.doc_id
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert not any(verdict[100 + i][1] for i in range(0, 160, 20)) and (False, False) in verdict.values()  # symbols
    assert sum(k for _, k in verdict.values()) > 100
    assert quality.judge(empty).count() == 0


def test_sketches_merge_to_the_sketch_of_the_whole(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([("1en", f"1{'ab'[i % 2]}", False, *[int(rng.expovariate(0.001)) for _ in range(6)]) for i in range(4000)],
                                 "l string, s string, base_failed boolean, " + ", ".join(f"r_{k} bigint" for k in quality.Rules().slack))
    rules = quality.Rules()
    parts = quality.sketches(rows.filter("s = '1a'"), rules).unionByName(quality.sketches(rows.filter("s = '1b'"), rules))
    both = quality.quartiles(quality.merged(parts, "l"), "l").collect()
    for r in both:
        values = sorted(x[0] for x in rows.select(f"r_{r.rule}").collect())
        for q, found in ((0.25, r.low), (0.75, r.high)):
            true = values[int(q * len(values)) - 1]
            assert found <= true <= found * 1.01 + 1
    assert {r.rows for r in both} == {4000}


def test_plan_has_no_python(docs):
    plan = quality.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
