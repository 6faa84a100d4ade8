"""Plans stay short: wide steps are written part by part."""

from pyspark.sql import functions as F

from claimlens.operators import fusion
from claimlens.operators import metrics as M


def grouped(spark, rows, schema, *keys):
    df = spark.createDataFrame(rows, schema)
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys])


def test_coordination_score_reads_written_parts(spark):
    part = lambda schema, *row: grouped(spark, [row], "network_id string, " + schema, "network_id")
    scores = M.coordination_score(
        part("sy double, posts_in_burst bigint, total_posts bigint", "n", 80.0, 2, 4), part("du double, duplicated_posts bigint", "n", 60.0, 3),
        part("co double", "n", 50.0), part("pr double, in_window bigint, known bigint", "n", 40.0, 1, 2), part("au double, active_hours bigint", "n", 20.0, 5))
    assert "Aggregate" not in scores._jdf.queryExecution().optimizedPlan().toString()
    assert [r.coordination_score for r in scores.collect()] == [54.0]


def test_strong_edges_reads_written_families(spark):
    class Family:
        def __init__(self, name):
            self.name, self.rows = name, grouped(spark, [(1, "a", "b", 0.9), (1, "a", "c", 0.1)], "claim_id bigint, a string, b string, score double", "claim_id", "a", "b")

        def strong(self, s, report=None):
            return self.rows.filter(F.col("score") >= s)

        def of(self, pairs):
            return self.rows

    meta = lambda pairs: pairs.withColumn("score", F.lit(0.5))
    edges = fusion.strong_edges([Family("w_time"), Family("w_text")], meta)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert [(r.a, r.b) for r in edges.collect()] == [("a", "b")]
