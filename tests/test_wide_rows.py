"""Claim statements are not shuffled with links; words of texts are split and hashed once."""

from claimlens.operators import boards as B
from claimlens.operators import labels as L


def test_policy_detail_shuffles_no_statement(spark, monkeypatch):
    wrote = []
    plain = B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, name: (wrote.append(name), plain(df, name))[1])
    policies = spark.createDataFrame([(p, f"t{p}") for p in range(6)], "policy_id long, title string")
    claims = spark.createDataFrame(
        [(1, "existing", "one", "active", None), (2, "non_existing", "two", "active", 4), (3, "existing", "three", "new", 5), (4, "non_existing", "four", "new", 99)],
        "claim_id long, claim_type string, claim_statement string, status string, policy_id long")
    links = spark.createDataFrame([(c, p) for c in (1, 2, 3, 9) for p in (0, 1, 7)], "claim_id long, policy_id long")
    out = B.policy_detail(policies, claims, links)
    got = sorted((r.policy_id, r.claim_id, r.claim_statement, r.status, r.kind, r.title) for r in out.collect())
    said = {1: ("one", "active"), 3: ("three", "new")}
    want = [(p, c, *said[c], "linked", f"t{p}") for c in said for p in (0, 1)] + [(4, 2, "two", "active", "predicted", "t4"), (5, 3, "three", "new", "predicted", "t5")]
    assert got == sorted(want)
    assert wrote == ["titles", "claims"]  # the sizes are known before the joins


def test_words_are_counted_once(spark, monkeypatch):
    wrote = []
    plain = L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: (wrote.append(name), plain(df, name))[1])
    out = L.term_weights(spark.createDataFrame([(1, "a b b"), (2, "c"), (3, "")], "id int, text string"), "id", 16)
    assert wrote == ["term-counts"] and "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id for r in out.collect()} == {1, 2}
