"""The state of refs has a key a bucket, so calls of Python do not grow with the refs."""

from claimlens.streaming import streams as ST
from test_streams import files, post


def test_refs_share_bucket_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "REF_BUCKETS", 3)
    batches = [[post(100 * b + i, i, ref=f"r{(i + 10 * b) % 40}") for i in range(30)] for b in range(3)]
    kept = []
    query = ST.start(ST.first_refs(files(spark, tmp_path, *batches)), lambda batch, n: kept.extend(r.post_id for r in batch.collect()), "append", str(tmp_path / "state"))
    query.awaitTermination()
    seen, want = set(), []
    for batch in batches:
        fresh = {}
        for r in batch:
            if r[5] not in seen:
                fresh[r[5]] = min(fresh.get(r[5], r[0]), r[0])
        want += fresh.values()
        seen |= set(fresh)
    assert sorted(kept) == sorted(want)
    assert 0 < max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) <= 3
