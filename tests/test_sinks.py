"""Tables with commit records: a batch shows whole, once, or not at all."""

import pytest

from claimlens.sources.sinks import CommittedTable

SCHEMA = "id bigint, day string, v string"


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable(spark, str(tmp_path / "t"), SCHEMA, "day")


def rows(table):
    return sorted((r.id, r.day, r.v) for r in table.read().collect())


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_batches_count_once_and_unfinished_ones_never(spark, table):
    assert rows(table) == []
    table.append(frame(spark, (1, "mon", "a"), (2, "tue", "a")), "b1")
    table.write_files(frame(spark, (3, "mon", "lost")))  # killed before its record
    assert rows(table) == [(1, "mon", "a"), (2, "tue", "a")]
    table.append(frame(spark, (3, "mon", "b")), "b2")
    table.append(frame(spark, (3, "mon", "b")), "b2")  # delivered again
    assert rows(table) == [(1, "mon", "a"), (2, "tue", "a"), (3, "mon", "b")]
    table.append(frame(spark, (2, "wed", "c")), "b1")  # run again with other rows: the first ones go
    assert rows(table) == [(2, "wed", "c"), (3, "mon", "b")]


def test_replacement_shows_all_partitions_at_once(spark, table):
    table.append(frame(spark, (1, "a b", "x"), (2, "tue", "x"), (3, "wed", "x")), "b1")
    folder = table.write_files(frame(spark, (9, "a b", "y"), (8, "tue", "y")))
    assert [r[2] for r in rows(table)] == ["x", "x", "x"]
    table.commit(folder, "b2", True)
    assert rows(table) == [(3, "wed", "x"), (8, "tue", "y"), (9, "a b", "y")]
    table.append(frame(spark, (10, "tue", "z"), (11, None, "é:%/ +")), "b3")
    table.append(frame(spark), "b4")
    assert rows(table)[-1] == (11, None, "é:%/ +")
    table.replace(frame(spark, (12, None, "w")), "b5")
    table.append(frame(spark), "b1")  # run again, now without rows
    assert rows(table) == [(8, "tue", "y"), (9, "a b", "y"), (10, "tue", "z"), (12, None, "w")]
