"""Tables that are upserted and merged on read."""

import pytest

from logloom.sources import store


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def rows(spark, schema, *r):
    return spark.createDataFrame(list(r), schema)


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_upsert_keeps_columns_and_moves_keys(spark, path):
    store.upsert(rows(spark, "log_id string, n int, extra string, dataset_id string", ("a", 1, "e", "x"), ("b", 1, "f", "x"), ("c", 1, "g", "y")), path, "log_id")
    store.upsert(rows(spark, "log_id string, n int, dataset_id string", ("b", 2, "x")), path, "log_id")
    read = lambda: plain(spark.read.option("mergeSchema", True).parquet(path), "log_id", "n", "extra", "dataset_id")
    assert read() == [("a", 1, "e", "x"), ("b", 2, None, "x"), ("c", 1, "g", "y")]
    store.upsert(rows(spark, "log_id string, n int, dataset_id string, more int", ("c", 3, "x", 7)), path, "log_id")
    assert read() == [("a", 1, "e", "x"), ("b", 2, None, "x"), ("c", 3, None, "x")]
    assert plain(spark.read.option("mergeSchema", True).parquet(path), "log_id", "more")[-1] == ("c", 7)


def test_merged_takes_the_latest_row_of_a_key(spark, path):
    t = store.Merged(spark, path, "id")
    assert t.read() is None and t.next_batch() == 0
    assert t.write(rows(spark, "id string, n int, extra string", ("a", 1, "e"), ("b", 1, "f"), ("c", 1, None)), 0)
    assert t.write(rows(spark, "id string, n int, other int", ("b", 2, 5), ("d", 2, 6)), 1)
    want = [("a", 1, "e", None), ("b", 2, None, 5), ("c", 1, None, None), ("d", 2, None, 6)]
    assert plain(t.read(), "id", "n", "extra", "other") == want
    # the same batch again, with other rows in it, changes nothing
    assert not t.write(rows(spark, "id string, n int", ("a", 9)), 1) and t.next_batch() == 2
    assert plain(t.read(), "id", "n", "extra", "other") == want
    assert t.delete(rows(spark, "id string", ("a",)), 2) and plain(t.read(), "id") == [("b",), ("c",), ("d",)]
    assert t.write(rows(spark, "id string, n int", ("a", 4), ("a", 4)), 3)
    assert plain(t.read(), "id", "n") == [("a", 4), ("b", 2), ("c", 1), ("d", 2)]


def test_compaction_changes_no_row(spark, path, tmp_path):
    t = store.Merged(spark, path, "id")
    for b in range(6):
        t.write(rows(spark, "id int, n int", *[(i, b) for i in range(b, b + 3)]), b)
        before = plain(t.read(), "id", "n")
        t.compact(0.9)
        assert plain(t.read(), "id", "n") == before and t.holds(b) and t.next_batch() == b + 1
    assert any(p.name.startswith("base=") for p in (tmp_path / "t").iterdir())
    # a batch without the mark of a complete one is not there, and its number is taken again
    (tmp_path / "t" / "batch=6").mkdir()
    (tmp_path / "t" / "batch=6" / "part-0.parquet").write_bytes(b"half")
    assert t.next_batch() == 6 and t.write(rows(spark, "id int, n int", (0, 6)), 6)
    assert plain(t.read(), "id", "n")[0] == (0, 6)
