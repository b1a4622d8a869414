"""Columns of the caller whose names clash with an operator's own, and queries against their SQL."""

from pathlib import Path

import pytest

from logloom.llm import mixing, pieces, simhash
from logloom.llm.queries import PIECES, QUERIES
from logloom.llm.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"
NAMES = ["kept_id", "kept_print", "kept_n", "mix_id", "mix_copy", "mix_copies", "_d", "_copy", "root", "fp", "size", "taken"]


def test_clashing_columns_pass_through(spark):
    rows = [(i, f"text number {i} of some " + "words " * i, "s", *range(len(NAMES))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in NAMES))
    for out in (simhash.keep_first(docs), mixing.mixed(docs)):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows} and out.count() > 0


def test_round_trip_replaces_its_own_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "kept")], "doc_id long, text string, n_pieces int, extra string")
    r = pieces.round_trip(docs, PIECES).first()
    assert (r.n_pieces, r.extra, r.same) == (2, "kept", True)


def test_round_trip_replaces_names_in_other_case(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, Same int")
    out = pieces.round_trip(docs, PIECES)
    out.write.parquet(f"{tmp_path}/out")
    assert out.first().same is True and "Same" not in out.columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect()))) == sorted(map(repr, (tuple(r[want.columns.index(c)] for c in sorted(want.columns)) for r in want.fetchall())))
