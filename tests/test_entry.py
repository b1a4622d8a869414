import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from __spark_entry__ import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry_returns_a_frame(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_optional_parts(tmp_path):
    """The entry module, without the training-data folder and the pipeline beside it."""
    for name in ("__spark_entry__.py", "logloom"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['logloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), str(len(ORACLE_SQL))]


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted([_cell(r[c]) for c in columns] for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted([_cell(r[i]) for i in place] for r in want.fetchall())
