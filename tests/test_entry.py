import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(value):
    if isinstance(value, float) and math.isfinite(value) and value == int(value):
        return int(value)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, con, name):
    """The rows of every query that has SQL, compared as a bag."""
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    assert rows == sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", ["json_envelope", "html_page", "display_width", "p1_groups"])
def test_queries_without_sql_have_rows(spark, name):
    assert not entry.queries()[name](spark, DATA).isEmpty()
