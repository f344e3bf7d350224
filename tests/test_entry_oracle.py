"""The registered queries against their DuckDB twins on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.sources.tables import TABLES
from small_data import SF_SMALL

SQL = entry.oracle_sql()
#: They read whole tuned analyses, minutes each; ``tools/oracle_check.py`` has them.
SLOW = {"glm_readout", "wide_readout"}


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["country_code", "institution", "count", "rank"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL.keys() - SLOW))
def test_query_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), dcols)
