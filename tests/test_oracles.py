"""Every SQL-expressible registered query equals its DuckDB oracle (exact, after rounding)."""

import math

import pytest

from surrogata.plans.oracle import ORACLE_SQL
from surrogata.plans.registry import ALL_QUERIES, SQL_QUERIES

from conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(ALL_QUERIES)
    assert set(SQL_QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(SQL_QUERIES))
def test_query_matches_duckdb(spark, duck, name):
    con = duck(SF_SMALL)
    sdf = SQL_QUERIES[name](spark, SF_SMALL)
    srows = [r.asDict() for r in sdf.collect()]
    rel = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    drows = [dict(zip(cols, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(cols)
    keys = sorted(cols)
    S = sorted(tuple(_norm(r[c]) for c in keys) for r in srows)
    D = sorted(tuple(_norm(r[c]) for c in keys) for r in drows)
    assert len(S) == len(D)
    assert S == D
