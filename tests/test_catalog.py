"""Each query with SQL beside it gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from driftline.plans.extended import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted([tuple(_plain(r[c]) for c in sorted(names)) for r in got.collect()], key=str)
    b = sorted([tuple(_plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall()], key=str)
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-5)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, sf, name):
    found = QUERIES[name](spark, sf)
    rows = found.collect()
    assert len(set(found.columns)) == len(found.columns) and all(len(r) == len(found.columns) for r in rows)
    # sweeps, simulations and controls have a row for each setting, whatever is found; graphs may be empty
    assert rows or name.endswith("_graph") or name in ("negative_control", "noise_robustness", "missing_robustness", "corrupted_candidates")
