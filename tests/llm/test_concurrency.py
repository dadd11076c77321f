"""Open spells at every moment against counting them one by one, whatever the chunks."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.llm import concurrency
from driftline.llm.common import table
from driftline.llm.queries import ORACLE_SQL

SCHEMA = "key int, start long, end long, worth long"


def plain(rows):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        own = [(a, b, w or 0) for k, a, b, w in rows if k == key and a is not None and (b is None or b > a)]
        state, high, found = (0, 0), None, []
        for t in sorted({x for a, b, _ in own for x in (a, b) if x is not None}):
            held = [w for a, b, w in own if a <= t and (b is None or b > t)]
            if (len(held), sum(held)) != state:
                state = (len(held), sum(held))
                high = state[0] if high is None else max(high, state[0])
                found.append((t, *state, high))
        for i, (t, n, w, h) in enumerate(found):
            out.append((key, t, found[i + 1][0] if i + 1 < len(found) else None, n, w, h, w == max(x[2] for x in found)))
    return sorted(out)


@pytest.mark.parametrize(("bits", "span_bits"), [(14, 12), (3, 2), (1, 1), (0, 1)])
def test_sweep_equals_counting(spark, bits, span_bits):
    r = random.Random(bits)
    rows = []
    for _ in range(400):
        a = r.choice([None, *range(-40, 60)])
        b = r.choice([None, *([(a or 0) + r.randrange(-3, 70)] * 3)])
        rows.append((r.choice([1, 1, 1, 2, -2, None]), a, b, r.choice([None, 0, 5, -5, 100])))
    rows += rows[:50] + [(7, 0, 5, 3), (7, 5, 9, 3), (8, 1, None, 0), (9, 4, 4, 1)]
    # one goes as an equal one comes: no moment
    got = concurrency.concurrency(spark.createDataFrame(rows, SCHEMA), bits=bits, span_bits=span_bits)
    assert sorted(tuple(x) for x in got.collect()) == plain(rows)


def test_no_spells_no_rows(spark):
    assert concurrency.concurrency(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sales_equal_sql_in_any_zone(spark, sf):
    con = duckdb.connect()
    for t in ("sales", "sale_lines", "clients"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op11_concurrency"])
    names = [d[0] for d in want.description]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = concurrency.sales_concurrency(*[table(spark, sf, t) for t in ("sales", "sale_lines", "clients")]).select(*names).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_odd_sales(spark):
    t = "timestamp_ntz'2024-01-02 00:00:00.9'"
    sales = spark.sql(
        f"SELECT * FROM VALUES (1L, 1L, {t}, double('nan')), (2L, null, {t}, null), (null, 9L, {t}, 1.0D), (4L, 1L, null, 1.0D), (5L, 1L, {t}, 2.345D) AS s(sale_id, client_id, sold_at, total)"
    ).withColumns({"key": F.lit("x"), "end": F.lit(1)})
    lines = spark.sql("SELECT * FROM VALUES (5L, timestamp_ntz'2024-01-01 00:00:00.5'), (1L, timestamp_ntz'2024-01-05 00:00:00'), (1L, null), (null, timestamp_ntz'2024-01-01 00:00:00') AS l(sale_id, shipped_at)")
    clients = spark.sql("SELECT * FROM VALUES (1L, 7), (1L, 3), (2L, null), (null, 5) AS c(client_id, nation_id)")
    got = {tuple(r)[:5] for r in concurrency.sales_concurrency(sales, lines, clients).collect()}
    a, b = 1704153600, 1704499200  # sale 5 ends in the second in which it starts
    assert got == {(3, a, b, 1, 0), (3, b, None, 0, 0), (-1, a, None, 2, 100), (-2, a, b, 3, 100), (-2, b, None, 2, 100)}
