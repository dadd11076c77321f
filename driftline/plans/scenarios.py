"""Queries of the given representations and of the hidden channels, with SQL, over star-schema data in their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import channels
from driftline.plans import catalog as c
from driftline.plans import comparators
from driftline.plans.catalog import indicators, query
from driftline.plans.planner import evaluate
from driftline.sources import adapters as a


def _yes(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


def _parts(columns: dict[str, str], table: str, keys: str = "run, time", group: bool = True) -> list[str]:
    by = f" GROUP BY {keys}" if group else ""
    return [f"SELECT {keys}, '{n}' AS node_id, round(CAST({e} AS DOUBLE), 6) + 0.0 AS value FROM {table}{by}" for n, e in columns.items()]


def _numbered(prefix: str, expressions) -> dict[str, str]:
    return {f"{prefix}_{i:02d}": e for i, e in enumerate(expressions) if e}


# ---- segregation ---------------------------------------------------------------------------------

_CITY = f"""{c.EV}, city AS (SELECT run, time, agent, agent % 2 AS grp, agent % 6 AS district, (agent * 7 + time) % 9 AS near, x < 30.003 AS unhappy, n > 1 OR x > 80.003 AS moved,
  (agent + time) % 3 = 0 AS edge, least(x / 100, 1) AS alike, CASE WHEN n > 1 OR x > 80.003 THEN (agent % 7) / 7 ELSE 0 END AS far, CASE WHEN n > 1 OR x > 80.003 THEN least(x / 150, 1) END AS dest FROM ev),
 dis AS (SELECT run, time, district, avg(grp) AS grp, {_yes("unhappy")} AS unhappy, {_yes("moved")} AS moved, {_yes("edge")} AS edge, avg(dest) AS dest, avg(far) AS far FROM city GROUP BY 1, 2, 3),
 ent AS (SELECT run, time, district, -sum(p * ln(p + 1e-15)) AS h FROM (SELECT run, time, district, k / sum(k) OVER (PARTITION BY run, time, district) AS p FROM
   (SELECT run, time, district, grp, count(*) AS k FROM city GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3),
 mob AS (SELECT run, time, avg(v) OVER (PARTITION BY run ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM (SELECT run, time, {_yes("moved")} AS v FROM city GROUP BY 1, 2))"""
_GRID = f"""{c.GRID}, reach AS (SELECT time, y * 10 + x AS a, y * 10 + x AS b FROM cells WHERE s >= 0 UNION SELECT reach.time, a, q FROM reach JOIN pairs ON pairs.time = reach.time AND p = b AND same),
 roots AS (SELECT time, a, min(b) AS root FROM reach GROUP BY time, a), sizes AS (SELECT 'all' AS run, time, root, count(*) AS n FROM roots GROUP BY time, root),
 alike AS (SELECT 'all' AS run, time, same FROM pairs)"""
_micro = [
    _yes("unhappy"), _yes("moved"), _yes("edge"), "avg(alike)", "stddev_pop(alike)", "quantile_cont(alike, 0.25)", "quantile_cont(alike, 0.75)", "avg(near)",
    _yes("near <= 2"), "avg(far)", "quantile_cont(far, 0.9)", "avg(dest)", "stddev_pop(dest)", _yes("far > 0.25"), _yes("dest >= 0.75"), _yes("near = 0"),
]
_meso = ["var_pop(grp)", None, "var_pop(unhappy)", "var_pop(moved)", "quantile_cont(moved, 0.75) - quantile_cont(moved, 0.25)", "var_pop(edge)", "var_pop(dest)", "var_pop(far)"]
indicators(
    "given_segregation",
    a.city,
    comparators.indicators("schelling"),
    f"WITH RECURSIVE {_CITY}, {_GRID} "
    + " UNION ALL ".join(
        _parts(_numbered("sfix_micro", _micro), "city")
        + _parts(_numbered("sfix_meso", _meso), "dis")
        + _parts({"sfix_meso_01": "avg(h)"}, "ent")
        + _parts({"sfix_macro_01": "v"}, "mob", group=False)
        + _parts({"sfix_macro_00": "max(n) / sum(n)", "sfix_macro_02": "count(*)"}, "sizes")
        + _parts({"sfix_macro_03": _yes("same")}, "alike")
    ),
)

# ---- opinions ------------------------------------------------------------------------------------

_CIRCLE = f"""{c.TRADE}, o AS (SELECT 'all' AS run, time, agent, greatest(least((x - 150000) / 30000, 1), -1) AS op, x > 145000.0003 AS acc, (agent + time) % 5 = 0 AS back, (agent * 3 + time) % 4 = 0 AS rew,
  (agent + time * 2) % 7 = 0 AS flip, abs(x / 150000 - 1) AS dist, abs(x / 150000 - 1) / 2 - 0.03 AS shift FROM nodes),
 nb AS (SELECT o.time, o.agent, avg(n.op) AS m, stddev_pop(n.op) AS s, {_yes("abs(n.op) >= 0.75")} AS ext, {_yes("n.op > 0")} AS pos, {_yes("n.acc")} AS acc, {_yes("n.rew")} AS rew, avg(abs(n.shift)) AS shift
   FROM o JOIN bi ON bi.time = o.time AND bi.u = o.agent JOIN o n ON n.time = bi.time AND n.agent = bi.v GROUP BY 1, 2),
 w AS (SELECT o.run, o.time, o.op, nb.m, nb.s, nb.ext, nb.pos, nb.acc AS nacc, nb.rew AS nrew, nb.shift AS nshift FROM o LEFT JOIN nb USING (time, agent))"""
_ENDS = """p AS (SELECT bi.time, a.op AS x, b.op AS y FROM bi JOIN o a ON a.time = bi.time AND a.agent = bi.u JOIN o b ON b.time = bi.time AND b.agent = bi.v),
 r AS (SELECT time, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS r FROM p GROUP BY time),
 asso AS (SELECT 'all' AS run, t.time, coalesce(r, 0) AS r FROM (SELECT DISTINCT time FROM o) t LEFT JOIN r USING (time)),
 b AS (SELECT time, op, min(op) OVER (PARTITION BY time) AS lo, max(op) OVER (PARTITION BY time) AS hi FROM o),
 d AS (SELECT time, CASE WHEN hi > lo THEN least(9, floor((op - lo) / (hi - lo) * 10)) ELSE 0 END AS bin, count(*) AS k FROM b GROUP BY 1, 2),
 ent AS (SELECT 'all' AS run, time, -sum(p * ln(p)) AS h FROM (SELECT time, k / sum(k) OVER (PARTITION BY time) AS p FROM d) GROUP BY time)"""
_micro = [
    _yes("acc"), _yes("back"), _yes("NOT acc AND NOT back"), _yes("rew"), "avg(dist)", "quantile_cont(dist, 0.9)", "avg(abs(shift))", "stddev_pop(shift)", _yes("flip"), _yes("abs(op) >= 0.75"),
    "avg(abs(op))", _yes("op > 0"), _yes("abs(shift) > 0.05"), "avg(CASE WHEN acc THEN dist END)", "avg(CASE WHEN back THEN dist END)", "quantile_cont(dist, 0.25)",
]
_meso = ["avg(abs(op - m))", "var_pop(m)", "avg(s)", "quantile_cont(m, 0.75) - quantile_cont(m, 0.25)", "var_pop(ext)", "stddev_pop(pos)", "var_pop(nacc)", "var_pop(nrew)"]
indicators(
    "given_opinions",
    a.circle,
    comparators.indicators("deffuant"),
    f"WITH {_CIRCLE}, {_ENDS} "
    + " UNION ALL ".join(
        _parts(_numbered("dfix_micro", _micro), "o")
        + _parts(_numbered("dfix_meso", _meso), "w")
        + _parts({"dfix_macro_00": "stddev_pop(op)", "dfix_macro_01": "avg(op)"}, "o")
        + _parts({"dfix_macro_02": "r"}, "asso", group=False)
        + _parts({"dfix_macro_03": "h"}, "ent", group=False)
    ),
)

# ---- hidden channels -----------------------------------------------------------------------------

#: Steps for which the SQL holds noise; the years of the orders are seven.
_STEPS = 12


def _channel_sql(variant: str) -> str:
    """Each channel by recursion over the steps, its noise as a table."""
    off = comparators.disabled_mechanism("deffuant", variant)
    rows = list(enumerate(comparators.CHAINS["deffuant"]))
    chains = [(i, r[3], 0 if r[0] == off else r[4], r[5], 0 if r[0] == off else 1) for i, r in rows]
    shocks = [(i, t, *map(float, pair)) for i, _ in rows for t, pair in enumerate(zip(*[channels.noise(0, _STEPS, s + i) for s in channels.STREAMS.values()], strict=True))]
    per = [
        (_yes("acc"), "least(1, 4 * var_pop(nacc))", "1 - stddev_pop(op)"),
        ("avg(abs(shift))", "least(1, 4 * var_pop(nshift))", "1 - stddev_pop(op)"),
        (_yes("back"), "avg(abs(op - m)) / 2", "avg(abs(op))"),
        (_yes("rew"), "least(1, 4 * var_pop(nrew))", "any_value(parts) / 25"),
    ]
    series = " UNION ALL ".join(
        f"SELECT time, {i} AS i, d.v AS driver, e.v AS context, f.v AS late FROM (SELECT time, {x} AS v FROM o GROUP BY time) d JOIN (SELECT time, {y} AS v FROM w GROUP BY time) e USING (time) "
        f"JOIN (SELECT time, {z} AS v FROM o JOIN comps USING (time) GROUP BY time) f USING (time)"
        for i, (x, y, z) in enumerate(per)
    )

    def step(name: str, weight: float, context: str, shock: str, sign: str, lag: str, driver: str) -> str:
        goal = f"0.5 + 0.3 * (least(greatest(s.{context}, 0), 1) - 0.5) + s.{shock} + CASE WHEN q.step IS NULL THEN 0 ELSE 0.6 * s.{sign} * (least(greatest(q.{driver}, 0), 1) - 0.5) END"
        return f"""{name} AS (SELECT CAST(0 AS BIGINT) AS step, i, CAST(0.5 AS DOUBLE) AS v FROM chains UNION ALL
   SELECT s.step, s.i, least(greatest({weight} * m.v + {1 - weight} * ({goal}), 0), 1) FROM {name} m JOIN steps s ON s.i = m.i AND s.step = m.step + 1 LEFT JOIN {"steps" if name == "meso" else "meso"} q ON q.i = s.i AND q.step = s.step - s.{lag})"""

    return f"""WITH RECURSIVE {_CIRCLE}, {c._spread}, comps AS (SELECT time, count(*) + 25 - sum(n) AS parts FROM sizes GROUP BY time),
 chains(i, lag, sign, lag2, sign2) AS (VALUES {c._values(chains)}), shocks(i, step, z1, z2) AS (VALUES {c._values(shocks)}), series AS ({series}),
 steps AS (SELECT r.*, lag, sign, lag2, sign2, z1, z2 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY time) - 1 AS step FROM series) r JOIN chains USING (i) JOIN shocks USING (i, step)),
 {step("meso", 0.45, "context", "z1", "sign", "lag", "driver")}, {step("macro", 0.7, "late", "z2", "sign2", "lag2", "v")}
 SELECT time, i AS channel, round(v, 6) + 0.0 AS value FROM steps JOIN (SELECT step, i, v FROM meso) USING (step, i) UNION ALL SELECT time, i + 4, round(v, 6) + 0.0 FROM steps JOIN (SELECT step, i, v FROM macro) USING (step, i)"""


def _channels(variant: str):
    def run(spark, sf_dir):
        series = evaluate(a.circle(spark, sf_dir), comparators.drivers("deffuant")).withColumn("seed", F.lit(0).cast("long"))
        hidden = channels.hidden_channels(series, "deffuant", ("run", "seed"), "seed", variant)
        cells = F.posexplode(F.array(*[f"mechanism_channel_{i}" for i in range(8)])).alias("channel", "value")
        return hidden.select(F.col("time").cast("long").alias("time"), cells)

    return run


query("hidden_channels", _channel_sql("baseline"))(_channels("baseline"))
query("hidden_channels_disabled", _channel_sql("disable_backfire"))(_channels("disable_backfire"))


_TRUTH = [(s, *r) for s in comparators.CHAINS for r in comparators.relations(s)]


@query(
    "true_relations",
    f"WITH t(scenario, source, target, lag, sign, mechanism) AS (VALUES {c._values(_TRUTH)}) SELECT scenario, x.mechanism, x.source AS micro, x.target AS meso, y.target AS macro, CAST(x.lag + y.lag AS BIGINT) AS lag, CAST(x.sign * y.sign AS BIGINT) AS sign FROM t x JOIN t y USING (scenario) WHERE x.target = y.source",
)
def true_relations(spark, sf_dir):
    t = spark.createDataFrame(_TRUTH, "scenario string, source string, target string, lag long, sign long, mechanism string")
    late = t.select("scenario", F.col("source").alias("meso"), F.col("target").alias("macro"), F.col("lag").alias("late"), F.col("sign").alias("turn"))
    first = t.withColumnsRenamed({"source": "micro", "target": "meso"})
    return first.join(late, ["scenario", "meso"]).select("scenario", "mechanism", "micro", "meso", "macro", (F.col("lag") + F.col("late")).alias("lag"), (F.col("sign") * F.col("turn")).alias("sign"))
