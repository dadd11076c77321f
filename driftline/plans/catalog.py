"""The named queries and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.operators import discovery, effects, network, robustness, secondary, windows
from driftline.plans.planner import evaluate
from driftline.sources import adapters as a
from driftline.sources import simulators
from driftline.streaming.ingest import windowed_reducers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- expressions -----------------------------------------------------------------------------


def field(name: str) -> dict:
    return {"op": "field", "name": name}


def const(value) -> dict:
    return {"op": "constant", "value": value}


def op(name: str, **keys) -> dict:
    return {"op": name, **keys}


def over_agents(name: str, x: dict, **more) -> dict:
    return op(name, input=x, axis="agent", **more)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, without negative zeros; what is a tie but for summation order goes up."""
    return df.select(*[(F.round(F.col(c) + 1e-8, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Register a query; one with SQL beside it gives doubles to six digits, as its SQL does, so that both can be compared."""

    def add(f: Query) -> Query:
        QUERIES[name] = f if sql is None else lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql.replace(", 6) + 0.0", " + 1e-8, 6) + 0.0")
        return f

    return add


EV = """ev AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS time, user_id AS agent,
 avg(value) AS x, count(*) AS n, user_id % 5 AS g FROM events GROUP BY event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)), user_id)"""
DAILY = f"{EV}, daily AS (SELECT run, time, avg(x) AS value FROM ev GROUP BY run, time)"
LI = """li AS (SELECT l_returnflag AS run, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS time, l_suppkey AS agent,
 avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2, 3)"""


def rows_sql(with_: str, columns: dict[str, str], table: str = "ev", keys: str = "run, time", group: bool = True) -> str:
    """keys, node_id, value for each expression of a table."""
    parts = [
        f"SELECT {keys}, '{n}' AS node_id, round(CAST({e} AS DOUBLE), 6) + 0.0 AS value FROM {table}" + (f" GROUP BY {keys}" if group else "")
        for n, e in columns.items()
    ]
    return f"WITH {with_} " + " UNION ALL ".join(parts)


def indicators(name: str, source: Callable, nodes: dict[str, dict], sql: str | None, temporal: dict | None = None) -> None:
    query(name, sql)(lambda spark, sf_dir: evaluate(source(spark, sf_dir), nodes, temporal).withColumn("time", F.col("time").cast("long")))


X, N, G = field("x"), field("n"), field("g")
FLAGSHIP = op("rolling_mean", window=3, input=over_agents("mean", X))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rolling_mean_of_means"](spark, sf_dir)


indicators(
    "rolling_mean_of_means",
    a.events,
    {"rolled": FLAGSHIP},
    f"WITH {DAILY} SELECT run, time, 'rolled' AS node_id, round(avg(value) OVER (PARTITION BY run ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0 AS value FROM daily",
)

_less = op("subtract", left=X, right=const(50))
_scalar = {
    "abs": (op("abs", input=_less), "abs(x - 50)"),
    "negate": (op("negate", input=X), "-x"),
    "sqrt": (op("sqrt", input=_less), "sqrt(greatest(x - 50, 0))"),
    "log1p": (op("log1p", input=_less), "ln(1 + greatest(x - 50, -0.999999))"),
    "add": (op("add", left=X, right=N), "x + n"),
    "subtract": (op("subtract", left=X, right=N), "x - n"),
    "multiply": (op("multiply", left=X, right=N), "x * n"),
    "divide": (op("divide", left=X, right=op("subtract", left=N, right=const(1))), "CASE WHEN n = 1 THEN 0 ELSE x / (n - 1) END"),
    "safe_ratio": (op("safe_ratio", left=N, right=G), "CASE WHEN g = 0 THEN 0 ELSE n / g END"),
    "distance": (op("distance", left=X, right=N), "abs(x - n)"),
    "clip": (op("clip", input=X, minimum=10, maximum=60.5), "least(greatest(x, 10), 60.5)"),
}
indicators("scalar_math", a.events, {k: over_agents("mean", e) for k, (e, _) in _scalar.items()}, rows_sql(EV, {k: f"avg({s})" for k, (_, s) in _scalar.items()}))

_compare = {"greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<=", "equal": "=", "not_equal": "<>"}
indicators(
    "predicates",
    a.events,
    {k: over_agents("fraction", op(k, left=N, right=const(2))) for k in _compare}
    | {f"count_{k}": over_agents("count", op(k, left=N, right=const(2))) for k in _compare}
    | {"where": over_agents("mean", op("where", condition=op("greater", left=N, right=const(1)), input=X))},
    rows_sql(EV, {k: f"avg(CASE WHEN n {s} 2 THEN 1.0 ELSE 0.0 END)" for k, s in _compare.items()} | {f"count_{k}": f"count(*) FILTER (n {s} 2)" for k, s in _compare.items()} | {"where": "avg(CASE WHEN n > 1 THEN x END)"}),
)

_reduced = {"mean": "avg(x)", "sum": "coalesce(sum(x), 0)", "count": "count(x)", "variance": "var_pop(x)", "std": "stddev_pop(x)"}
_quantiles = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
indicators(
    "axis_reducers",
    a.events,
    {k: over_agents(k, X) for k in _reduced} | {k: over_agents("quantile", X, q=q) for k, q in _quantiles.items()},
    rows_sql(EV, _reduced | {k: f"quantile_cont(x, {q})" for k, q in _quantiles.items()}),
)
indicators(
    "quantile_range",
    a.lineitems,
    {"range": op("subtract", left=over_agents("quantile", field("price"), q=0.75), right=over_agents("quantile", field("price"), q=0.25)), "spread": over_agents("std", field("discount"))},
    rows_sql(LI, {"range": "quantile_cont(price, 0.75) - quantile_cont(price, 0.25)", "spread": "stddev_pop(discount)"}, "li"),
)
indicators(
    "entropy",
    a.events,
    {"entropy": over_agents("entropy", N), "binned": over_agents("binned_entropy", X, bins=8)},
    f"""WITH {EV}, c AS (SELECT run, time, n, count(*) AS k FROM ev GROUP BY run, time, n),
     e AS (SELECT run, time, -sum(p * ln(p + 1e-15)) AS h FROM (SELECT run, time, k / sum(k) OVER (PARTITION BY run, time) AS p FROM c) GROUP BY run, time),
     b AS (SELECT *, min(x) OVER (PARTITION BY run, time) AS lo, max(x) OVER (PARTITION BY run, time) AS hi FROM ev),
     d AS (SELECT run, time, CASE WHEN hi > lo THEN least(7, floor((x - lo) / (hi - lo) * 8)) ELSE 0 END AS bin, count(*) AS k FROM b GROUP BY 1, 2, 3),
     f AS (SELECT run, time, -sum(p * ln(p)) AS h FROM (SELECT run, time, k / sum(k) OVER (PARTITION BY run, time) AS p FROM d) GROUP BY run, time)
     SELECT run, time, 'entropy' AS node_id, round(h, 6) + 0.0 AS value FROM e UNION ALL SELECT run, time, 'binned', round(h, 6) + 0.0 FROM f""",
)
indicators(
    "correlation",
    a.lineitems,
    {"r": op("correlation", left=field("quantity"), right=field("price"), axis="agent")},
    f"""WITH {LI} SELECT run, time, 'r' AS node_id, round(CASE WHEN var_pop(quantity) * var_pop(price) > 0 THEN covar_pop(quantity, price) / sqrt(var_pop(quantity) * var_pop(price)) ELSE 0 END, 6) + 0.0 AS value
     FROM li GROUP BY run, time""",
)

_grouped = {"mean": "avg(x)", "sum": "sum(x)", "count": "count(x)", "fraction": "avg(CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END)", "variance": "var_pop(x)", "std": "stddev_pop(x)"}
indicators(
    "group_reduce",
    a.events,
    {k: op("variance", axis="group", input=op("group_reduce", values=X, groups=G, axis="agent", reducer=k)) for k in _grouped}
    | {"entropy": op("mean", axis="group", input=op("group_reduce", values=N, groups=G, axis="agent", reducer="entropy"))},
    f"""WITH {EV}, top AS (SELECT run, max(g) AS m FROM ev GROUP BY run),
     dense AS (SELECT DISTINCT run, time, unnest(range(m + 1)) AS g FROM (SELECT DISTINCT run, time FROM ev) JOIN top USING (run)),
     r AS (SELECT run, time, g, {", ".join(f"{s} AS r_{k}" for k, s in _grouped.items())} FROM ev GROUP BY run, time, g),
     j AS (SELECT dense.run, dense.time, {", ".join(f"r_{k}" for k in _grouped if k != "count")}, coalesce(r_count, 0) AS r_count FROM dense LEFT JOIN r USING (run, time, g)),
     c AS (SELECT run, time, g, n, count(*) AS k FROM ev GROUP BY run, time, g, n),
     h AS (SELECT run, time, g, -sum(p * ln(p + 1e-15)) AS h FROM (SELECT run, time, g, k / sum(k) OVER (PARTITION BY run, time, g) AS p FROM c) GROUP BY run, time, g)
     {" UNION ALL ".join(f"SELECT run, time, '{k}' AS node_id, round(var_pop(r_{k}), 6) + 0.0 AS value FROM j GROUP BY run, time" for k in _grouped)}
     UNION ALL SELECT run, time, 'entropy', round(avg(h), 6) + 0.0 FROM h GROUP BY run, time""",
)

_mean = over_agents("mean", X)
_w = "OVER (PARTITION BY run ORDER BY time"
indicators(
    "temporal_windows",
    a.events,
    {k: _mean for k in ("identity", "rolling_mean", "rolling_std", "difference", "cumulative_mean")} | {"step": op("time_difference", input=_mean), "rolled_std": op("rolling_std", input=_mean, window=5)},
    rows_sql(
        DAILY,
        {
            "identity": "value",
            "rolling_mean": f"avg(value) {_w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
            "rolling_std": f"stddev_pop(value) {_w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
            "difference": f"value - coalesce(lag(value) {_w}), value)",
            "cumulative_mean": f"avg(value) {_w} ROWS UNBOUNDED PRECEDING)",
            "step": f"value - coalesce(lag(value) {_w}), value)",
            "rolled_std": f"stddev_pop(value) {_w} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
        },
        "daily",
        group=False,
    ),
    {"rolling_mean": {"op": "rolling_mean", "window": 4}, "rolling_std": {"op": "rolling_std", "window": 4}, "difference": {"op": "difference"}, "cumulative_mean": {"op": "cumulative_mean"}},
)

# ---- grids and graphs ------------------------------------------------------------------------

TRADE = """placed AS (SELECT o_orderkey, o_totalprice, year(o_orderdate) - 1995 AS time, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
 ties AS (SELECT time, least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, count(*) AS n FROM placed JOIN lineitem ON o_orderkey = l_orderkey
 JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3),
 edges AS (SELECT time, u, v FROM (SELECT *, avg(n) OVER (PARTITION BY time) AS mean FROM ties) WHERE n < mean),
 bi AS (SELECT time, u, v FROM edges UNION ALL SELECT time, v, u FROM edges),
 nodes AS (SELECT time, c_nationkey AS agent, avg(o_totalprice) AS x FROM placed GROUP BY 1, 2)"""
_near = {"mean": "avg(x)", "sum": "sum(x)", "count": "count(x)", "variance": "var_pop(x)", "std": "stddev_pop(x)"}
_link, _balance, _nations = field("link"), field("balance"), field("nations")
indicators(
    "neighbourhood_reduce",
    a.trade,
    {k: over_agents("mean", op("network_neighborhood_reduce", values=_balance, edges=_link, reducer=k)) for k in _near}
    | {"contrast": over_agents("mean", op("distance", left=_balance, right=op("network_neighborhood_reduce", values=_balance, edges=_link, reducer="mean")))},
    f"""WITH {TRADE}, r AS (SELECT bi.time, bi.u AS agent, {", ".join(f"{s} AS r_{k}" for k, s in _near.items())} FROM bi JOIN nodes ON nodes.time = bi.time AND nodes.agent = bi.v GROUP BY 1, 2),
     j AS (SELECT nodes.time, nodes.x, {", ".join(f"r_{k}" for k in _near if k != "count")}, coalesce(r_count, 0) AS r_count FROM nodes LEFT JOIN r USING (time, agent))
     {" UNION ALL ".join(f"SELECT 'all' AS run, time, '{k}' AS node_id, round(avg(r_{k}), 6) + 0.0 AS value FROM j GROUP BY time" for k in _near)}
     UNION ALL SELECT 'all', time, 'contrast', round(avg(abs(x - r_mean)), 6) + 0.0 FROM j GROUP BY time""",
)
indicators(
    "network_structure",
    a.trade,
    {"assortativity": op("network_assortativity", values=_balance, edges=_link), "density": op("network_density", edges=_link, node_count=_nations)},
    f"""WITH {TRADE}, p AS (SELECT bi.time, a.x AS x, b.x AS y FROM bi JOIN nodes a ON a.time = bi.time AND a.agent = bi.u JOIN nodes b ON b.time = bi.time AND b.agent = bi.v),
     r AS (SELECT time, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS r FROM p GROUP BY time)
     SELECT 'all' AS run, t.time, 'assortativity' AS node_id, round(coalesce(r, 0), 6) + 0.0 AS value FROM (SELECT DISTINCT time FROM nodes) t LEFT JOIN r USING (time)
     UNION ALL SELECT 'all', time, 'density', round(2.0 * count(*) / (25 * 24), 6) + 0.0 FROM edges GROUP BY time""",
)
_spread = """reach AS (SELECT time, u AS a, u AS b FROM bi UNION SELECT reach.time, reach.a, bi.v FROM reach JOIN bi ON bi.time = reach.time AND bi.u = reach.b),
 roots AS (SELECT time, a, min(b) AS root FROM reach GROUP BY time, a), sizes AS (SELECT time, root, count(*) AS n FROM roots GROUP BY time, root)"""
indicators(
    "network_components",
    a.trade,
    {"count": op("network_component_count", edges=_link, node_count=_nations), "largest": op("network_largest_component_fraction", edges=_link, node_count=_nations)},
    f"""WITH RECURSIVE {TRADE}, {_spread} SELECT 'all' AS run, time, 'count' AS node_id, CAST(count(*) + 25 - sum(n) AS DOUBLE) AS value FROM sizes GROUP BY time
     UNION ALL SELECT 'all', time, 'largest', round(max(n) / 25, 6) + 0.0 FROM sizes GROUP BY time""",
)
GRID = """cells AS (SELECT year(l_shipdate) - 1992 AS time, l_suppkey % 10 AS y, l_partkey % 10 AS x, CASE WHEN count(*) % 7 = 0 THEN -1 WHEN avg(l_discount) > 0.05 THEN 1 ELSE 0 END AS s FROM lineitem GROUP BY 1, 2, 3),
 moves AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, 9), (9, 0)) m(dy, dx)),
 pairs AS (SELECT a.time, a.y * 10 + a.x AS p, b.y * 10 + b.x AS q, a.s = b.s AS same FROM cells a JOIN moves ON true JOIN cells b ON b.time = a.time AND b.y = (a.y + dy) % 10 AND b.x = (a.x + dx) % 10 WHERE a.s >= 0 AND b.s >= 0)"""
_state = field("state")
indicators(
    "grid_structure",
    a.grid,
    {"similarity": op("spatial_neighbor_similarity", input=_state), "components": op("connected_component_count", input=_state), "largest": op("largest_component_fraction", input=_state)},
    f"""WITH RECURSIVE {GRID}, reach AS (SELECT time, y * 10 + x AS a, y * 10 + x AS b FROM cells WHERE s >= 0 UNION SELECT reach.time, a, q FROM reach JOIN pairs ON pairs.time = reach.time AND p = b AND same),
     roots AS (SELECT time, a, min(b) AS root FROM reach GROUP BY time, a), sizes AS (SELECT time, root, count(*) AS n FROM roots GROUP BY time, root)
     SELECT 'all' AS run, time, 'similarity' AS node_id, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value FROM pairs GROUP BY time
     UNION ALL SELECT 'all', time, 'components', CAST(count(*) AS DOUBLE) FROM sizes GROUP BY time
     UNION ALL SELECT 'all', time, 'largest', round(max(n) / sum(n), 6) + 0.0 FROM sizes GROUP BY time""",
)


@query("endpoint_select", f"WITH {TRADE} SELECT 'all' AS run, time, 'low' AS node_id, round(avg(u), 6) + 0.0 AS value FROM edges GROUP BY time")
def endpoint_select(spark, sf_dir):
    low = op("mean", axis="edge", input=op("select", input=_link, axis="endpoint", index=0))
    return evaluate(a.trade(spark, sf_dir), {"low": low}).withColumn("time", F.col("time").cast("long"))


_FAULTY = """e AS (SELECT c_nationkey % 3 AS run, CAST(CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN -1 ELSE c_nationkey % 4 END AS BIGINT) AS u,
 CAST(c_custkey % 5 AS BIGINT) AS v FROM customer)"""


@query(
    "edge_faults",
    f"""WITH {_FAULTY}, n AS (SELECT run, max(u) + 1 AS node_count FROM e GROUP BY run), whole AS (SELECT * FROM e WHERE u IS NOT NULL AND v IS NOT NULL)
     SELECT run, u, v, 'invalid end' AS fault FROM e WHERE u IS NULL OR v IS NULL OR u < 0 OR v < 0
     UNION ALL SELECT run, u, v, 'loop' FROM whole WHERE u = v
     UNION ALL SELECT run, least(u, v), greatest(u, v), 'duplicate undirected edge' FROM whole GROUP BY 1, 2, 3 HAVING count(*) > 1
     UNION ALL SELECT run, u, v, 'end beyond the nodes' FROM whole JOIN n USING (run) WHERE greatest(u, v) >= node_count""",
)
def edge_faults(spark, sf_dir):
    a.read(spark, sf_dir, "customer").createOrReplaceTempView("driftline_customer")
    e = spark.sql(f"WITH {_FAULTY.replace('FROM customer', 'FROM driftline_customer')} SELECT * FROM e")
    nodes = e.groupBy("run").agg((F.max("u") + 1).alias("node_count"))
    return network.faulty_edges(e, ["run"], nodes)


# ---- series ----------------------------------------------------------------------------------


@query("lag_matrix", f"WITH {DAILY} SELECT run, time, round(value, 6) + 0.0 AS value, round(lag(value, 1) OVER w, 6) + 0.0 AS lag_1, round(lag(value, 2) OVER w, 6) + 0.0 AS lag_2 FROM daily WINDOW w AS (PARTITION BY run ORDER BY time)")
def lag_matrix(spark, sf_dir):
    return windows.lags(a.daily(spark, sf_dir), ["run"], "value", 2).withColumn("time", F.col("time").cast("long"))


_dev = f"{DAILY}, dev AS (SELECT run, time, value - avg(value) OVER (PARTITION BY run) AS d, stddev_pop(value) OVER (PARTITION BY run) AS s FROM daily)"


@query(
    "onset",
    f"""WITH {_dev}, m AS (SELECT run, time, abs(d) >= 0.2 * s AS flag, d FROM dev),
     a AS (SELECT run, time, count(*) OVER w = 2 AND bool_and(flag) OVER w AND min(sign(d)) OVER w = max(sign(d)) OVER w AND min(abs(sign(d))) OVER w > 0 AS begins FROM m
           WINDOW w AS (PARTITION BY run ORDER BY time ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
     SELECT run, coalesce(min(time) FILTER (begins AND time >= 2), -1) AS onset FROM a GROUP BY run""",
)
def onset(spark, sf_dir):
    run = Window.partitionBy("run")
    d = a.daily(spark, sf_dir).withColumns({"d": F.col("value") - F.avg("value").over(run), "s": F.stddev_pop("value").over(run)})
    found = windows.onset(d.withColumn("flag", F.abs("d") >= 0.2 * F.col("s")), ["run"], "flag", "d", 2, 2)
    return found.withColumn("onset", F.col("onset").cast("long"))


@query(
    "false_discovery",
    f"""WITH {DAILY}, p AS (SELECT run, time, (time * 7919 % 101 + 1) / 200.0 AS p FROM daily),
     r AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, count(*) OVER (PARTITION BY run ORDER BY p) AS k FROM p)
     SELECT run, time, round(p, 6) + 0.0 AS p, round(least(1, min(p * n / k) OVER (PARTITION BY run ORDER BY p DESC)), 6) + 0.0 AS q FROM r""",
)
def false_discovery(spark, sf_dir):
    p = a.daily(spark, sf_dir).select("run", F.col("time").cast("long").alias("time"), ((F.col("time") * 7919 % 101 + 1) / 200.0).alias("p"))
    return windows.false_discovery(p, ["run"])


@query(
    "circular_shift",
    f"WITH {DAILY}, n AS (SELECT run, count(*) AS n FROM daily GROUP BY run) SELECT d.run, (d.time + 7) % n AS time, round(d.value, 6) + 0.0 AS value FROM daily d JOIN n USING (run)",
)
def circular_shift(spark, sf_dir):
    d = a.daily(spark, sf_dir)
    shifts = d.select("run").distinct().withColumn("shift", F.lit(7))
    return windows.circular_shift(d, ["run"], "value", shifts).withColumn("time", F.col("time").cast("long"))


_gaps = "CASE WHEN time % 4 IN (1, 2) OR time < 2 THEN NULL ELSE value END"


@query(
    "interpolation",
    f"""WITH {DAILY}, g AS (SELECT run, time, {_gaps} AS v FROM daily),
     f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER b AS t0,
             first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER a AS t1 FROM g
           WINDOW b AS (PARTITION BY run ORDER BY time ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY run ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
     SELECT run, time, round(coalesce(v, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (time - t0) / (t1 - t0) END, v0, v1), 6) + 0.0 AS value FROM f""",
)
def interpolation(spark, sf_dir):
    d = a.daily(spark, sf_dir).withColumn("time", F.col("time").cast("long")).withColumn("value", F.expr(_gaps))
    return windows.interpolate(d, ["run"], "value")


@query("peak_time", f"WITH {_dev} SELECT run, arg_min(time, -abs(d)) AS peak_time FROM dev WHERE time >= 5 GROUP BY run")
def peak_time(spark, sf_dir):
    d = a.daily(spark, sf_dir).withColumn("d", F.col("value") - F.avg("value").over(Window.partitionBy("run")))
    return windows.peak(d, ["run"], "d", 5).withColumn("peak_time", F.col("peak_time").cast("long"))


# ---- effects and decisions -------------------------------------------------------------------

FLAGS = """means AS (SELECT l_returnflag AS direction, l_suppkey % 10 AS seed, (year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) - 1 AS time, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2, 3),
 runs AS (SELECT direction, seed, time, 'quantity' AS node_id, quantity AS value FROM means UNION ALL SELECT direction, seed, time, 'discount', discount FROM means),
 paired AS (SELECT i.direction, i.seed, i.time, i.node_id, b.value AS base, i.value - b.value AS d FROM runs i JOIN runs b USING (seed, time, node_id) WHERE i.direction <> 'A' AND b.direction = 'A')"""


def _pairs(spark, sf_dir) -> DataFrame:
    runs = a.flag_runs(spark, sf_dir)
    return effects.pair_runs(runs.filter("direction = 'A'"), runs.filter("direction <> 'A'"), ["direction"])


@query(
    "paired_effects",
    f"""WITH {FLAGS}, late AS (SELECT * FROM paired WHERE time >= 15), s AS (SELECT direction, node_id, seed, avg(d) AS d FROM late GROUP BY 1, 2, 3),
     r AS (SELECT direction, node_id, avg(d) AS raw FROM s GROUP BY 1, 2), sd AS (SELECT direction, node_id, stddev_samp(base) AS sd FROM late GROUP BY 1, 2)
     SELECT direction, node_id, round(raw, 6) + 0.0 AS raw, round(sd, 6) + 0.0 AS baseline_sd, round(raw / sd, 6) + 0.0 AS standardised FROM r JOIN sd USING (direction, node_id)""",
)
def paired_effects(spark, sf_dir):
    return effects.mean_effects(_pairs(spark, sf_dir), ["direction", "node_id"], 15)


@query("effect_bands")
def effect_bands(spark, sf_dir):
    return effects.effect_summaries(_pairs(spark, sf_dir), ["direction", "node_id"], {"bootstrap_repetitions": 200})


@query("effect_curves")
def effect_curves(spark, sf_dir):
    return effects.effect_curves(_pairs(spark, sf_dir), ["direction", "node_id"], {"bootstrap_repetitions": 200})


_DOSE = "CASE left(o_orderpriority, 1) WHEN '1' THEN -1.0 WHEN '2' THEN -0.5 WHEN '3' THEN 0.0 WHEN '4' THEN 0.5 ELSE 1.0 END"


@query(
    "dose_response",
    f"""WITH e AS (SELECT year(o_orderdate) AS year, CAST({_DOSE} AS DOUBLE) AS dose, avg(o_totalprice) AS effect FROM orders GROUP BY 1, 2),
     k AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY effect) AS r, lag(effect) OVER (PARTITION BY year ORDER BY dose) AS before FROM e),
     s AS (SELECT year, regr_slope(effect, dose) AS slope, corr(r, dose) AS rho, var_pop(effect) * 5 AS sst, sum(effect * (dose * dose - 0.5)) AS q FROM k GROUP BY year),
     m AS (SELECT x.year, avg(CASE WHEN sign(slope) * (y.effect - x.effect) >= 0 THEN 1.0 ELSE 0.0 END) AS monotone FROM e x JOIN e y ON x.year = y.year AND y.dose > x.dose JOIN s ON s.year = x.year GROUP BY 1),
     j AS (SELECT k.year, avg(CASE WHEN sign(slope) * (effect - before) >= 0 THEN 1.0 ELSE 0.0 END) AS adjacent FROM k JOIN s ON s.year = k.year WHERE before IS NOT NULL GROUP BY 1)
     SELECT year, round(slope, 6) + 0.0 AS slope, round(rho, 6) + 0.0 AS rho, round(monotone, 6) + 0.0 AS monotone, round(adjacent, 6) + 0.0 AS adjacent,
       round(q * q / 0.875 / sst, 6) + 0.0 AS delta_r2, q * q / 0.875 / sst > 0.05 AS nonlinear FROM s JOIN m USING (year) JOIN j USING (year)""",
)
def dose_response(spark, sf_dir):
    o = a.read(spark, sf_dir, "orders")
    e = o.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.expr(f"CAST({_DOSE} AS DOUBLE)").alias("dose")).agg(F.avg("o_totalprice").alias("effect"))
    return secondary.dose_summary(e, ["year"])


def _graphs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    links = a.trade(spark, sf_dir).tables[("time", "edge")]
    year = lambda t: links.filter(F.col("time") == t).select(
        F.col("link_0").alias("source"), F.col("link_1").alias("target"), (F.col("link_0") % 3).alias("lag"),
        ((F.col("link_1") % 3) - 1.0 + F.lit(t) * (F.col("link_0") % 2)).cast("double").alias("beta"), ((F.col("link_0") + F.col("link_1")) % 5 / 4.0).alias("support"),
    )
    return year(0), year(1)


_G2 = f"""{TRADE}, g0 AS (SELECT u, v, u % 3 AS lag, v % 3 - 1 AS beta FROM edges WHERE time = 0), g1 AS (SELECT u, v, u % 3 AS lag, v % 3 - 1 + u % 2 AS beta, (u + v) % 5 / 4.0 AS support FROM edges WHERE time = 1),
 hits AS (SELECT g0.lag AS tl, g1.lag AS fl, g0.beta AS tb, g1.beta AS fb FROM g0 JOIN g1 USING (u, v)),
 n AS (SELECT (SELECT count(*) FROM hits) AS hit, (SELECT count(*) FROM g0) AS true_n, (SELECT count(*) FROM g1) AS found_n),
 p AS (SELECT *, CASE WHEN found_n > 0 THEN hit / found_n ELSE 0 END AS pr, CASE WHEN true_n > 0 THEN hit / true_n ELSE 0 END AS re FROM n)"""


@query(
    "graph_recovery",
    f"""WITH {_G2} SELECT round(pr, 6) + 0.0 AS precision, round(re, 6) + 0.0 AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) + 0.0 AS f1,
     found_n - hit + true_n - hit AS shd, round((SELECT avg(abs(fl - tl)) FROM hits WHERE fl > 0), 6) + 0.0 AS lag_mae,
     round((SELECT avg(CASE WHEN sign(fb) = sign(tb) THEN 1.0 ELSE 0.0 END) FROM hits WHERE fb <> 0), 6) + 0.0 AS direction_accuracy,
     round((SELECT avg(support) FROM g1), 6) + 0.0 AS stability, found_n AS retained FROM p""",
)
def graph_recovery(spark, sf_dir):
    return secondary.recovery(*_graphs(spark, sf_dir))


@query(
    "edge_sets",
    f"""WITH {TRADE}, a AS (SELECT u, v FROM edges WHERE time = 0), b AS (SELECT u, v FROM edges WHERE time = 1)
     SELECT 'intersect' AS kind, u, v FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', u, v FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
     UNION ALL SELECT 'union', u, v FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def edge_sets(spark, sf_dir):
    x, y = (g.select(F.col("source").alias("u"), F.col("target").alias("v")) for g in _graphs(spark, sf_dir))
    kinds = {"intersect": x.intersect(y), "except": x.subtract(y), "union": x.union(y).distinct()}
    out = [df.select(F.lit(k).alias("kind"), "u", "v") for k, df in kinds.items()]
    return out[0].union(out[1]).union(out[2])


@query(
    "set_agreement",
    f"""WITH {TRADE}, s AS (SELECT time, list(u * 100 + v) AS items FROM edges GROUP BY time)
     SELECT x.time AS a, y.time AS b, round(len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items) - len(list_intersect(x.items, y.items))), 6) + 0.0 AS jaccard FROM s x JOIN s y ON x.time < y.time""",
)
def set_agreement(spark, sf_dir):
    links = a.trade(spark, sf_dir).tables[("time", "edge")]
    sets = links.groupBy(F.col("time").cast("long").alias("time")).agg(F.collect_set(F.col("link_0") * 100 + F.col("link_1")).alias("items"))
    return secondary.jaccard(sets, "time", "items")


_PATHS = "(SELECT c_custkey AS path_id, c_mktsegment AS micro, concat('n', c_nationkey % 5) AS meso, concat('r', c_nationkey % 3) AS macro, CASE WHEN c_acctbal > 5000 THEN 'increase' ELSE 'decrease' END AS d1, CASE WHEN c_custkey % 2 = 0 THEN 'increase' ELSE 'decrease' END AS d2 FROM customer)"


@query(
    "path_projection",
    f"""WITH p AS {_PATHS}, e AS (SELECT path_id, macro, micro AS source, meso AS target, d1 AS d FROM p UNION ALL SELECT path_id, macro, meso, macro, d2 FROM p)
     SELECT source, target, CASE WHEN min(d) = max(d) THEN min(d) ELSE 'mixed' END AS direction, count(DISTINCT macro) AS n_groups, count(DISTINCT path_id) AS n_paths FROM e GROUP BY source, target""",
)
def path_projection(spark, sf_dir):
    a.read(spark, sf_dir, "customer").createOrReplaceTempView("driftline_customer")
    paths = spark.sql(_PATHS.strip("()").replace("FROM customer", "FROM driftline_customer")).withColumnsRenamed({"d1": "micro_meso_direction", "d2": "meso_macro_direction"})
    found = secondary.edges_of_paths(paths)
    return found.select("source", "target", "direction", F.size("groups").cast("long").alias("n_groups"), F.size("path_ids").cast("long").alias("n_paths"))


_EFF = """eff AS (SELECT p_brand AS parameter, CASE WHEN p_size % 2 = 0 THEN 'plus' ELSE 'minus' END AS direction, concat('v', p_partkey % 6) AS node_id,
 CASE WHEN min(p_partkey) % 17 = 0 THEN NULL ELSE CAST(avg(p_size) - 25 AS DOUBLE) END AS effect, CAST(max(p_partkey) % 6 AS INTEGER) - 1 AS onset, min(p_partkey) % 7 <> 0 AS moved FROM {part} GROUP BY 1, 2, 3)"""
_ROLES = {"v0": "micro", "v1": "micro", "v2": "meso", "v3": "meso", "v4": "macro", "v5": "macro"}
_EDGES = [("v0", "v2", "macro_outcome_v4", 1, 0.4), ("v1", "v3", "macro_outcome_v5", 2, -0.3), ("v2", "v4", "macro_outcome_v4", 1, 0.2), ("v3", "v5", "macro_outcome_v5", 3, 0.5), ("v4", "v5", "macro_outcome_v5", 1, 0.1)]
_MIDS = [("v0", "v2", "v4"), ("v1", "v3", "v5"), ("v1", "v2", "v4")]


def _decision_inputs(spark, sf_dir):
    a.read(spark, sf_dir, "part").createOrReplaceTempView("driftline_part")
    eff = spark.sql("WITH " + _EFF.format(part="driftline_part") + " SELECT parameter, direction, node_id, effect AS cumulative_effect_standardised, onset AS onset_time, moved AS significant FROM eff")
    edges = spark.createDataFrame([(*e, 0.01, 0.9) for e in _EDGES], "source string, target string, group string, lag int, beta double, q double, support double")
    scales = spark.createDataFrame(list(_ROLES.items()), "node_id string, scale string")
    roots = eff.select("parameter").distinct().crossJoin(spark.createDataFrame([("v0",), ("v1",)], "root string"))
    paths = spark.createDataFrame(_MIDS, "micro string, meso string, macro string")
    directions = spark.createDataFrame([("minus",), ("plus",)], "direction string")
    routes = effects.manipulation_routes(edges, scales, roots, paths)
    return eff, edges, paths, effects.attempts(edges, routes, eff, directions, 2)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


_ATTEMPTS = f"""{_EFF.format(part="part")}, edges(source, target, grp, lag, beta) AS (VALUES {_values(_EDGES)}), roles(node_id, scale) AS (VALUES {_values(_ROLES.items())}),
 mids(micro, meso, macro) AS (VALUES {_values(_MIDS)}), pars AS (SELECT DISTINCT parameter FROM eff),
 typed AS (SELECT e.*, s.scale AS ss, t.scale AS ts FROM edges e JOIN roles s ON s.node_id = source JOIN roles t ON t.node_id = target),
 routes AS (SELECT DISTINCT source, target, root, parameter FROM (SELECT source, target, source AS root FROM typed WHERE ss = 'micro' AND ts = 'meso'
   UNION ALL SELECT source, target, micro FROM typed JOIN mids ON meso = source AND macro = target WHERE ss = 'meso' AND ts = 'macro') CROSS JOIN pars),
 tried AS (SELECT e.grp, e.source, e.target, r.root, r.parameter, d.direction, e.lag, e.beta, x.effect AS re, x.onset AS ro, x.moved AS rm, y.effect AS se, y.onset AS so, y.moved AS sm, z.effect AS te, z.onset AS t_o, z.moved AS tm,
   x.node_id IS NOT NULL AND y.node_id IS NOT NULL AND z.node_id IS NOT NULL AS there
   FROM edges e LEFT JOIN routes r USING (source, target) LEFT JOIN (VALUES ('minus'), ('plus')) d(direction) ON r.parameter IS NOT NULL
   LEFT JOIN eff x ON x.parameter = r.parameter AND x.direction = d.direction AND x.node_id = r.root
   LEFT JOIN eff y ON y.parameter = r.parameter AND y.direction = d.direction AND y.node_id = e.source
   LEFT JOIN eff z ON z.parameter = r.parameter AND z.direction = d.direction AND z.node_id = e.target),
 att AS (SELECT *, CASE WHEN parameter IS NULL THEN 'not_applicable' WHEN NOT there OR re IS NULL THEN 'inconclusive' WHEN NOT rm THEN 'manipulation_failure'
   WHEN se IS NULL OR te IS NULL THEN 'inconclusive' WHEN NOT sm OR NOT tm THEN 'no_stable_downstream_effect' WHEN so >= 0 AND t_o >= so THEN 'supported' ELSE 'inconclusive' END AS cls FROM tried)"""


@query(
    "edge_attempts",
    f'WITH {_ATTEMPTS} SELECT grp AS "group", source, target, root, parameter, direction, cls AS primary_class, CAST(CASE WHEN there AND so >= 0 AND t_o >= 0 THEN t_o - so END AS INTEGER) AS intervention_delay FROM att',
)
def edge_attempts(spark, sf_dir):
    return _decision_inputs(spark, sf_dir)[3].select("group", "source", "target", "root", "parameter", "direction", "primary_class", "intervention_delay")


_EVIDENCE = """CASE WHEN count(*) FILTER (cls <> 'not_applicable') = 0 THEN 'not_applicable' WHEN bool_or(cls = 'directionally_contradicted') THEN 'directionally_contradicted' WHEN bool_or(cls = 'supported') THEN 'supported'
 WHEN count(*) FILTER (cls = 'manipulation_failure') = count(*) FILTER (cls <> 'not_applicable') THEN 'manipulation_failure' WHEN bool_or(cls = 'no_stable_downstream_effect') THEN 'no_stable_downstream_effect' ELSE 'inconclusive' END"""


@query(
    "edge_evidence",
    f"""WITH {_ATTEMPTS} SELECT grp AS "group", source, target, coalesce(parameter, '') AS parameter, {_EVIDENCE} AS edge_class, count(*) AS attempt_count, count(*) FILTER (cls <> 'not_applicable') AS applicable_attempt_count,
     count(*) FILTER (cls = 'supported') AS supported_attempt_count, count(*) FILTER (cls = 'directionally_contradicted') AS contradiction_attempt_count FROM att GROUP BY 1, 2, 3, 4""",
)
def edge_evidence(spark, sf_dir):
    tried = _decision_inputs(spark, sf_dir)[3].withColumn("parameter", F.coalesce("parameter", F.lit("")))
    return effects.edge_evidence(tried, ["group", "source", "target", "parameter"])


def _classified(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    eff, edges, paths, tried = _decision_inputs(spark, sf_dir)
    known = eff.select("parameter", "direction").distinct()
    named = paths.crossJoin(known).select(
        F.concat_ws(":", "parameter", "direction", "micro", "meso", "macro").alias("path_id"), "parameter", "direction", "micro", "meso", "macro",
        F.lit("increase").alias("expected_micro"), F.lit("decrease").alias("expected_meso"), F.lit("increase").alias("expected_macro"),
    )
    qualified = effects.qualified_paths(named, edges)
    return qualified, effects.classify_paths(qualified, tried)


_CLASSIFIED = f"""{_ATTEMPTS}, known AS (SELECT DISTINCT parameter, direction FROM eff), named AS (SELECT *, concat('macro_outcome_', macro) AS grp FROM mids CROSS JOIN known),
 q AS (SELECT n.*, EXISTS (SELECT 1 FROM edges e WHERE e.source = micro AND e.target = meso AND e.grp = n.grp) AND EXISTS (SELECT 1 FROM edges e WHERE e.source = meso AND e.target = macro AND e.grp = n.grp) AS qualified FROM named n),
 k AS (SELECT q.*, coalesce(a.rm AND a.re IS NOT NULL AND a.there, false) AS ok1, coalesce(a.tm AND a.there, false) AS ok2, coalesce(b.tm AND b.there, false) AS ok3, a.re AS e1, a.te AS e2, b.te AS e3,
   CASE WHEN a.there THEN a.ro END AS o1, CASE WHEN a.there THEN a.t_o END AS o2, CASE WHEN b.there THEN b.t_o END AS o3
   FROM q LEFT JOIN att a ON a.parameter = q.parameter AND a.direction = q.direction AND a.root = micro AND a.source = micro AND a.target = meso AND a.grp = q.grp
   LEFT JOIN att b ON b.parameter = q.parameter AND b.direction = q.direction AND b.root = micro AND b.source = meso AND b.target = macro AND b.grp = q.grp),
 verdict AS (SELECT *, CASE WHEN NOT qualified THEN 'inconclusive' WHEN NOT ok1 THEN 'manipulation_failure' WHEN NOT (ok2 AND ok3 AND e1 IS NOT NULL AND e2 IS NOT NULL AND e3 IS NOT NULL) THEN 'inconclusive'
   WHEN NOT (e1 > 0 AND e2 < 0 AND e3 > 0) THEN 'contradicted' WHEN coalesce(o1 >= 0 AND o2 >= o1 AND o3 >= o2, false) THEN 'supported' ELSE 'inconclusive' END AS cls2 FROM k)"""


@query("path_classification", f"WITH {_CLASSIFIED} SELECT concat_ws(':', parameter, direction, micro, meso, macro) AS path_id, qualified AS path_temporally_qualified, cls2 AS path_classification FROM verdict")
def path_classification(spark, sf_dir):
    return _classified(spark, sf_dir)[1].select("path_id", "path_temporally_qualified", "path_classification")


@query(
    "path_funnel",
    f"""WITH {_CLASSIFIED} SELECT direction, count(*) AS candidates, count(*) FILTER (qualified) AS qualified, round(count(*) FILTER (qualified) / count(*), 6) + 0.0 AS qualified_rate, count(*) FILTER (cls2 = 'supported') AS supported,
     round(count(*) FILTER (cls2 = 'supported') / count(*), 6) + 0.0 AS supported_rate, count(*) FILTER (cls2 = 'contradicted') AS contradicted, round(count(*) FILTER (cls2 = 'contradicted') / count(*), 6) + 0.0 AS contradicted_rate FROM verdict GROUP BY direction""",
)
def path_funnel(spark, sf_dir):
    return secondary.path_funnel(_classified(spark, sf_dir)[1], ["direction"])


@query(
    "holdout_confirmation",
    f"""WITH {_CLASSIFIED}, h AS (SELECT * FROM verdict WHERE length(parameter) % 2 = 0 OR micro = 'v0')
     SELECT f.parameter, f.direction, f.micro, f.meso, f.macro, CASE h.cls2 WHEN 'supported' THEN 'confirmed' WHEN 'manipulation_failure' THEN 'manipulation_failure' WHEN 'contradicted' THEN 'failed_confirmation' ELSE 'inconclusive' END AS confirmation
     FROM named f LEFT JOIN h USING (parameter, direction, micro, meso, macro)""",
)
def holdout_confirmation(spark, sf_dir):
    qualified, verdicts = _classified(spark, sf_dir)
    keys = ["parameter", "direction", "micro", "meso", "macro"]
    return secondary.confirm_holdout(qualified.select(*keys), verdicts.filter("length(parameter) % 2 = 0 OR micro = 'v0'"), keys)


@query(
    "attenuation",
    """WITH m AS (SELECT l_suppkey % 10 AS seed, avg(l_discount) FILTER (l_linestatus = 'F') - 0.05 AS b, avg(l_discount) FILTER (l_linestatus = 'O') - 0.05 AS d FROM lineitem GROUP BY 1)
     SELECT seed, round(b, 6) + 0.0 AS baseline, round(d, 6) + 0.0 AS disabled, round(abs(d) / abs(b), 6) + 0.0 AS retained, round(1 - abs(d) / abs(b), 6) + 0.0 AS attenuation FROM m""",
)
def attenuation(spark, sf_dir):
    t = a.read(spark, sf_dir, "lineitem")
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount"))) - 0.05
    m = t.groupBy((F.col("l_suppkey") % 10).alias("seed")).agg(mean("F").alias("baseline"), mean("O").alias("disabled"))
    return secondary.attenuation(m, ["seed"])


@query("top_effects", f"WITH {FLAGS}, s AS (SELECT direction, node_id, seed, avg(d) AS d FROM paired GROUP BY 1, 2, 3) SELECT direction, node_id, seed, round(d, 6) + 0.0 AS d FROM s ORDER BY abs(d) DESC, direction, node_id, seed LIMIT 10")
def top_effects(spark, sf_dir):
    s = _pairs(spark, sf_dir).groupBy("direction", "node_id", "seed").agg(F.avg("difference").alias("d"))
    return s.orderBy(F.abs("d").desc(), "direction", "node_id", "seed").limit(10)


@query(
    "pivot_conditions",
    f"WITH {FLAGS} SELECT node_id, time, round(avg(value) FILTER (direction = 'A'), 6) + 0.0 AS \"A\", round(avg(value) FILTER (direction = 'N'), 6) + 0.0 AS \"N\", round(avg(value) FILTER (direction = 'R'), 6) + 0.0 AS \"R\" FROM runs GROUP BY node_id, time",
)
def pivot_conditions(spark, sf_dir):
    return a.flag_runs(spark, sf_dir).groupBy("node_id", F.col("time").cast("long").alias("time")).pivot("direction", ["A", "N", "R"]).agg(F.avg("value"))


@query(
    "path_timing",
    f"""WITH {_CLASSIFIED}, lagged AS (SELECT q.*, (SELECT lag FROM edges e WHERE e.source = micro AND e.target = meso AND e.grp = q.grp) AS l1, (SELECT lag FROM edges e WHERE e.source = meso AND e.target = macro AND e.grp = q.grp) AS l2 FROM q WHERE qualified),
     three AS (SELECT l.*, a.onset AS o1, b.onset AS o2, c.onset AS o3 FROM lagged l JOIN eff a ON a.parameter = l.parameter AND a.direction = l.direction AND a.node_id = micro
       JOIN eff b ON b.parameter = l.parameter AND b.direction = l.direction AND b.node_id = meso JOIN eff c ON c.parameter = l.parameter AND c.direction = l.direction AND c.node_id = macro),
     flat AS (SELECT *, concat_ws(':', parameter, direction, micro, meso, macro) AS path_id FROM three)
     SELECT path_id, 'micro' AS scale, o1 AS onset_time, CAST(NULL AS INTEGER) AS response_delay, CAST(NULL AS BOOLEAN) AS concordant FROM flat
     UNION ALL SELECT path_id, 'meso', o2, CASE WHEN o1 >= 0 AND o2 >= 0 THEN o2 - o1 END, CASE WHEN o1 >= 0 AND o2 >= 0 THEN abs(o2 - o1 - l1) <= 2 END FROM flat
     UNION ALL SELECT path_id, 'macro', o3, CASE WHEN o2 >= 0 AND o3 >= 0 THEN o3 - o2 END, CASE WHEN o2 >= 0 AND o3 >= 0 THEN abs(o3 - o2 - l2) <= 2 END FROM flat""",
)
def path_timing(spark, sf_dir):
    eff, _, _, _ = _decision_inputs(spark, sf_dir)
    qualified, _ = _classified(spark, sf_dir)
    return secondary.path_timing(qualified, eff, 2).select("path_id", "scale", "onset_time", "response_delay", "concordant")


@query("propagating_paths")
def propagating_paths(spark, sf_dir):
    eff, _, _, tried = _decision_inputs(spark, sf_dir)
    qualified, _ = _classified(spark, sf_dir)
    evidence = effects.edge_evidence(tried.filter("root IS NOT NULL"), ["parameter", "direction", "root", "source", "target"])
    paths = qualified.select("path_id", "parameter", "direction", "micro", "meso", "macro")
    return secondary.propagating_paths(secondary.path_timing(qualified, eff, 2), evidence, paths)


@query(
    "representative_paths",
    f"""WITH {_CLASSIFIED}, v AS (SELECT *, concat_ws(':', parameter, direction, micro, meso, macro) AS path_id, direction = 'plus' AS confirmed FROM verdict),
     r AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY confirmed DESC, path_id) AS k FROM v WHERE cls2 = 'supported')
     SELECT p.parameter, r.path_id, r.confirmed FROM (SELECT DISTINCT parameter FROM v) p LEFT JOIN r ON r.parameter = p.parameter AND k = 1""",
)
def representative_paths(spark, sf_dir):
    v = _classified(spark, sf_dir)[1].withColumn("confirmation", F.when(F.col("direction") == "plus", "confirmed").otherwise("inconclusive"))
    return secondary.representatives(v, ["parameter"])


@query(
    "bidirectional_summary",
    f"""WITH {_ATTEMPTS.split(", edges(")[0]}, r(node_id, scale) AS (VALUES {_values([(k, v) for k, v in _ROLES.items() if k in ("v0", "v2", "v4")])}), e AS (SELECT * FROM eff JOIN r USING (node_id))
     SELECT parameter, {", ".join(f"round(max(effect) FILTER (direction = '{d}' AND scale = '{s}'), 6) + 0.0 AS {d}_{s}_cumulative_effect_standardised, coalesce(max(onset) FILTER (direction = '{d}' AND scale = '{s}'), -1) AS {d}_{s}_onset_time, coalesce(bool_or(moved) FILTER (direction = '{d}' AND scale = '{s}'), false) AS {d}_{s}_significant" for d in ("minus", "plus") for s in ("micro", "meso", "macro"))} FROM e GROUP BY parameter""",
)
def bidirectional_summary(spark, sf_dir):
    eff = _decision_inputs(spark, sf_dir)[0]
    roles = spark.createDataFrame([(k, v) for k, v in _ROLES.items() if k in ("v0", "v2", "v4")], "node_id string, scale string")
    return secondary.bidirectional(eff.join(roles, "node_id"), ["parameter"])


@query(
    "condition_means",
    f"""WITH {FLAGS}, m AS (SELECT node_id, seed, avg(value) FILTER (direction = 'A') AS b, avg(value) FILTER (direction = 'N') AS d FROM runs GROUP BY 1, 2)
     SELECT node_id, seed, round(b, 6) + 0.0 AS baseline, round(d, 6) + 0.0 AS disabled, round(d - b, 6) + 0.0 AS difference FROM m""",
)
def condition_means(spark, sf_dir):
    return secondary.node_means(a.flag_runs(spark, sf_dir), ["node_id", "seed"], "direction", "A", "N")


@query(
    "intervention_recovery",
    f"""WITH {TRADE}, t AS (SELECT u, v FROM edges WHERE time = 0), e AS (SELECT u, v FROM edges WHERE time IN (0, 1) AND u % 2 = 0), s AS (SELECT u, v FROM edges WHERE time = 1),
     c AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM s)) AS ts,
       (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM e)) AS te, (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM e INTERSECT SELECT * FROM s)) AS tes)
     SELECT round(ts / ns, 6) + 0.0 AS precision, round(ts / nt, 6) + 0.0 AS recall, round(tes / te, 6) + 0.0 AS eligible_recall FROM c""",
)
def intervention_recovery(spark, sf_dir):
    x, y = (g.select("source", "target") for g in _graphs(spark, sf_dir))
    return secondary.intervention_recovery(x, x.union(y).filter("source % 2 = 0"), y)


@query(
    "dose_effects",
    f"""WITH r AS (SELECT c_nationkey % 7 AS seed, year(o_orderdate) - 1995 AS time, CAST({_DOSE} AS DOUBLE) AS dose, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
     b AS (SELECT seed, time, value FROM r WHERE dose = 0 AND time >= 1), sd AS (SELECT stddev_samp(value) AS sd FROM b)
     SELECT 'price' AS node_id, dose, r.seed, round(avg(r.value - b.value), 6) + 0.0 AS effect, round(avg(r.value - b.value) / max(sd), 6) + 0.0 AS standardised FROM r JOIN b USING (seed, time), sd GROUP BY dose, r.seed""",
)
def dose_effects(spark, sf_dir):
    o, c = a.read(spark, sf_dir, "orders"), a.read(spark, sf_dir, "customer")
    r = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(
        F.lit("price").alias("node_id"), (F.col("c_nationkey") % 7).alias("seed"), (F.year("o_orderdate") - 1995).alias("time"), F.expr(f"CAST({_DOSE} AS DOUBLE)").alias("dose")
    )
    return secondary.dose_effects(r.agg(F.avg("o_totalprice").alias("value")), ["node_id"], 0.0, 1)


@query("bootstrap_means")
def bootstrap_means(spark, sf_dir):
    per = _pairs(spark, sf_dir).groupBy("direction", "node_id", "seed").agg(F.avg("difference").alias("d"))
    return secondary.bootstrap_mean(per, ["direction", "node_id"], "d", 200, 0.95, 0, "mean")


# ---- discovery -------------------------------------------------------------------------------

_LAG = 2


def _series(spark, sf_dir):
    # the event types, from their column alone
    nodes = sorted(r["event_type"] for r in a.read(spark, sf_dir, "events").select("event_type").distinct().collect())
    return a.trajectories(spark, sf_dir), discovery.all_pairs(nodes)


@query("point_graph")
def point_graph(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    return discovery.point_graph(s, pairs, _LAG, 0.5, 0.9)


@query("bootstrap_graph")
def bootstrap_graph(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    return discovery.bootstrap_graph(s, pairs, _LAG, 0.5, 0.9, 50, 0.2)[0]


@query("vote_graph")
def vote_graph(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    return discovery.vote_graph(s, pairs, _LAG, 0.5, 0.9, 0.1)


@query("single_graph")
def single_graph(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    return discovery.single_graph(s, pairs, _LAG, 0.5, 0.9)


@query("negative_control")
def negative_control(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    return secondary.negative_control(s, pairs, _LAG, 0.5, 0.9, 20, 0.1, 5, 12)


# ---- robustness, simulators, windows of time -------------------------------------------------


@query("noise_robustness")
def noise_robustness(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    return discovery.bootstrap_graph(robustness.add_noise(s, 0.2, 0), pairs, _LAG, 0.5, 0.9, 20, 0.2)[0]


@query("missing_robustness")
def missing_robustness(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    return discovery.bootstrap_graph(robustness.drop_values(s, 0.1, 0), pairs, _LAG, 0.5, 0.9, 20, 0.2)[0]


@query("corrupted_candidates")
def corrupted_candidates(spark, sf_dir):
    s, pairs = _series(spark, sf_dir)
    out, added = robustness.corrupt(pairs, "redundant_semantic_indicator", 0.1, 0)
    return discovery.point_graph(robustness.add_series(s, added, 0), out, _LAG, 0.5, 0.9)


@query("simulated_segregation")
def simulated_segregation(spark, sf_dir):
    tasks = simulators.task_matrix({"tolerance": (0.2, 0.4, 0.6)}, range(3), doses=2)
    runs = simulators.simulate(spark, "segregation", tasks, {"steps": 12, "side": 9, "agents": 60})
    return runs.groupBy("condition", "seed", "time").agg(F.avg("similarity").alias("similarity"), F.avg(F.col("unhappy").cast("double")).alias("unhappy"))


@query("simulated_opinions")
def simulated_opinions(spark, sf_dir):
    tasks = simulators.task_matrix({"bound": (0.2, 0.4, 0.6), "rate": (0.1, 0.3, 0.5)}, range(2), doses=2)
    runs = simulators.simulate(spark, "opinions", tasks, {"steps": 10, "agents": 24, "degree": 4})
    return runs.groupBy("condition", "seed", "time").agg(F.stddev_pop("opinion").alias("spread"), F.avg(F.col("accepted").cast("double")).alias("accepted"))


@query(
    "windowed_reducers",
    """SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, round(avg(value), 6) + 0.0 AS mean, round(sum(value), 6) + 0.0 AS sum, count(value) AS count,
     round(var_pop(value), 6) + 0.0 AS variance, round(stddev_pop(value), 6) + 0.0 AS std FROM events GROUP BY 1, 2""",
)
def daily_reducers(spark, sf_dir):
    e = a.read(spark, sf_dir, "events")
    found = windowed_reducers(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))
