"""Tables of the star schema as named-dimension data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.nulls import clean
from driftline.operators.tensor import Dataset
from driftline.plans.grammar import TensorType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (event type), time (day), agent (user), x (mean value), n (events), g (one of five groups)."""
    e = read(spark, sf_dir, "events").select("event_type", "ts", "user_id", clean(F.col("value")).alias("value"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    cells = e.groupBy(F.col("event_type").alias("run"), day.alias("time"), F.col("user_id").alias("agent")).agg(F.avg("value").alias("x"), F.count("*").alias("n"))
    return cells.withColumn("g", F.col("agent") % 5)


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    at = ("time", "agent")
    fields = {"x": TensorType("numeric", at), "n": TensorType("integer", at), "g": TensorType("integer", at)}
    return Dataset(("run",), {at: event_cells(spark, sf_dir)}, fields)


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (return flag), time (month), agent (supplier), quantity, price, discount: means."""
    t = read(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    return t.groupBy(F.col("l_returnflag").alias("run"), month.alias("time"), F.col("l_suppkey").alias("agent")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount")
    )


def lineitems(spark: SparkSession, sf_dir: str) -> Dataset:
    at = ("time", "agent")
    return Dataset(("run",), {at: lineitem_cells(spark, sf_dir)}, {c: TensorType("numeric", at) for c in ("quantity", "price", "discount")})


#: Sides of the grid that suppliers and parts are dealt to.
SIDE = 10


def grid(spark: SparkSession, sf_dir: str) -> Dataset:
    """A torus for each year: a cell is -1 without enough items, else whether its mean discount is over a twentieth."""
    t = read(spark, sf_dir, "lineitem")
    cell = [(F.year("l_shipdate") - 1992).alias("time"), (F.col("l_suppkey") % SIDE).alias("grid_y"), (F.col("l_partkey") % SIDE).alias("grid_x")]
    state = F.when(F.count("*") % 7 == 0, -1).when(F.avg("l_discount") > 0.05, 1).otherwise(0)
    df = t.groupBy(*cell).agg(state.cast("int").alias("state")).withColumn("run", F.lit("all"))
    at = ("time", "grid_y", "grid_x")
    return Dataset(("run",), {at: df}, {"state": TensorType("integer", at)})


def trade(spark: SparkSession, sf_dir: str) -> Dataset:
    """A graph of nations for each year: edges where fewer items than the year's mean went between customers and suppliers; balance: mean order price.

    Items are counted by order and supplier before either meets its nation.
    """
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.year("o_orderdate") - 1995).alias("time"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = o.join(c, o["o_custkey"] == c["c_custkey"])
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    sold = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("k"))
    ends = placed.select("o_orderkey", "time", "c_nationkey").join(sold, F.col("o_orderkey") == F.col("l_orderkey"))
    u, v = F.least("c_nationkey", "s_nationkey"), F.greatest("c_nationkey", "s_nationkey")
    edges = ends.filter("c_nationkey <> s_nationkey").groupBy("time", u.alias("link_0"), v.alias("link_1")).agg(F.sum("k").alias("n"))
    edges = edges.withColumn("mean", F.avg("n").over(Window.partitionBy("time")))
    edges = edges.filter("n < mean").select(F.lit("all").alias("run"), "time", "link_0", "link_1")
    nodes = placed.groupBy(F.lit("all").alias("run"), "time", F.col("c_nationkey").alias("agent")).agg(F.avg("o_totalprice").alias("balance"))
    count = read(spark, sf_dir, "nation").agg(F.count("*").alias("nations")).withColumn("run", F.lit("all"))
    return Dataset(
        ("run",),
        {("time", "edge"): edges, ("time", "agent"): nodes, (): count},
        {"link": TensorType("integer", ("time", "edge", "endpoint")), "balance": TensorType("numeric", ("time", "agent")), "nations": TensorType("integer")},
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (event type), time (day), value: mean over users of their mean values."""
    return event_cells(spark, sf_dir).groupBy("run", "time").agg(F.avg("x").alias("value"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed (user mod 10), time (day), node_id (event type), value: trajectories of several indicators."""
    cells = event_cells(spark, sf_dir)
    return cells.groupBy((F.col("agent") % 10).alias("seed"), "time", F.col("run").alias("node_id")).agg(F.avg("x").alias("value"))


def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, direction (return flag), seed (supplier mod 10), time (quarter), node_id, value."""
    t = read(spark, sf_dir, "lineitem")
    quarter = (F.year("l_shipdate") - 1992) * 4 + F.quarter("l_shipdate") - 1
    means = t.groupBy(F.col("l_returnflag").alias("direction"), (F.col("l_suppkey") % 10).alias("seed"), quarter.alias("time")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount")
    )
    return means.select(
        "direction", "seed", "time", F.expr("stack(2, 'quantity', quantity, 'discount', discount) AS (node_id, value)")
    )


def city(spark: SparkSession, sf_dir: str) -> Dataset:
    """The fields of a segregation run: users as agents, their events as what befalls them, and the torus of grid()."""
    x, agent, moved = F.col("x"), F.col("agent"), (F.col("n") > 1) | (F.col("x") > 80.003)
    df = event_cells(spark, sf_dir).select(
        "run", "time", "agent",
        (agent % 2).alias("agent_group"), (agent % 6).alias("district_id"), ((agent * 7 + F.col("time")) % 9).alias("neighbour_count"),
        (x < 30.003).alias("unhappy"), moved.alias("moved"), ((agent + F.col("time")) % 3 == 0).alias("boundary_agent"),
        F.least(x / 100, F.lit(1.0)).alias("local_similarity"),
        F.when(moved, (agent % 7) / 7).otherwise(0.0).alias("move_distance"), F.when(moved, F.least(x / 150, F.lit(1.0))).alias("destination_similarity"),
    )
    at, torus = ("time", "agent"), ("time", "grid_y", "grid_x")
    kinds = dict.fromkeys(("agent_group", "district_id", "neighbour_count"), "integer") | dict.fromkeys(("unhappy", "moved", "boundary_agent"), "bool")
    fields = {c: TensorType(kinds.get(c, "numeric"), at) for c in df.columns[3:]}
    cells = grid(spark, sf_dir).tables[torus].withColumnRenamed("state", "state_grid")
    return Dataset(("run",), {at: df, torus: cells}, fields | {"state_grid": TensorType("integer", torus)})


def circle(spark: SparkSession, sf_dir: str) -> Dataset:
    """The fields of an opinion run: nations as agents, their mean order price as opinion, the graph of trade()."""
    t = trade(spark, sf_dir)
    x, agent, at, ties = F.col("balance"), F.col("agent"), ("time", "agent"), ("time", "edge")
    accepted, backfire = x > 145000.0003, (agent + F.col("time")) % 5 == 0
    distance = F.abs(x / 150000 - 1)
    df = t.tables[at].select(
        "run", "time", "agent",
        F.greatest(F.least((x - 150000) / 30000, F.lit(1.0)), F.lit(-1.0)).alias("state_opinion"),
        accepted.alias("interaction_accepted"), backfire.alias("interaction_backfire"), (~accepted & ~backfire).alias("interaction_rejected"),
        ((agent * 3 + F.col("time")) % 4 == 0).alias("edge_rewired"), ((agent + F.col("time") * 2) % 7 == 0).alias("sign_flip"),
        distance.alias("interaction_distance"), (distance / 2 - 0.03).alias("agent_shift"),
    )
    numeric = {"state_opinion", "interaction_distance", "agent_shift"}
    edges = t.tables[ties].withColumnsRenamed({f"link_{i}": f"network_edges_{i}" for i in range(2)})
    return Dataset(
        ("run",),
        {at: df, ties: edges, (): t.tables[()].withColumnRenamed("nations", "agent_count")},
        {c: TensorType("numeric" if c in numeric else "bool", at) for c in df.columns[3:]}
        | {"network_edges": TensorType("integer", ("time", "edge", "endpoint")), "agent_count": TensorType("integer")},
    )
