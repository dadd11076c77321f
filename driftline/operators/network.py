"""Grids and graphs: joins where a relation says it, grouped functions for connected components of blocks and tiles only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.nulls import TINY, correlation, group_reducer
from driftline.operators.components import kept, least_reachable, stars

#: Side of the squares of a grid that a task joins at once.
TILE = 1 << 10


def both_ways(edges: DataFrame, keys) -> DataFrame:
    """Edges (keys, u, v) with each one in both directions."""
    return edges.select(*keys, "u", "v").union(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))


def faulty_edges(edges: DataFrame, keys, nodes: DataFrame | None = None) -> DataFrame:
    """keys, u, v, fault: loops, missing or negative ends, undirected repeats and ends beyond nodes (keys, node_count)."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    simple = edges.select(*keys, "u", "v").withColumn(
        "fault",
        F.when(F.col("u").isNull() | F.col("v").isNull() | (F.col("u") < 0) | (F.col("v") < 0), "invalid end").when(
            F.col("u") == F.col("v"), "loop"
        ),
    )
    found = simple.filter("fault IS NOT NULL")
    whole = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    repeated = whole.groupBy(*keys, low.alias("u"), high.alias("v")).agg(F.count("*").alias("n")).filter("n > 1")
    found = found.union(repeated.select(*keys, "u", "v", F.lit("duplicate undirected edge")))
    if nodes is not None:
        on = [k for k in keys if k in nodes.columns]
        far = whole.join(nodes, on).filter(high >= F.col("node_count"))
        found = found.union(far.select(*keys, "u", "v", F.lit("end beyond the nodes")))
    return found


def require_sound_edges(edges: DataFrame, keys, nodes: DataFrame | None = None) -> None:
    first = faulty_edges(edges, keys, nodes).head(1)
    if first:
        raise ValueError(f"{first[0]['fault']}: {first[0].asDict()}")


def neighbourhood(values: DataFrame, edges: DataFrame, keys, ops, value: str = "value", dynamic: bool = True) -> DataFrame:
    """keys, time, agent and a column for each of ops, over the values of a node's neighbours; missing without any (count 0).

    One join and one aggregation, however many ops.
    """
    at = [*keys, "time"] if dynamic else list(keys)
    theirs = values.select(*keys, "time", F.col("agent").alias("v"), F.col(value).alias("_x"))
    found = both_ways(edges, at).join(theirs, [*at, "v"]).groupBy(*keys, "time", F.col("u").alias("agent"))
    reduced = found.agg(*[group_reducer(op, F.col("_x")).alias(f"_{op}") for op in ops])
    out = [(F.coalesce("_count", F.lit(0.0)) if op == "count" else F.col(f"_{op}")).alias(op) for op in ops]
    return values.select(*keys, "time", "agent").join(reduced, [*keys, "time", "agent"], "left").select(*keys, "time", "agent", *out)


def assortativity(values: DataFrame, edges: DataFrame, keys, value: str = "value", dynamic: bool = True) -> DataFrame:
    """keys, time, value: correlation of the values at both ends of each edge; 0 without edges or variation."""
    at = [*keys, "time"] if dynamic else list(keys)
    own = values.select(*keys, "time", F.col("agent").alias("u"), F.col(value).alias("_x"))
    other = values.select(*keys, "time", F.col("agent").alias("v"), F.col(value).alias("_y"))
    pairs = both_ways(edges, at).join(own, [*at, "u"]).join(other, [*keys, "time", "v"])
    x, y = F.col("_x"), F.col("_y")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    flat = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) <= TINY) | (F.coalesce(F.stddev_pop(y), F.lit(0.0)) <= TINY)
    found = pairs.groupBy(*keys, "time").agg(F.when(flat, 0.0).otherwise(correlation(x, y)).alias("_r"))
    return (
        values.select(*keys, "time").distinct().join(found, [*keys, "time"], "left").select(*keys, "time", F.coalesce("_r", F.lit(0.0)).alias(value))
    )


def density(edges: DataFrame, nodes: DataFrame, keys, at) -> DataFrame:
    """at, value: edges over possible edges; nodes: (keys, node_count). at: the keys, with time where edges move."""
    n = F.col("node_count")
    return (
        edges.groupBy(*at).agg(F.count("*").alias("_e")).join(nodes, list(keys)).select(*at, (2.0 * F.col("_e") / F.greatest(n * (n - 1), F.lit(1.0))).alias("value"))
    )


def grid_similarity(grid: DataFrame, keys, value: str = "value") -> DataFrame:
    """keys, time, value: share of equal groups over occupied neighbour pairs of a torus; 1 without a pair.

    Each cell meets the cell before it in both directions, one equi-join each.
    """
    at = [*keys, "time"]
    size = grid.groupBy(*at).agg((F.max("grid_y") + 1).alias("_h"), (F.max("grid_x") + 1).alias("_w"))
    cells = grid.join(size, at).filter(F.col(value) >= 0)
    pairs = None
    for dy, dx in ((1, 0), (0, 1), (-1, 0), (0, -1)):
        moved = cells.select(
            *at,
            F.pmod(F.col("grid_y") + dy, F.col("_h")).alias("grid_y"),
            F.pmod(F.col("grid_x") + dx, F.col("_w")).alias("grid_x"),
            F.col(value).alias("_o"),
        )
        pairs = moved if pairs is None else pairs.union(moved)
    met = (
        cells.join(pairs, [*at, "grid_y", "grid_x"]).groupBy(*at).agg(F.avg((F.col(value) == F.col("_o")).cast("double")).alias("_s"))
    )
    return size.select(*at).join(met, at, "left").select(*at, F.coalesce("_s", F.lit(1.0)).alias("value"))


def grid_components(grid: DataFrame, keys, value: str = "value", tile: int | None = None) -> DataFrame:
    """keys, time, components, largest: same-group components of a torus without vacancies, and the largest's share.

    A task joins the cells of one tile; tiles are joined over the cells along their borders.
    """
    at, tile = [*keys, "time"], tile or TILE
    rows = grid.select(*at, F.col("grid_y").cast("long").alias("y"), F.col("grid_x").cast("long").alias("x"), F.col(value).cast("double").alias("g"))
    size = rows.groupBy(*at).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    live = rows.filter(~F.isnan("g") & (F.col("g") >= 0)).join(size, at)

    def run(table: pa.Table) -> pa.Table:
        y, x, g = (table[c].combine_chunks().to_numpy() for c in ("y", "x", "g"))
        h, w = table["h"][0].as_py(), table["w"][0].as_py()
        whole, top, left = h <= tile and w <= tile, y.min() // tile * tile, x.min() // tile * tile
        full = np.full((min(tile, h - top), min(tile, w - left)), -1.0)
        full[y - top, x - left] = g
        ids, a, b = np.arange(full.size).reshape(full.shape), [], []
        for axis in (0, 1):
            same = (full == np.roll(full, -1, axis)) & (full >= 0)
            if not whole:  # the torus closes over other tiles
                np.moveaxis(same, axis, 0)[-1] = False
            a.append(ids[same])
            b.append(np.roll(ids, -1, axis)[same])
        root = least_reachable(full.size, np.concatenate(a), np.concatenate(b))
        far = (top + root // full.shape[1]) * w + left + root % full.shape[1]
        inner = root[full.ravel() >= 0]
        own, n = np.unique(inner, return_counts=True)
        edge = np.zeros(full.shape, bool)
        if not whole:
            edge[[0, -1]] = edge[:, [0, -1]] = True
        ey, ex = np.nonzero(edge & (full >= 0))
        none, many = [None] * len(own), len(own) + len(ey)
        return pa.table(
            {c: pa.array([table[c][0].as_py()] * many, table.schema.field(c).type) for c in [*at, "h", "w"]}
            | {
                "root": pa.array([*far[own].tolist(), *far[ids[ey, ex]].tolist()], pa.int64()),
                "n": pa.array([*n.tolist(), *[None] * len(ey)], pa.int64()),
                "y": pa.array([*none, *(ey + top).tolist()], pa.int64()),
                "x": pa.array([*none, *(ex + left).tolist()], pa.int64()),
                "g": pa.array([*none, *full[ey, ex].tolist()], pa.float64()),
            }
        )

    fields = ", ".join(f"{c} {grid.schema[c].dataType.simpleString()}" for c in at)
    tiles = live.groupBy(*at, F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx"))
    parts = kept(tiles.applyInArrow(run, f"{fields}, h long, w long, root long, n long, y long, x long, g double"), "tiles")
    pieces = parts.filter("n IS NOT NULL").select(*at, "root", "n")
    border = parts.filter("n IS NULL")
    if not border.isEmpty():
        other = border.select(*at, "y", "x", "g", F.col("root").alias("b"))
        right = border.select(*at, "y", F.pmod(F.col("x") + 1, "w").alias("x"), "g", F.col("root").alias("a"))
        below = border.select(*at, F.pmod(F.col("y") + 1, "h").alias("y"), "x", "g", F.col("root").alias("a"))
        links = right.union(below).join(other, [*at, "y", "x", "g"]).filter("a <> b").select(*at, "a", "b").distinct()
        joined = stars(links, at).withColumnRenamed("root", "_to").withColumnRenamed("node", "root")
        pieces = pieces.join(joined, [*at, "root"], "left").groupBy(*at, F.coalesce("_to", "root").alias("root")).agg(F.sum("n").alias("n"))
    found = pieces.groupBy(*at).agg(F.count("*").cast("double").alias("_c"), (F.max("n") / F.sum("n")).alias("_l"))
    return size.select(*at).join(found, at, "left").select(*at, F.coalesce("_c", F.lit(0.0)).alias("components"), F.coalesce("_l", F.lit(0.0)).alias("largest"))


def graph_components(edges: DataFrame, nodes: DataFrame, keys, block: int | None = None) -> DataFrame:
    """keys, time, components, largest: of a graph's nodes 0 .. node_count - 1, isolated ones included."""
    at = [*keys, "time"]
    rows = edges.join(nodes, list(keys)).select(*at, F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"), F.col("node_count").cast("long").alias("node_count"))
    graphs = rows.groupBy(*at).agg(F.max("node_count").alias("_n"))
    sizes = stars(rows.select(*at, "a", "b"), at, block).groupBy(*at, "root").agg((F.count("*") + 1).alias("_size"))
    joined = sizes.groupBy(*at).agg(F.sum(F.col("_size") - 1).alias("_less"), F.max("_size").alias("_most"))
    n = F.col("_n").cast("double")
    return graphs.join(joined, at, "left").select(*at, (n - F.coalesce("_less", F.lit(0))).alias("components"), (F.coalesce("_most", F.lit(1)) / n).alias("largest"))
