"""Connected components of many graphs in one job, however large each is.

Links are dealt to blocks of at most BLOCK; a task keeps a spanning star of each component of its block.
Graphs of one block are done then. Of the others the stars, far fewer than the links, shrink to one star
around the least node of each component by alternating large-star and small-star steps, each two
aggregations and joins over the links that are left; nothing comes to the driver but their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.sources.tables import scratch

#: Links that a task joins at once.
BLOCK = 1 << 20


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut at a copy that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node reachable from each of n nodes over links a-b: labels fall, and jump to their labels', until still."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _step(links: DataFrame, at: list[str]) -> DataFrame:
    """A large-star and a small-star step: nodes move to the least of their neighbours."""
    both = links.union(links.select(*at, F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(*at, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = both.filter("b > a").join(least, [*at, "a"]).filter("b <> m").select(*at, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy(*at, "a").agg(F.min("b").alias("m"))
    moved = large.join(low, [*at, "a"]).filter("b <> m").select(*at, F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return moved.union(low.select(*at, "a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame, at: list[str]) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64(*at, "a", "b").cast("decimal(38,0)"))).first())


def stars(links: DataFrame, at: list[str], block: int | None = None) -> DataFrame:
    """at, node, root of each node but the roots: root is the least node reachable over links (at, a, b: long).

    Links of a node to itself and repeated links count for nothing; nulls are dropped.
    """
    block = block or BLOCK
    links = links.filter("a <> b")
    blocks = links.groupBy(*at).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = links.join(blocks, at).withColumn("_block", F.pmod(F.xxhash64("a", "b"), F.col("_blocks")))

    def run(table: pa.Table) -> pa.Table:
        a, b = (table[c].combine_chunks().to_numpy() for c in ("a", "b"))
        ids, places = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = least_reachable(len(ids), places[: len(a)], places[len(a) :])
        own = np.flatnonzero(root != np.arange(len(ids)))
        same = {c: pa.array([table[c][0].as_py()] * len(own), table.schema.field(c).type) for c in [*at, "_blocks"]}
        return pa.table(same | {"a": ids[own], "b": ids[root[own]]})

    fields = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in at)
    found = dealt.groupBy(*at, "_block").applyInArrow(run, f"{fields}, _blocks long, a long, b long")
    found = kept(found, "stars")
    names = [*at, F.col("a").alias("node"), F.col("b").alias("root")]
    large = found.filter("_blocks > 1").select(*at, "a", "b")
    if large.isEmpty():
        return found.select(*names)
    before, now = None, large.distinct()
    while (mark := _mark(now, at)) != before:
        before, now = mark, kept(_step(now, at), "stars")
    return found.filter("_blocks = 1").select(*names).union(now.select(*names))
