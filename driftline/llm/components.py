"""Connected components of a table of links, by alternating large-star and small-star steps.

Nothing is collected: each round is two joins and aggregations over the links, written to the shared
folder. Links shrink to stars around the least node of each component in O(log n) rounds. A hub's
minimum is a partial aggregate and its links are the splittable side of a join.

Many links a node are first dealt to blocks, of which each task keeps a spanning star of each component; what
is left of one block needs no round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.components import least_reachable

from .common import materialize

#: Links that a task joins at once, in expectation.
BLOCK = 1 << 18


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter(F.col("b") > F.col("a"))
        .join(least, "a")
        .filter(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _stars(table: pa.Table) -> pa.Table:
    """Links (a, b) of a block -> (a, b): each node but the least of its component there, and that one."""
    a, b = (table[c].combine_chunks().to_numpy() for c in ("a", "b"))
    ids, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = least_reachable(len(ids), places[: len(a)], places[len(a) :])
    own = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": ids[own], "b": ids[root[own]]})


def components(links: DataFrame, tag: str = "", block: int | None = None) -> DataFrame:
    """node, root of each node of links (a, b; of one orderable type): root is the least node reachable.

    Links from a node to itself and repeated links count once or not at all; nulls are dropped; an
    empty table gives an empty one. Nodes without a link to another node have no row. block: about how many
    links, then longs, a task joins at once before the rounds; the rounds are left out where all are one block.
    """
    links = links.filter(F.col("a") != F.col("b")).select("a", "b")
    now = materialize(links if block else links.distinct(), "links", tag)
    before, n = None, now.count() if block else 0
    while block and n:
        blocks = -(-n // block)
        dealt = now.withColumn("block", F.pmod(F.xxhash64("a", "b"), F.lit(blocks)))
        now = materialize(dealt.groupBy("block").applyInArrow(_stars, "a long, b long"), "links", tag)
        if blocks == 1:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        left = now.count()
        if 2 * left > n:
            break
        n = left
    while (mark := _mark(now)) != before:
        before = mark
        now = materialize(_small_star(_large_star(now)), "links", tag)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
