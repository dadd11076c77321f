"""SimHash fingerprints, and exact links between all fingerprints a few bits apart.

Fingerprints are sharded by vantage-point trees. Distances of unrelated 64-bit fingerprints crowd
around 32, and six tenths of them lie within three bits of any median, so a tree over the whole
fingerprint would put most of a shard on both sides of each split (1.6 copies a level). The upper
levels therefore use the Hamming distance on parts of the fingerprint: of BLOCKS blocks at least
BLOCKS - RADIUS are untouched between fingerprints RADIUS bits apart, so on some choice of that many
blocks two linked fingerprints lie at distance zero of the same vantage point and the triangle bound
leaves no boundary. Each choice of blocks is one tree, a fingerprint is in one shard of each, and
shards overlap so that every link is inside one. A shard that is still large is split again on the
bits that it has left, by the same bound. Inside a shard a tree of whole-fingerprint distances is
searched with triangle bounds, boundary bands included.

A shard answers with a spanning set of its links (each fingerprint to the least of its component
there), never with all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, slices, small_side
from .components import components

RADIUS = 3
BLOCKS = 5
WORDS = 3
SEED = 42
#: Fingerprints up to which one task searches a shard; larger shards are split on further bits.
SHARD = 4096
#: Free bits under which a shard is searched as it is (it has few fingerprints left).
FREE = 12
#: Fingerprints in a leaf of the tree inside a shard.
LEAF = 128


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of text as an unsigned integer; zero for texts without a word."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
        shingles = [joined[s:e] for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed)))
    n, counts = len(shingles), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bits of a very long text a part at a time
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, min(n - at, 1 << 16) * 8, at * 8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long; a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of blocks - radius blocks of the 64 bits, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(parts, blocks - radius)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """mask with each of radius + 1 parts of its free bits: fingerprints equal on mask and linked agree on one."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
    return [
        _signed((mask & (1 << 64) - 1) | sum(1 << i for i in free[lo:hi]))
        for lo, hi in zip(cut, cut[1:], strict=False)
        if hi > lo
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class VantageTree:
    """Distinct fingerprints by distance from vantage points; near() prunes by triangle bounds."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.alive = np.ones(len(points), bool)
        self.root = self._build(np.arange(len(points)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        vantage = self.points[own[0]]
        d = np.bitwise_count(self.points[own] ^ vantage)
        cut = int(np.median(d))
        inside = d <= cut
        if inside.all():
            inside = d < cut
        if not inside.any() or inside.all():  # all at one distance
            return own
        # the bounds each half really has, so that empty rings prune as well
        near, far = own[inside], own[~inside]
        return (vantage, int(d[inside].max()), int(d[~inside].min()), self._build(near), self._build(far))

    def near(self, x: np.uint64, radius: int) -> np.ndarray:
        """Indices of the points still alive at most radius from x."""
        found, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, np.ndarray):
                left = node[self.alive[node]]
                found.append(left[np.bitwise_count(self.points[left] ^ x) <= radius])
                continue
            vantage, inner, outer, near, far = node
            d = int(np.bitwise_count(vantage ^ x))
            if d - radius <= inner:
                todo.append(near)
            if d + radius >= outer:
                todo.append(far)
        return np.concatenate(found)


def shard_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, least) of the components, of more than one, of distinct ascending points within radius."""
    if len(points) == 2:
        return (points[1:], points[:1]) if np.bitwise_count(points[0] ^ points[1]) <= radius else (points[:0],) * 2
    tree = VantageTree(points)
    members, roots = [], []
    for i in range(len(points)):
        if not tree.alive[i]:
            continue
        tree.alive[i] = False
        todo, first = [i], points[i]
        while todo:
            got = tree.near(points[todo.pop()], radius)
            tree.alive[got] = False
            todo += got.tolist()
            members.append(points[got])
            roots.append(np.full(len(got), first))
    return (np.concatenate(members), np.concatenate(roots)) if members else (points[:0],) * 2


def _solve(radius: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (mask, cell, fp); a shard may go over several batches."""

        def answer(mask: np.ndarray, cell: np.ndarray, fp: np.ndarray):
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1])) + 1
            starts = np.concatenate(([0], new))
            ends = np.concatenate((new, [len(fp)]))
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                x, y = shard_links(np.unique(fp[s:e].view(np.uint64)), radius)
                if len(x):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"]
                )

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, cell, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            last = np.flatnonzero((mask != mask[-1]) | (cell != cell[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                held.append((mask[:cut], cell[:cut], fp[:cut]))
                yield from answer(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            elif held and (held[-1][0][-1] != mask[-1] or held[-1][1][-1] != cell[-1]):
                yield from answer(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((mask[cut:], cell[cut:], fp[cut:]))
        if held:
            yield from answer(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return solve


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, tag: str = "") -> DataFrame:
    """a, b: links that span the components of the distinct fingerprints (column fp) within radius bits."""
    spark = distinct.sparkSession
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(BLOCKS, radius)])
    rows = distinct.select(F.explode(masks).alias("mask"), "fp")
    links = None
    while True:
        cells = rows.withColumn("cell", F.col("fp").bitwiseAND(F.col("mask")))
        counts = cells.groupBy("mask", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > shard)
        free = 64 - F.bit_count("mask")
        large = materialize(counts.filter(free > FREE).select("mask", "cell"), "large-shards", tag)
        some = not large.isEmpty()
        small = cells.join(small_side(large), ["mask", "cell"], "left_anti") if some else cells
        found = (
            small.select("mask", "cell", "fp")
            .repartition("mask", "cell")
            .sortWithinPartitions("mask", "cell", "fp")
            .mapInArrow(_solve(radius), "a long, b long")
        )
        found = materialize(found.distinct(), "shard-links", tag)
        links = found if links is None else links.union(found)
        if not some:
            return links
        # few masks: ten at first, four times as many each time that a shard is split again
        of = [r["mask"] for r in large.select("mask").distinct().collect()]
        finer = F.create_map(
            *[x for m in of for x in (F.lit(m).cast("long"), F.array(*[F.lit(v).cast("long") for v in finer_masks(m, radius)]))]
        )
        hot = cells.join(small_side(large), ["mask", "cell"], "left_semi").select("mask", "fp")
        rows = materialize(hot.select(F.explode(finer[F.col("mask")]).alias("mask"), "fp").distinct(), "split-shards", tag)


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tag: str = ""
) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over fingerprints at most radius bits apart.

    Copies share a fingerprint and are linked as one, so groups of any size cost one fingerprint.
    Null and empty texts have the fingerprint zero and are linked like any other; very long texts are read
    whole; repeated rows give a row each; a null doc_id is never the least unless all of a component are null; an empty table
    gives no rows; further columns of docs are not read.
    """
    found = materialize(fingerprints(docs, doc_id, text), "fingerprints", tag)
    least = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints", tag)
    roots = components(fingerprint_links(least.select("fp"), radius, tag=tag), tag)
    # a root is in no row as a node: its own row is added
    nodes = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    linked = nodes.join(least, "fp")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(smallest, "root").select("fp", "component_id")
    of = (
        least.join(of_linked, "fp", "left")
        .select("fp", F.coalesce("component_id", "least").alias("component_id"))
    )
    of = materialize(of, "fingerprint-components", tag)
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame, tag: str = "") -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return simhash_components(docs, tag=tag).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tag: str = "") -> DataFrame:
    """docs without those that have a link to a smaller doc_id, directly or over others: one stays of each group.

    Rows repeated under one doc_id stay together; rows without a doc_id stay.
    """
    found = simhash_components(docs, doc_id, text, tag=tag)
    (gone_id,) = fresh(docs, "__id")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone_id)).distinct()
    gone = small_side(materialize(gone, "near-gone", tag))
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(gone_id), "left_anti")
