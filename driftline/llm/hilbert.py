"""Approximate nearest neighbours over several shifted Hilbert orderings of projected vectors.

Each curve projects the vectors on DIMENSIONS axes of a random rotation that no other curve of the
rotation has, shifts and quantises the coordinates, and orders the vectors by their place on the Hilbert
curve. The order is cut into tiles of equal size by quantiles of the keys; a query meets the vectors of
its tile and of the nearer neighbouring tile, and the best of all curves are merged. Scores are exact
inner products of the original vectors.

The vectors of two tiles are a share of the table that no size changes: 2 / TILES, on CURVES curves
together 0.97 of the table. Only of tables under TILES * LEAST vectors tiles are larger, since the k
nearest of few vectors lie farther off. A task holds a slice of the queries and passes over a tile's
vectors batch by batch, so its memory depends on neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CURVES = 16
#: Dimensions and bits of a curve, and bits of a hash below them that keep equal keys apart.
DIMENSIONS, BITS, TIE_BITS = 4, 6, 30
#: Tiles of a curve, and vectors in a tile at least.
TILES, LEAST = 33, 160
#: Queries that a task holds, about.
SLICE = 16_384
#: Candidates kept of a pass besides the k asked for.
SPARE = 8
#: Vectors that the quantiles of the keys are taken from, in expectation.
SAMPLE = 100_000
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of non-negative whole numbers under 2 ** bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # inverse undo
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray encode
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _curve(dim: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection and shift of a curve: the same for every task."""
    own = min(dim, DIMENSIONS)
    rotation, place = divmod(curve, dim // own)
    basis = np.linalg.qr(np.random.default_rng([SEED, dim, rotation]).standard_normal((dim, dim)))[0]
    shift = np.random.default_rng([SEED, dim, rotation, place]).random(own)
    return basis[:, place * own : (place + 1) * own], shift


def curve_key(vectors: np.ndarray, curve: int, scale: float) -> np.ndarray:
    """Keys of vectors on a curve; scale: the spread of a coordinate."""
    basis, shift = _curve(vectors.shape[1], curve)
    z = vectors @ basis / max(scale, 1e-12)
    # evens out coordinates that are about normal; the shift moves all cell borders
    even = 1 / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))
    cells = np.clip(((even * 0.5 + shift * 0.5) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(cells, BITS)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, of equal scores the smaller ids, in no order."""
    if score.shape[1] <= k:
        return score, ids
    keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.take_along_axis(score, keep, 1), np.take_along_axis(ids, keep, 1)


class _Tile:
    """The queries of a slice and the best that they have met so far."""

    def __init__(self, rep: np.ndarray, vectors: np.ndarray, k: int):
        self.rep, self.vectors, self.k = rep, vectors, k
        self.score, self.found = np.zeros((len(rep), 0)), np.zeros((len(rep), 0), np.int64)

    def meet(self, rep: np.ndarray, vectors: np.ndarray) -> None:
        scores, found = [], []
        for at in range(0, len(self.rep), 512):  # the scores of a part of the queries at a time
            own = slice(at, at + 512)
            score = self.vectors[own] @ vectors.T
            part, ids = _best(score, np.broadcast_to(rep, score.shape), self.k)
            part, ids = _best(np.hstack([self.score[own], part]), np.hstack([self.found[own], ids]), self.k)
            scores.append(part)
            found.append(ids)
        if scores:
            self.score, self.found = np.vstack(scores), np.vstack(found)

    def rows(self) -> pa.RecordBatch:
        q = np.repeat(self.rep, self.found.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.found.ravel()), pa.array(self.score.ravel())], ["q", "c", "score"])


def _search(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(curve, tile, slice, asks, rep, embedding), by the first three and queries first -> (q, c, score)."""
        at, queries, tile = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)] + [batch.column(3).to_numpy(zero_copy_only=False)]).astype(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                own, asks = tuple(keys[lo, :3].tolist()), bool(keys[lo, 3])
                if own != at:
                    if tile is not None:
                        yield tile.rows()
                    at, queries, tile = own, [], None
                rep = batch.column(4).slice(lo, hi - lo).to_numpy()
                vectors = _matrix(batch.column(5).slice(lo, hi - lo), dim)
                if asks:
                    queries.append((rep, vectors))
                elif queries or tile is not None:
                    if tile is None:
                        tile, queries = _Tile(*(np.concatenate(x) for x in zip(*queries, strict=True)), k), []
                    tile.meet(rep, vectors)
        if tile is not None:
            yield tile.rows()

    return run


def nearest(
    vectors: DataFrame,
    k: int = 20,
    query: str = "vec_id % 20 = 0",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    curves: int = CURVES,
    tiles: int = TILES,
    least: int = LEAST,
    tag: str = "",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k found of largest inner product for each row that query (SQL on vec_id) holds for.

    Vectors null, zero or holding null or non-finite components take no part, nor do those of another
    length than the most common one. Equal vectors are searched once, as one; ties go to the smaller
    vec_id; the query's own row is no candidate, but its copies are. Rows of a null vec_id take no
    part; repeated rows of one vec_id are one; a table without queries gives no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    kind = vectors.schema[embedding].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast(kind).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & fine)
    common = rows.groupBy(F.size(e).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]
    # of each distinct vector the k + 1 smallest ids: no more can be among the k nearest
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = materialize(
        rows.filter(F.size(e) == dim).distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1), "vectors", tag
    )
    classes = kept.filter("n = 1").select(F.col("vec_id").alias("rep"), "embedding")
    members = kept.join(classes, "embedding").select("rep", "vec_id")
    asking = (
        rows.filter(F.expr(query)).filter(F.size(e) == dim).distinct().join(classes, "embedding").select(F.col("vec_id").alias("query_id"), "rep")
    )
    asking = materialize(asking, "queries", tag)
    wanted = asking.select("rep").distinct().withColumn("asks", F.lit(True))
    classes = classes.join(wanted, "rep", "left").select("rep", "embedding", F.coalesce("asks", F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    total, length, questions = classes.agg(F.count("*"), F.avg(norm), F.count_if("asks")).first()
    scale = float((1.0 / dim) ** 0.5) * (length or 1.0)

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series, rep: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        m = np.stack(v.to_numpy()).astype(np.float64)
        tie = (rep.to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        return pd.Series(list(np.column_stack([curve_key(m, c, scale) << TIE_BITS | tie for c in range(curves)])))

    placed = materialize(classes.withColumn("keys", keys("embedding", "rep")), "curve-keys", tag)
    # half tiles: equal shares of each curve's order, by quantiles of a sample of the keys
    number = max(1, min(tiles, total // least))
    cuts = np.zeros((curves, 0), np.int64)
    if number > 1:
        share = min(1.0, SAMPLE / total)
        sample = np.stack(
            placed.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))).select("keys").toPandas()["keys"].to_numpy()
        )
        cuts = np.quantile(sample, np.arange(1, 2 * number) / (2 * number), axis=0, method="lower").T.astype(np.int64)
    parts = max(1, -(-2 * questions // (number * SLICE)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its tile of each curve, once for each slice of queries; each query to its tile and the nearer one beside it."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack(batch.column(3).to_numpy(zero_copy_only=False))
            q = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            part_of = (batch.column(0).to_numpy()[q].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % parts
            every = np.arange(batch.num_rows)
            rows: list[tuple] = []
            for c in range(curves):
                half = np.searchsorted(cuts[c], own[:, c], "right")
                tile = half // 2
                rows += [(every, c, tile, np.full(len(every), p), False) for p in range(parts)]
                beside = np.where(half % 2 == 0, tile - 1, tile + 1)[q]
                # at the ends of a curve there is one neighbour
                beside = np.where(beside < 0, 1, np.where(beside >= number, number - 2, beside))
                rows.append((q, c, tile[q], part_of, True))
                if number > 1:
                    rows.append((q, c, beside, part_of, True))
            take = pa.array(np.concatenate([r[0] for r in rows]))
            each = [len(r[0]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([r[1] for r in rows], each).astype(np.int32)),
                    pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32)),
                    pa.array(np.concatenate([r[3] for r in rows]).astype(np.int32)),
                    pa.array(np.repeat([r[4] for r in rows], each)),
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                ],
                ["curve", "tile", "slice", "asks", "rep", "embedding"],
            )

    dealt = placed.select("rep", "embedding", "asks", "keys").mapInArrow(
        deal, f"curve int, tile int, slice int, asks boolean, rep long, embedding {kind}"
    )
    group = ["curve", "tile", "slice"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, F.desc("asks"))
    found = dealt.mapInArrow(_search(dim, k + 1 + SPARE), "q long, c long, score double")
    merged = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    of_query = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = merged.withColumn("n", F.row_number().over(of_query)).filter(F.col("n") <= k + 1).drop("n")
    best = materialize(best, "nearest-classes", tag)
    # members of the classes found, then for each row that asks the k nearest but itself
    listed = best.join(members, best["c"] == members["rep"]).select("q", "vec_id", "score")
    in_query = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("n", F.row_number().over(in_query)).filter(F.col("n") <= k + 1).drop("n")
    answers = asking.join(listed, asking["rep"] == listed["q"]).filter(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.select("query_id", F.row_number().over(final).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
