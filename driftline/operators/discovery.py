"""Directed edges between indicators: lagged regressions, false-discovery control, bootstrap.

For each trajectory and target the triangular factor of the lagged columns is made once; the factor of
any resample of whole trajectories is that of theirs put together, so the cost of a replicate does not
depend on the length of the trajectories, and near-collinear lags lose nothing to squaring. A target's
factors meet in one group, where all its replicates are fitted.

Every graph belongs to a cell (a setting of a sweep, or the only one): many settings are one job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.stats import draws, factor, joined_factor, standardised_fit
from driftline.operators.windows import false_discovery

TERMS = "cell int, replicate int, source string, target string, lag int, beta double, p double"
#: Replicates that a task fits of a target.
SLICE = 64
Pairs = list[tuple[str, str, str]]


def candidates_of(representation: dict) -> list[tuple[str, str, str]]:
    """(source, target, group) of a representation's candidate edges, a row for each group."""
    out = []
    for e in representation["candidate_edges"]:
        groups = e.get("hypothesis_group_ids") or [e.get("hypothesis_group_id", "ungrouped")]
        out += [(e["source"], e["target"], str(x)) for x in groups]
    return out


def all_pairs(nodes: list[str], group: str = "unrestricted") -> list[tuple[str, str, str]]:
    """Every ordered pair of different nodes."""
    return [(a, b, group) for a in sorted(nodes) for b in sorted(nodes) if a != b]


def _sources(pairs: Pairs) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for source, target, _ in sorted(set(pairs)):
        if source not in out.setdefault(target, []):
            out[target].append(source)
    return out


def lagged_factors(series: DataFrame, pairs: dict[int, Pairs], lag: int) -> DataFrame:
    """cell, seed, target, factor: of [target, its lags, lags of each source in order], for each trajectory.

    series: cell, seed, time, node_id, value; pairs by cell. A trajectory is gathered once, for all its
    targets. Rows with a missing value are left out of a target's factor; trajectories of lag rows or
    fewer have an empty one.
    """
    sources = {c: _sources(p) for c, p in pairs.items()}

    def run(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        node, at, value = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("node_id", "time", "value"))
        times, row = np.unique(at, return_inverse=True)
        names = {n: i for i, n in enumerate(sorted(set(node)))}
        wide = np.full((len(times), len(names) + 1), np.nan)  # the last of nodes without values
        wide[row, [names[n] for n in node]] = value.astype(float)
        n, out = len(times) - lag, []
        for target, own in sources.get(cell, {}).items():
            places = [names.get(x, len(names)) for x in (target, *own)]
            cols = [wide[lag:, places[0]]] + [wide[lag - k : lag - k + n, c] for c in places for k in range(1, lag + 1)] if n > 0 else []
            x = np.column_stack(cols) if n > 0 else np.zeros((0, 1 + len(places) * lag))
            out.append((target, factor(x[np.isfinite(x).all(axis=1)]).ravel()))
        return pa.table(
            {
                "cell": pa.array([cell] * len(out), pa.int32()),
                "seed": pa.array([table["seed"][0].as_py()] * len(out), table["seed"].type),
                "target": pa.array([t for t, _ in out], pa.string()),
                "factor": pa.array([f for _, f in out], pa.list_(pa.float64())),
            }
        )

    kind = series.schema["seed"].dataType.simpleString()
    rows = series.select("cell", "seed", F.col("time").cast("long").alias("time"), "node_id", F.col("value").cast("double").alias("value"))
    return rows.groupBy("cell", "seed").applyInArrow(run, f"cell int, seed {kind}, target string, factor array<double>")


def fitted_terms(factors: DataFrame, pairs: dict[int, Pairs], lag: int, parent_alpha: float, weights, replicates: int) -> DataFrame:
    """cell, replicate, source, target, lag, beta, p: terms that pass a first fit, from a second without the others.

    weights(cell, seeds) gives [replicates, seeds] how often a replicate has each trajectory, seeds in
    order; it is asked for in the task. A target's factors go to a task for each SLICE of the replicates.
    """
    sources = {c: _sources(p) for c, p in pairs.items()}

    def run(table: pa.Table) -> pa.Table:
        cell, target, at = (table[c][0].as_py() for c in ("cell", "target", "slice"))
        own = sources[cell][target]
        table = table.sort_by("seed")
        size = 2 + lag * (1 + len(own))
        whole = table["factor"].combine_chunks().flatten().to_numpy().reshape(-1, size, size)
        w = weights(cell, table["seed"].to_pylist())
        terms = list(range(1, 1 + lag * (1 + len(own))))
        rows = []
        for replicate in range(at * SLICE, min((at + 1) * SLICE, len(w))):
            r = joined_factor(whole, w[replicate])
            _, first = standardised_fit(r, 0, terms)
            kept = [t for t in terms[lag:] if first[t - 1] < parent_alpha]
            if kept:
                beta, p = standardised_fit(r, 0, terms[:lag] + kept)
                rows += [(replicate, own[(t - 1) // lag - 1], (t - 1) % lag + 1, b, q) for t, b, q in zip(kept, beta[lag:], p[lag:], strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        n = len(rows)
        return pa.table(
            {
                "cell": pa.array([cell] * n, pa.int32()),
                "replicate": pa.array(columns[0], pa.int32()),
                "source": pa.array(columns[1], pa.string()),
                "target": pa.array([target] * n, pa.string()),
                "lag": pa.array(columns[2], pa.int32()),
                "beta": pa.array(columns[3], pa.float64()),
                "p": pa.array(columns[4], pa.float64()),
            }
        )

    slices = F.explode(F.sequence(F.lit(0), F.lit(max(0, (replicates - 1) // SLICE)))).alias("slice")
    return factors.select("*", slices).groupBy("cell", "target", "slice").applyInArrow(run, TERMS)


def select_edges(terms: DataFrame, pairs: dict[int, Pairs], fdr_alpha: float) -> DataFrame:
    """cell, replicate, source, target, group, lag, beta, p, q, direction: the best lag of each pair with q under fdr_alpha."""
    listed = [(c, *p) for c, own in pairs.items() for p in sorted(set(own))]
    groups = terms.sparkSession.createDataFrame(listed, "cell int, source string, target string, group string")
    tested = false_discovery(terms.join(groups, ["cell", "source", "target"]), ["cell", "replicate", "group"])
    best = Window.partitionBy("cell", "replicate", "group", "source", "target").orderBy("q", "lag")
    return (
        tested.withColumn("_n", F.row_number().over(best))
        .filter((F.col("_n") == 1) & (F.col("q") < fdr_alpha))
        .select("cell", "replicate", "source", "target", "group", "lag", "beta", "p", "q", F.when(F.col("beta") > 0, "increase").otherwise("decrease").alias("direction"))
    )


def _every(cell: int, seeds: list) -> np.ndarray:
    return np.ones((1, len(seeds)))


def _each(cell: int, seeds: list) -> np.ndarray:
    return np.eye(len(seeds))


def resamples(master: int, labels: dict[int, str], replicates: int):
    """Weights of the data as they are, replicate 0, and of resamples of whole trajectories, 1 and on."""

    def of(cell: int, seeds: list) -> np.ndarray:
        drawn = draws(master, labels[cell], replicates, len(seeds))
        return np.vstack([np.ones(len(seeds)), *[np.bincount(row, minlength=len(seeds)) for row in drawn]])

    return of


def _one(series: DataFrame) -> DataFrame:
    return series.withColumn("cell", F.lit(0))


def point_graphs(series: DataFrame, pairs: dict[int, Pairs], lag: int, parent_alpha: float, fdr_alpha: float) -> DataFrame:
    """cell and the edges from all its trajectories together."""
    terms = fitted_terms(lagged_factors(series, pairs, lag), pairs, lag, parent_alpha, _every, 1)
    return select_edges(terms, pairs, fdr_alpha).drop("replicate")


def point_graph(series: DataFrame, pairs: Pairs, lag: int, parent_alpha: float, fdr_alpha: float) -> DataFrame:
    """Edges from all trajectories together."""
    return point_graphs(_one(series), {0: pairs}, lag, parent_alpha, fdr_alpha).drop("cell")


def bootstrap_graphs(
    series: DataFrame,
    pairs: dict[int, Pairs],
    lag: int,
    parent_alpha: float,
    fdr_alpha: float,
    replicates: int,
    support: dict[int, float],
    master: int,
    labels: dict[int, str],
) -> tuple[DataFrame, DataFrame]:
    """bootstrap_graph() of each cell, in one job; support and labels by cell."""
    terms = fitted_terms(lagged_factors(series, pairs, lag), pairs, lag, parent_alpha, resamples(master, labels, replicates), replicates + 1)
    edges = select_edges(terms, pairs, fdr_alpha)
    again = F.col("replicate") > 0
    point = F.max(F.when(~again, F.struct("lag", "beta", "p", "q", "direction")))
    lags = F.collect_list(F.when(again, F.col("lag")))  # at most one a replicate
    least = F.element_at(F.create_map(*[F.lit(x) for c, v in support.items() for x in (c, float(v))]), F.col("cell"))
    kept = (
        edges.groupBy("cell", "source", "target", "group")
        .agg(
            point.alias("_p"),
            (F.count_if(again) / replicates).alias("support"),
            lags.alias("_lags"),
            F.coalesce(F.stddev_samp(F.when(again, F.col("lag"))), F.lit(0.0)).alias("lag_std"),
        )
        .filter(F.col("_p").isNotNull() & (F.col("support") >= least))
        .select(
            "cell", "source", "target", "group", "_p.lag", "_p.beta", "_p.p", "_p.q", "_p.direction", "support",
            (F.size(F.filter("_lags", lambda x: x == F.col("_p.lag"))) / replicates).alias("lag_support"), "lag_std",
        )
    )
    return kept, edges.filter(again).withColumn("replicate", F.col("replicate") - 1)


def bootstrap_graph(
    series: DataFrame,
    pairs: Pairs,
    lag: int,
    parent_alpha: float,
    fdr_alpha: float,
    replicates: int,
    support: float,
    master: int = 0,
    label: str = "bootstrap",
) -> tuple[DataFrame, DataFrame]:
    """Edges of the point graph that enough resamples of whole trajectories have, and the edges of each resample."""
    kept, resampled = bootstrap_graphs(_one(series), {0: pairs}, lag, parent_alpha, fdr_alpha, replicates, {0: support}, master, {0: label})
    return kept.drop("cell"), resampled.drop("cell")


def vote_graphs(series: DataFrame, pairs: dict[int, Pairs], lag: int, parent_alpha: float, fdr_alpha: float, votes: float) -> DataFrame:
    """vote_graph() of each cell, in one job."""
    factors = lagged_factors(series, pairs, lag)
    counts = series.groupBy("cell").agg(F.count_distinct("seed").alias("_n"))
    most = counts.agg(F.coalesce(F.max("_n"), F.lit(1))).first()[0]
    edges = select_edges(fitted_terms(factors, pairs, lag, parent_alpha, _each, most), pairs, fdr_alpha)
    pair = ["cell", "source", "target", "group"]
    by_lag = edges.groupBy(*pair, "lag").agg(F.count("*").alias("_c"), F.avg("beta").alias("beta"), F.avg("p").alias("p"), F.avg("q").alias("q"), F.min_by("direction", "replicate").alias("direction"))
    part = Window.partitionBy(*pair)
    # the spread of lags, from the lags' counts
    total, mean = F.sum("_c").over(part), F.sum(F.col("_c") * F.col("lag")).over(part) / F.sum("_c").over(part)
    spread = F.sum(F.col("_c") * F.pow(F.col("lag") - F.col("_mean"), 2)).over(part)
    return (
        by_lag.withColumns({"_total": total, "_mean": mean})
        .withColumns({"_spread": spread, "_k": F.row_number().over(part.orderBy(F.desc("_c"), "lag"))})
        .filter("_k = 1")
        .join(counts, "cell")
        .withColumn("support", F.col("_total") / F.col("_n"))
        .filter(F.col("support") >= votes)
        .select(
            *pair, "lag", "beta", "p", "q", "direction", "support", (F.col("_c") / F.col("_n")).alias("lag_support"),
            F.when(F.col("_total") > 1, F.sqrt(F.col("_spread") / (F.col("_total") - 1))).otherwise(0.0).alias("lag_std"),
        )
    )


def vote_graph(series: DataFrame, pairs: Pairs, lag: int, parent_alpha: float, fdr_alpha: float, votes: float) -> DataFrame:
    """Edges that enough trajectories show each alone, at their commonest lag (ties: the shorter)."""
    return vote_graphs(_one(series), {0: pairs}, lag, parent_alpha, fdr_alpha, votes).drop("cell")


def single_graph(series: DataFrame, pairs: Pairs, lag: int, parent_alpha: float, fdr_alpha: float) -> DataFrame:
    """The point graph of the trajectory with the lowest seed."""
    lowest = series.agg(F.min("seed").alias("seed"))
    return point_graph(series.join(lowest, "seed"), pairs, lag, parent_alpha, fdr_alpha)


def prior_graph(candidates: DataFrame) -> DataFrame:
    """Edges of the prior alone (source, target, group, expected_direction), at lag 0."""
    d = F.col("expected_direction")
    return candidates.select(
        "source", "target", "group", F.lit(0).alias("lag"), F.when(d == "increase", 1.0).when(d == "decrease", -1.0).otherwise(0.0).alias("beta"), d.alias("direction")
    )
