"""Sweeps over settings: every setting is a cell, and all cells of a sweep are fitted in one job."""

from __future__ import annotations

import hashlib
import itertools
import json
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.stats import stable_seed
from driftline.operators import discovery, effects, robustness
from driftline.operators.components import kept
from driftline.operators.confirmation import graph_table
from driftline.operators.windows import interpolate

FIT = {"lag": 5, "parent_alpha": 0.1, "fdr_alpha": 0.05, "support": 0.65, "votes": 0.5, "replicates": 30, "master": 0}


def cells_table(spark: SparkSession, cells: list[dict], schema: str, pairs: dict[int, list] | None = None) -> DataFrame:
    """A row for each cell: its number, its settings, and how many candidates it has."""
    rows = [(i, *cell.values(), len(set(pairs[i])) if pairs else 0) for i, cell in enumerate(cells)]
    return spark.createDataFrame(rows, f"cell int, {schema}, candidates long")


def repeated(series: DataFrame, cells: int) -> DataFrame:
    """series once for each cell."""
    return series.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "seed", "time", "node_id", "value")


def subsets(series: DataFrame, cells: list[dict], master: int) -> DataFrame:
    """For each cell its number of whole trajectories, drawn without replacement."""
    seeds = sorted(r["seed"] for r in series.select("seed").distinct().collect())  # few
    rows = []
    for i, cell in enumerate(cells):
        if cell["trajectories"] > len(seeds):
            raise ValueError(f"{cell['trajectories']} trajectories of {len(seeds)}")
        rng = np.random.default_rng(stable_seed(master, "data_efficiency", cell["trajectories"], cell["repetition"]))
        rows += [(i, seeds[k]) for k in np.sort(rng.choice(len(seeds), cell["trajectories"], replace=False))]
    chosen = series.sparkSession.createDataFrame(rows, f"cell int, seed {series.schema['seed'].dataType.simpleString()}")
    return series.join(chosen, "seed").select("cell", "seed", "time", "node_id", "value")


def replicate_bands(resampled: DataFrame, cells: DataFrame, replicates: int) -> DataFrame:
    """cell and 95 % bands over resamples of the share of candidates that are edges, and of the mean support of edges.

    A resample without edges counts with 0 for either.
    """
    pairs = resampled.select("cell", "replicate", "source", "target").distinct()
    often = pairs.groupBy("cell", "source", "target").agg((F.count("*") / replicates).alias("often"))
    each = pairs.join(often, ["cell", "source", "target"]).groupBy("cell", "replicate").agg(F.count("*").alias("n"), F.avg("often").alias("often"))
    every = cells.select("cell", "candidates", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    rows = every.join(each, ["cell", "replicate"], "left").select(
        "cell", (F.coalesce("n", F.lit(0)) / F.greatest("candidates", F.lit(1))).alias("rate"), F.coalesce("often", F.lit(0.0)).alias("often")
    )
    band = lambda c, name: [F.percentile(c, F.lit(q)).alias(f"{name}_{side}") for q, side in ((0.025, "low"), (0.975, "high"))]
    return rows.groupBy("cell").agg(*band("rate", "rate"), *band("often", "stability"))


def data_efficiency(series: DataFrame, pairs: discovery.Pairs, counts, repetitions: int, fit: dict | None = None) -> DataFrame:
    """method, trajectories, repetition and the graph's measures, of resampled and of voted graphs of fewer trajectories.

    One trajectory has a point graph, whose stability cannot be told.
    """
    fit = FIT | (fit or {})
    spark = series.sparkSession
    cells = [{"trajectories": n, "repetition": r} for n, r in itertools.product(counts, range(repetitions))]
    own = {i: pairs for i in range(len(cells))}
    table = cells_table(spark, cells, "trajectories int, repetition int", own)
    thin = subsets(series, cells, fit["master"])
    how = (fit["lag"], fit["parent_alpha"], fit["fdr_alpha"])
    single = [i for i, c in enumerate(cells) if c["trajectories"] == 1]
    many = {i: pairs for i in own if i not in single}
    labels = {i: f"efficiency:{c['trajectories']}:{c['repetition']}" for i, c in enumerate(cells)}
    kept, resampled = discovery.bootstrap_graphs(thin.filter(~F.col("cell").isin(single)), many, *how, fit["replicates"], {i: fit["support"] for i in many} or {0: 1.0}, fit["master"], labels)
    measures = ["support", "lag_support", "lag_std"]
    graphs = kept.select("cell", *measures)
    if single:
        point = discovery.point_graphs(thin.filter(F.col("cell").isin(single)), {i: pairs for i in single}, *how)
        graphs = graphs.union(point.select("cell", *[F.lit(None).cast("double").alias(c) for c in measures]))
    voted = discovery.vote_graphs(thin, own, *how, fit["votes"]).select("cell", *measures)
    by = ["cell", "trajectories", "repetition"]
    out = []
    for method, edges in (("full_method", graphs), ("trajectory_vote", voted)):
        found = graph_table(edges.join(table.drop("candidates"), "cell"), table, by)
        told = F.col("trajectories") > 1
        found = found.select(F.lit(method).alias("method"), *by, "retained", "qualification_rate", told.alias("estimable"), *[F.when(told, F.col(c)).alias(c) for c in ("stability", "lag_support", "lag_std")])
        out.append(found)
    bands = replicate_bands(resampled, table.filter("trajectories > 1"), fit["replicates"]).withColumn("method", F.lit("full_method"))
    return out[0].union(out[1]).join(bands, ["method", "cell"], "left").drop("cell")


def perturbed(series: DataFrame, cells: list[dict], master: int) -> DataFrame:
    """series of each cell with its noise (times the spread of a trajectory's node) and its share of missing values, filled again.

    Draws belong to a factor and repetition, not to the level: levels of one repetition meet the same chances.
    """
    kind = series.schema["seed"].dataType.simpleString()
    level = {i: float(c["noise"]) for i, c in enumerate(cells)}
    label = {i: f"{c['factor']}:{c['repetition']}" for i, c in enumerate(cells)}
    rows = repeated(series, len(cells)).withColumn("time", F.col("time").cast("long")).withColumn("value", F.col("value").cast("double"))

    def noisy(table: pa.Table) -> pa.Table:
        table = table.sort_by("time")
        cell, seed, node = (table[c][0].as_py() for c in ("cell", "seed", "node_id"))
        v = table["value"].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
        sd = np.nanstd(v, ddof=1) if np.isfinite(v).sum() > 1 else 0.0
        rng = np.random.default_rng(stable_seed(master, label[cell], seed, node))
        return table.set_column(table.schema.get_field_index("value"), "value", pa.array(v + rng.standard_normal(len(v)) * sd * level[cell], from_pandas=True))

    loud = [i for i, x in level.items() if x > 0]
    quiet = rows.filter(~F.col("cell").isin(loud))
    if loud:
        schema = f"cell int, seed {kind}, time long, node_id string, value double"
        quiet = quiet.union(rows.filter(F.col("cell").isin(loud)).groupBy("cell", "seed", "node_id").applyInArrow(noisy, schema))
    settings = series.sparkSession.createDataFrame([(i, float(c["missing"]), label[i]) for i, c in enumerate(cells)], "cell int, _missing double, _label string")
    u = F.pmod(F.xxhash64("seed", "node_id", "time", "_label", F.lit(master)), F.lit(1 << 30)) / float(1 << 30)
    thin = quiet.join(settings, "cell").withColumn("value", F.when(u >= F.col("_missing"), F.col("value"))).drop("_missing", "_label")
    return interpolate(thin, ["cell", "seed", "node_id"], "value")


def observation_robustness(series: DataFrame, pairs: discovery.Pairs, noise, missing, supports, repetitions: int, fit: dict | None = None) -> DataFrame:
    """factor, noise, missing, support, repetition and the measures of each graph of perturbed series."""
    fit = FIT | (fit or {})
    levels = [("observation_noise", float(x), 0.0, fit["support"]) for x in noise] + [("missing_values", 0.0, float(x), fit["support"]) for x in missing]
    levels += [("support_threshold", 0.0, 0.0, float(x)) for x in supports]
    cells = [dict(zip(("factor", "noise", "missing", "support_level", "repetition"), (*at, r), strict=True)) for at, r in itertools.product(levels, range(repetitions))]
    own = {i: pairs for i in range(len(cells))}
    labels = {i: ":".join(map(str, c.values())) for i, c in enumerate(cells)}
    kept, _ = discovery.bootstrap_graphs(
        perturbed(series, cells, fit["master"]), own, fit["lag"], fit["parent_alpha"], fit["fdr_alpha"], fit["replicates"], {i: c["support_level"] for i, c in enumerate(cells)}, fit["master"], labels
    )
    schema = "factor string, noise double, missing double, support_level double, repetition int"
    table = cells_table(series.sparkSession, cells, schema, own)
    found = graph_table(kept, table.select("cell", "candidates"), ["cell"])
    return table.drop("candidates").join(found, "cell").drop("cell", "lag_support", "lag_std")


def representation_robustness(series: DataFrame, pairs: discovery.Pairs, ratios, repetitions: int, fit: dict | None = None, kinds=robustness.CORRUPTIONS) -> DataFrame:
    """operator, ratio, repetition, a hash of the candidates and the measures of each graph of corrupted candidates."""
    fit = FIT | (fit or {})
    cells, own, added = [], {}, {}
    for kind, ratio, r in itertools.product(kinds, ratios, range(repetitions)):
        i = len(cells)
        own[i], added[i] = robustness.corrupt(pairs, kind, float(ratio), stable_seed(fit["master"], "representation", r))
        named = json.dumps([list(p) for p in sorted(set(own[i]))], separators=(",", ":"))
        cells.append({"operator": kind, "ratio": float(ratio), "repetition": r, "candidate_sha256": hashlib.sha256(named.encode()).hexdigest()})
    rows = repeated(series, len(cells))
    more = [(i, name, source) for i, of in added.items() for name, source in of.items()]
    if more:
        rows = rows.unionByName(robustness.extra_series(rows, more, fit["master"]))
    labels = {i: ":".join(map(str, list(c.values())[:3])) for i, c in enumerate(cells)}
    kept, _ = discovery.bootstrap_graphs(rows, own, fit["lag"], fit["parent_alpha"], fit["fdr_alpha"], fit["replicates"], {i: fit["support"] for i in own}, fit["master"], labels)
    table = cells_table(series.sparkSession, cells, "operator string, ratio double, repetition int, candidate_sha256 string", own)
    return table.drop("candidates").join(graph_table(kept, table.select("cell", "candidates"), ["cell"]), "cell").drop("cell")


def mechanism_checks(series: DataFrame, pairs: discovery.Pairs, variant: str, target: str, fit: dict | None = None) -> DataFrame:
    """Measures of the point graph of runs with a mechanism turned off; it has no resamples and so no support."""
    fit = FIT | (fit or {})
    point = discovery.point_graph(series, pairs, fit["lag"], fit["parent_alpha"], fit["fdr_alpha"])
    none = [F.lit(None).cast("double").alias(c) for c in ("support", "lag_support", "lag_std")]
    table = series.sparkSession.createDataFrame([(variant, target, len(set(pairs)))], "mechanism_variant string, targeted_mechanism string, candidates long")
    edges = point.select(F.lit(variant).alias("mechanism_variant"), F.lit(target).alias("targeted_mechanism"), *none)
    return graph_table(edges, table, ["mechanism_variant", "targeted_mechanism"])


def scalability(series: DataFrame, nodes: list[str], counts, repetitions: int, fit: dict | None = None) -> DataFrame:
    """indicators, repetition, candidates and edges found, with all ordered pairs of so many indicators: the nodes, then noise."""
    fit = FIT | (fit or {})
    cells = [{"indicators": p, "repetition": r} for p, r in itertools.product(counts, range(repetitions))]
    names = {i: (nodes + [f"null_candidate_{k:03d}" for k in range(len(nodes), c["indicators"])])[: c["indicators"]] for i, c in enumerate(cells)}
    own = {i: discovery.all_pairs(n, "scaled_macro_outcome_group") for i, n in names.items()}
    rows = repeated(series.filter(F.col("node_id").isin(nodes)), len(cells))
    listed = [(i, n) for i, of in names.items() for n in of]
    wanted = series.sparkSession.createDataFrame(listed, "cell int, node_id string")
    more = [(i, n, None) for i, n in listed if n not in nodes]
    rows = rows.join(wanted, ["cell", "node_id"], "left_semi").select("cell", "seed", "time", "node_id", "value")
    if more:
        rows = rows.unionByName(robustness.extra_series(repeated(series, len(cells)), more, fit["master"]))
    edges = discovery.point_graphs(rows, own, fit["lag"], fit["parent_alpha"], fit["fdr_alpha"]).groupBy("cell").agg(F.count("*").alias("edges"))
    table = cells_table(series.sparkSession, cells, "indicators int, repetition int", own)
    return table.join(edges, "cell", "left").select("indicators", "repetition", "candidates", F.coalesce("edges", F.lit(0)).alias("edges"))


def timed_scalability(series: DataFrame, nodes: list[str], counts, repetitions: int, fit: dict | None = None) -> DataFrame:
    """scalability() with seconds: how long the job of so many indicators took, over series written before. A job for each count, with noise of its own."""
    series = kept(series, "scalability")
    out = None
    for p in counts:
        began = time.perf_counter()
        part = kept(scalability(series, nodes, (p,), repetitions, fit), "scalability").withColumn("seconds", F.lit(time.perf_counter() - began))
        out = part if out is None else out.union(part)
    return out


def ablations(series: DataFrame, pairs: discovery.Pairs, nodes: list[str], fit: dict | None = None) -> DataFrame:
    """variant and the measures of the full method's graph, and of those without resamples, joint trajectories or candidates."""
    fit = FIT | (fit or {})
    how = (fit["lag"], fit["parent_alpha"], fit["fdr_alpha"])
    every = discovery.all_pairs(nodes)
    full = discovery.bootstrap_graph(series, pairs, *how, fit["replicates"], fit["support"], fit["master"], "full")[0]
    wide = discovery.bootstrap_graph(series, every, *how, fit["replicates"], fit["support"], fit["master"], "unrestricted")[0]
    none = [F.lit(None).cast("double").alias(c) for c in ("support", "lag_support", "lag_std")]
    measured = lambda df, name: df.select(F.lit(name).alias("variant"), "support", "lag_support", "lag_std")
    bare = lambda df, name: df.select(F.lit(name).alias("variant"), *none)
    edges = measured(full, "full_method").union(measured(wide, "without_structured_representation"))
    edges = edges.union(bare(discovery.point_graph(series, pairs, *how), "without_bootstrap")).union(bare(discovery.single_graph(series, pairs, *how), "without_joint_trajectories"))
    sizes = [("full_method", len(set(pairs))), ("without_bootstrap", len(set(pairs))), ("without_joint_trajectories", len(set(pairs))), ("without_structured_representation", len(every))]
    return graph_table(edges, series.sparkSession.createDataFrame(sizes, "variant string, candidates long"), ["variant"])


def intervention_ablations(
    baseline: DataFrame, interventions: DataFrame, pairs: discovery.Pairs, nodes: list[str], predefined: tuple[DataFrame, discovery.Pairs], fit: dict | None = None, config: dict | None = None, tolerance: int = 2
) -> DataFrame:
    """variant, the measures of its graph, intervention_support_rate and mean_ci_width: the full method and five without a part of it.

    baseline: seed, time, node_id, value; interventions: parameter and direction as well. predefined: the series of
    given observables with their candidates, whose effects nobody measured. The graphs of resamples are cells
    of one job over both series; without_paired_seeds keeps the full graph and deals the baseline's seeds anew.
    """
    fit, at = FIT | (fit or {}), ["parameter", "direction", "node_id"]
    how = (fit["lag"], fit["parent_alpha"], fit["fdr_alpha"])
    names = {0: "full_method", 1: "without_structured_representation", 2: "predefined_observable_baseline"}
    own = {0: pairs, 1: discovery.all_pairs(nodes), 2: predefined[1]}
    rows = repeated(baseline, 2).unionByName(predefined[0].select(F.lit(2).alias("cell"), "seed", "time", "node_id", "value"))
    labels = {0: "full", 1: "unrestricted", 2: "predefined"}
    graphs = kept(discovery.bootstrap_graphs(rows, own, *how, fit["replicates"], {c: fit["support"] for c in own}, fit["master"], labels)[0], "ablations")
    measures = ["source", "target", "lag", "beta", "support", "lag_support", "lag_std"]
    edges = graphs.filter("cell = 0").select(F.lit("without_paired_seeds").alias("variant"), *measures)
    for c, name in names.items():
        edges = edges.union(graphs.filter(F.col("cell") == c).select(F.lit(name), *measures))
    none = [F.lit(None).cast("double")] * 3
    for name, graph in (("without_bootstrap", discovery.point_graph(baseline, pairs, *how)), ("without_joint_trajectories", discovery.single_graph(baseline, pairs, *how))):
        edges = edges.union(graph.select(F.lit(name), "source", "target", "lag", "beta", *none))
    edges = kept(edges, "ablations")
    sizes = {"without_paired_seeds": len(set(pairs)), "without_bootstrap": len(set(pairs)), "without_joint_trajectories": len(set(pairs))} | {n: len(set(own[c])) for c, n in names.items()}
    parameters, directions = interventions.select("parameter").distinct(), interventions.select("direction").distinct()
    routes = edges.select("source", "target", F.col("source").alias("root"), F.lit("ablation").alias("scope")).distinct().crossJoin(F.broadcast(parameters))  # a few settings
    found = None
    for paired in (True, False):
        base = baseline if paired else effects.unpaired(baseline, fit["master"], "ablations")
        moved = effects.effect_summaries(effects.pair_runs(base, interventions, ["parameter", "direction"]), at, config)
        moved = kept(moved.select(*at, "cumulative_effect_standardised", "onset_time", "significant", (F.col("cumulative_ci_high") - F.col("cumulative_ci_low")).alias("ci_width")), "ablations")
        some = edges.filter((F.col("variant") != "predefined_observable_baseline") & ((F.col("variant") != "without_paired_seeds") == paired))
        tried = effects.attempts(some.select("source", "target", F.col("variant").alias("group"), "lag", "beta"), routes, moved, directions, tolerance)
        rate = effects.edge_evidence(tried).groupBy(F.col("group").alias("variant")).agg(F.avg((F.col("edge_class") == "supported").cast("int")).alias("intervention_support_rate"))
        variants = baseline.sparkSession.createDataFrame([(n,) for n in sizes if n != "predefined_observable_baseline" and (n != "without_paired_seeds") == paired], "variant string")
        width = moved.agg(F.avg("ci_width").alias("mean_ci_width"))  # one row
        own_rates = variants.join(rate, "variant", "left").crossJoin(F.broadcast(width))
        found = own_rates if found is None else found.union(own_rates)
    table = graph_table(edges, baseline.sparkSession.createDataFrame(list(sizes.items()), "variant string, candidates long"), ["variant"])
    return table.join(found, "variant", "left")


def control_summary(series: DataFrame, pairs: discovery.Pairs, paths: list[tuple[str, str, str]], repetitions: int, least: int, most: int, primary: int | None = None, fit: dict | None = None) -> DataFrame:
    """repetition and what the method still finds in series whose parents are turned round: edges, paths, and their ratio to the primary graph.

    paths: micro, meso, macro. All repetitions are cells of one job, and so is the primary graph, of the series as they
    are, whose edges are counted unless their number is given.
    """
    from driftline.operators.secondary import shifted_repetitions

    fit = FIT | (fit or {})
    if least <= fit["lag"] or most < least:
        raise ValueError("shifts must be longer than the lag")
    spark, parents = series.sparkSession, {s for s, _, _ in pairs}
    own = {r: pairs for r in range(-1, repetitions)}
    rows = shifted_repetitions(series, parents, least, most, fit["master"], repetitions).select("cell", "seed", "time", "node_id", "value")
    kept, _ = discovery.bootstrap_graphs(rows, own, fit["lag"], fit["parent_alpha"], fit["fdr_alpha"], fit["replicates"], {r: fit["support"] for r in own}, fit["master"], {r: f"negative:{r}" if r >= 0 else "bootstrap" for r in own})
    table = spark.createDataFrame([(r, len(set(pairs))) for r in own], "cell int, candidates long")
    found = graph_table(kept, table, ["cell"])
    steps = [(i, f"macro_outcome_{macro}", a, b) for i, (micro, meso, macro) in enumerate(paths) for a, b in ((micro, meso), (meso, macro))]
    wanted = spark.createDataFrame(steps, "path int, group string, source string, target string")
    whole = kept.select("cell", "source", "target", "group").distinct().join(wanted, ["source", "target", "group"])
    whole = whole.groupBy("cell", "path").agg(F.count("*").alias("n")).filter("n = 2").groupBy("cell").agg(F.count("*").alias("qualified_paths"))
    n = F.coalesce("qualified_paths", F.lit(0))
    # a row for each repetition: few
    count = F.max(F.when(F.col("cell") == -1, F.col("retained"))).over(Window.partitionBy(F.lit(0)))
    base = F.col("_primary")
    found = found.withColumn("_primary", count if primary is None else F.lit(primary)).filter("cell >= 0")
    return found.join(whole, "cell", "left").select(
        F.col("cell").alias("repetition"), "candidates", "retained", "qualification_rate", F.lit(len(paths)).alias("paths"), n.alias("qualified_paths"),
        (n / max(len(paths), 1)).alias("path_rate"), "stability", (F.col("retained") - base).alias("difference_from_primary"),
        F.when(base > 0, F.col("retained") / base).alias("ratio_to_primary"),
    )
