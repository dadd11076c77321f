"""What later evidence says of frozen edges, paths and predictions, and tables that bring evidence together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.nulls import TINY
from driftline.functions.stats import stable_seed
from driftline.operators.effects import edge_evidence, group_of

SCALES = ("micro", "meso", "macro")
#: What a verdict on an edge or a path of new seeds means for a frozen one.
CONFIRMATION = {
    "supported": "confirmed",
    "manipulation_failure": "manipulation_failure",
    "contradicted": "failed_confirmation",
    "directionally_contradicted": "failed_confirmation",
    "no_stable_downstream_effect": "failed_confirmation",
}
ATTEMPT = ("group", "root", "source", "target", "parameter", "direction")


def confirmation(verdict: Column) -> Column:
    out = F.lit("inconclusive")
    for name, means in CONFIRMATION.items():
        out = F.when(verdict == name, means).otherwise(out)
    return out


def _flagged(rows: DataFrame, edges: DataFrame | None, name: str, on=("group", "source", "target")) -> DataFrame:
    """rows with name: whether edges has the row's edge; null without edges."""
    if edges is None:
        return rows.withColumn(name, F.lit(None).cast("boolean"))
    own = edges.select(*on).distinct().withColumn(name, F.lit(True))
    return rows.join(own, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def confirm_mechanisms(primary: DataFrame, holdout: DataFrame, baseline: DataFrame | None = None, disabled: DataFrame | None = None, keys=ATTEMPT) -> DataFrame:
    """keys of each distinct supported attempt of primary, with holdout_class, classification and whether later graphs kept its edge.

    primary, holdout: keys, primary_class. baseline, disabled: edges (group, source, target) found on the
    holdout's runs, without and with the mechanism turned off.
    """
    frozen = primary.filter("primary_class = 'supported'").select(*keys).distinct()
    tried = holdout.join(frozen, list(keys), "left_semi")
    verdicts = edge_evidence(tried, list(keys), holdout=True).select(*keys, F.col("edge_class").alias("holdout_class"))
    rows = frozen.join(verdicts, list(keys), "left").withColumn("holdout_class", F.coalesce("holdout_class", F.lit("inconclusive")))
    rows = _flagged(_flagged(rows, baseline, "retained_baseline"), disabled, "retained_disabled")
    return rows.select(*keys, "holdout_class", confirmation(F.col("holdout_class")).alias("classification"), "retained_baseline", "retained_disabled")


def _three(paths: DataFrame, effects: DataFrame, fields) -> DataFrame:
    """paths with a struct of fields for the effect of each of their three nodes; null without one."""
    for scale in SCALES:
        own = effects.select("parameter", "direction", F.col("node_id").alias(scale), F.struct(*fields).alias(f"_{scale}"))
        paths = paths.join(own, ["parameter", "direction", scale], "left")
    return paths


def _rising(onsets: list[Column]) -> Column:
    return F.coalesce((onsets[0] >= 0) & (onsets[1] >= onsets[0]) & (onsets[2] >= onsets[1]), F.lit(False))


def _with_retained(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths with retained: whether both edges of their macro's group are among edges."""
    rows = paths.withColumn("group", group_of(F.col("macro")))
    for name, a, b in (("_first", "micro", "meso"), ("_second", "meso", "macro")):
        own = edges.select("group", F.col("source").alias(a), F.col("target").alias(b)).distinct().withColumn(name, F.lit(True))
        rows = rows.join(own, ["group", a, b], "left")
    return rows.withColumn("retained", F.col("_first").isNotNull() & F.col("_second").isNotNull()).drop("_first", "_second", "group")


def confirm_predictions(predictions: DataFrame, paths: DataFrame, edges: DataFrame, effects: DataFrame) -> DataFrame:
    """prediction_id, path_id, classification and the tests behind it, of predictions bound to frozen paths.

    paths: path_id, parameter, direction, micro, meso, macro, expected_micro, expected_meso, expected_macro.
    effects: parameter, direction, node_id, significant, effect_sign, onset_time. A prediction of an
    unknown path is an error.
    """
    known = paths.select("path_id", "parameter", "direction", *SCALES, *[f"expected_{s}" for s in SCALES])
    if not predictions.join(known, "path_id", "left_anti").isEmpty():
        raise ValueError("a prediction references an unknown path")
    rows = _with_retained(predictions.select("prediction_id", "path_id").join(known, "path_id"), edges)
    rows = _three(rows, effects, ("significant", "effect_sign", "onset_time"))
    moved = {s: F.coalesce(F.col(f"_{s}.significant"), F.lit(False)) for s in SCALES}
    agrees = F.lit(True)
    for s in SCALES:
        sign = F.when(F.col(f"expected_{s}") == "increase", 1).otherwise(-1)
        agrees = agrees & moved[s] & F.coalesce(F.col(f"_{s}.effect_sign") == sign, F.lit(False))
    ordered = _rising([F.col(f"_{s}.onset_time") for s in SCALES])
    below = moved["meso"] & moved["macro"]
    verdict = (
        F.when(~moved["micro"], "manipulation_failure")
        .when(~below, "inconclusive")
        .when(~(agrees & ordered & F.col("retained")), "failed_confirmation")
        .otherwise("confirmed")
    )
    return rows.select(
        "prediction_id", "path_id", "parameter", "direction", *SCALES, verdict.alias("classification"), "retained",
        agrees.alias("direction_supported"), ordered.alias("onset_order_supported"), below.alias("downstream_supported"),
    )


def requirements(rows: DataFrame, required=(True, True), source_required: bool = True, order_required: bool = True) -> DataFrame:
    """rows with verdict: what frozen requirements say of each path's responses.

    rows: micro, meso, macro: struct<significant, agrees, onset_time> or null; retained. A missing or
    wrong required response, wrong order or a lost edge contradicts; agreement only of responses that were
    not required supports in part.
    """
    moved = [F.coalesce(F.col(f"{s}.significant"), F.lit(False)) for s in SCALES]
    agrees = [F.when(m, F.coalesce(F.col(f"{s}.agrees"), F.lit(False))) for s, m in zip(SCALES, moved, strict=True)]
    onsets = [F.when(m, F.col(f"{s}.onset_time")) for s, m in zip(SCALES, moved, strict=True)]
    missing, wrong, some = F.lit(False), F.lit(False), F.lit(False)
    all_required = F.coalesce(agrees[0], F.lit(False))
    for i, need in enumerate(required, 1):
        if need:
            missing = missing | ~moved[i]
            all_required = all_required & F.coalesce(agrees[i], F.lit(False))
    for a in agrees:
        wrong, some = wrong | F.coalesce(~a, F.lit(False)), some | F.coalesce(a, F.lit(False))
    verdict = (
        F.when(F.lit(source_required) & ~moved[0], "manipulation_failure")
        .when(missing | wrong | (F.lit(order_required) & ~_rising(onsets)) | ~F.col("retained"), "contradicted")
        .when(all_required, "supported")
        .when(some, "partially_supported")
        .otherwise("inconclusive")
    )
    return rows.withColumn("verdict", verdict)


def path_edge_evidence(paths: DataFrame, tried: DataFrame, methods=("full_method", "frozen_full_method")) -> DataFrame:
    """paths with the class of both their edges, from attempts of the named methods on the path's own root and group.

    paths: path_id, parameter, direction, micro, meso, macro. tried: method, ATTEMPT, primary_class.
    """
    own = tried.filter(F.col("method").isin(*methods))
    classes = edge_evidence(own, list(ATTEMPT)).select(*ATTEMPT, "edge_class")
    rows = paths.withColumn("group", group_of(F.col("macro")))
    for name, a, b in (("micro_meso", "micro", "meso"), ("meso_macro", "meso", "macro")):
        found = classes.select("group", "parameter", "direction", F.col("root").alias("_root"), F.col("source").alias("_a"), F.col("target").alias("_b"), F.col("edge_class").alias(f"{name}_class"))
        on = (rows["group"] == found["group"]) & (rows["parameter"] == found["parameter"]) & (rows["direction"] == found["direction"])
        on = on & (rows["micro"] == found["_root"]) & (rows[a] == found["_a"]) & (rows[b] == found["_b"])
        rows = rows.join(found.drop("x"), on, "left").select(*[rows[c] for c in rows.columns], F.coalesce(f"{name}_class", F.lit("inconclusive")).alias(f"{name}_class"))
    return rows


def path_concordance(qualified: DataFrame, effects: DataFrame, tolerance: int) -> DataFrame:
    """Delays, lags and signs of qualified paths, for each edge and in total, beside what they were expected to be. It decides nothing."""
    rows = _three(qualified.filter("path_temporally_qualified"), effects, ("cumulative_effect_standardised", "onset_time", "significant"))
    effect = {s: F.col(f"_{s}.cumulative_effect_standardised") for s in SCALES}
    onset = {s: F.coalesce(F.col(f"_{s}.onset_time"), F.lit(-1)) for s in SCALES}
    out = ["path_id", "parameter", "direction", *SCALES, *[onset[s].alias(f"{s}_onset") for s in SCALES]]
    between = lambda a, b: F.when((onset[a] >= 0) & (onset[b] >= 0), onset[b] - onset[a])
    near = lambda d: F.coalesce(F.abs(d) <= tolerance, F.lit(False))
    for a, b in (("micro", "meso"), ("meso", "macro")):
        lag, sign = F.col(f"{a}_{b}_lag"), F.signum(effect[a] * effect[b])
        out += [
            between(a, b).alias(f"{a}_{b}_delay"),
            (between(a, b) - lag).alias(f"{a}_{b}_lag_difference"),
            near(between(a, b) - lag).alias(f"{a}_{b}_lag_concordant"),
            F.when(sign.isNotNull(), (sign != 0) & (sign == F.signum(F.col(f"{a}_{b}_beta")))).alias(f"{a}_{b}_sign_concordant"),
        ]
    total = F.col("micro_meso_lag") + F.col("meso_macro_lag")
    latency = between("micro", "macro")
    out += [total.alias("total_lag"), latency.alias("total_latency"), (latency - total).alias("total_lag_difference"), near(latency - total).alias("total_lag_concordant")]
    return rows.select(*out, (F.coalesce(F.col("_micro.significant"), F.lit(False)) & effect["micro"].isNotNull()).alias("manipulation_success"))


def path_responses(paths: DataFrame, effects: DataFrame, measures=("effect", "ci_low", "ci_high", "onset", "significant", "effect_sign")) -> DataFrame:
    """paths with a column direction_scale_measure for every direction, node and measure of effects (parameter, direction, node_id, measures).

    Without a row a number is missing, an onset -1, a significance false and a sign 0. One pivot by node,
    and a join for each scale.
    """
    rest = {"onset": F.lit(-1), "significant": F.lit(False), "effect_sign": F.lit(0)}
    ways = [(d, m) for d in ("minus", "plus") for m in measures]
    wide = effects.groupBy("parameter", "node_id").agg(*[F.max(F.when(F.col("direction") == d, F.col(m))).alias(f"{d}_{m}") for d, m in ways])
    rows = paths
    for s in SCALES:
        own = wide.select("parameter", F.col("node_id").alias(s), *[F.col(f"{d}_{m}").alias(f"{d}_{s}_{m}") for d, m in ways])
        rows = rows.join(own, ["parameter", s], "left")
    names = [(f"{d}_{s}_{m}", m) for d in ("minus", "plus") for s in SCALES for m in measures]
    return rows.select(*paths.columns, *[(F.coalesce(n, rest[m]) if m in rest else F.col(n)).alias(n) for n, m in names])


def path_attenuation(paths: DataFrame, metrics: DataFrame, baseline: DataFrame, disabled: DataFrame) -> DataFrame:
    """path_id, scale, node_id, baseline, disabled, retained, attenuation, and whether the edge that leads to the node stayed in either graph.

    paths: path_id, micro, meso, macro; metrics: node_id, baseline, disabled (effects of a node with the
    mechanism on and off); baseline, disabled: edges (group, source, target).
    """
    each = F.explode(
        F.array(*[F.struct(F.lit(s).alias("scale"), F.col(s).alias("node_id"), (F.lit(None).cast("string") if before is None else F.col(before)).alias("parent")) for s, before in zip(SCALES, (None, *SCALES), strict=False)])
    )
    rows = paths.select("path_id", group_of(F.col("macro")).alias("group"), each.alias("n")).select("path_id", "group", "n.*")
    rows = rows.join(metrics.select("node_id", "baseline", "disabled"), "node_id", "left")
    ratio = F.when(F.abs("baseline") > TINY, F.abs("disabled") / F.abs("baseline"))
    rows = rows.withColumnsRenamed({"parent": "source", "node_id": "target"})
    rows = _flagged(_flagged(rows, baseline, "edge_baseline"), disabled, "edge_disabled")
    led = lambda c: F.when(F.col("source").isNotNull(), F.col(c)).alias(c)
    return rows.select("path_id", "scale", F.col("target").alias("node_id"), "baseline", "disabled", ratio.alias("retained"), (1 - ratio).alias("attenuation"), led("edge_baseline"), led("edge_disabled"))


def _mean_band(values: np.ndarray, repetitions: int, level: float, seed: int) -> tuple[float | None, float | None]:
    index = np.random.default_rng(seed).integers(0, len(values), size=(repetitions, len(values)))
    a = (1 - level) / 2
    low, high = np.quantile(values[index].mean(axis=1), [a, 1 - a])
    return float(low), float(high)


def dose_intervals(per_seed: DataFrame, keys, repetitions: int, level: float, master: int) -> DataFrame:
    """keys, dose, mean_raw, mean, and bootstrap bands of both, sign consistency and the number of seeds.

    per_seed: keys, dose, seed, effect, standardised, a row for each seed (dose_effects()). A group's
    seeds, few, are resampled in one task; with a missing standardised effect its measures are missing.
    """
    keys, of = list(keys), ["mean_raw", "raw_low", "raw_high", "mean", "low", "high", "consistency"]
    kinds = ", ".join(f"{k} {per_seed.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seed")
        names = [table[k][0].as_py() for k in (*keys, "dose")]
        raw, std = (table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float) for c in ("effect", "standardised"))
        found = [float(raw.mean()), *_mean_band(raw, repetitions, level, stable_seed(master, "dose", *names, "raw"))]
        if np.isfinite(std).all():
            mean = float(std.mean())
            found += [mean, *_mean_band(std, repetitions, level, stable_seed(master, "dose", *names, "std")), float((np.sign(std) == np.sign(mean)).mean())]
        else:
            found += [None] * 4
        return pa.table({k: table[k].slice(0, 1) for k in (*keys, "dose")} | {n: pa.array([v], pa.float64()) for n, v in zip(of, found, strict=True)} | {"seeds": pa.array([len(raw)], pa.int64())})

    rows = per_seed.select(*keys, "dose", "seed", "effect", "standardised")
    return rows.groupBy(*keys, "dose").applyInArrow(run, f"{kinds}, dose double, {', '.join(f'{n} double' for n in of)}, seeds long")


def dose_slopes(per_seed: DataFrame, keys, repetitions: int, level: float, master: int) -> DataFrame:
    """keys, slope, slope_low, slope_high, unit: the slope over the five normalised doses, and its band.

    Seeds are resampled with all their doses (unit paired_seeds). Where seeds lack doses, the residuals of
    the fit to the dose means are (dose_point_residuals). A missing effect leaves all missing (not_estimable).
    """
    keys = list(keys)
    kinds = ", ".join(f"{k} {per_seed.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        seed, dose, y = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("seed", "dose", "standardised"))
        y, a = y.astype(float), (1 - level) / 2
        doses, j = np.unique(dose, return_inverse=True)
        seeds, i = np.unique(seed, return_inverse=True)
        if len(doses) != 5:
            raise ValueError(f"{len(doses)} doses instead of five")
        rng = np.random.default_rng(stable_seed(master, "dose_slope", *[table[k][0].as_py() for k in keys]))
        x = doses - doses.mean()
        slope_of = lambda m: m @ x / (x @ x)
        means = np.array([y[j == d].mean() for d in range(5)])
        wide = np.full((len(seeds), 5), np.nan)
        wide[i, j] = y
        if not np.isfinite(y).all():
            found, unit = [None, None, None], "not_estimable"
        else:
            slope = slope_of(means)
            if np.isfinite(wide).all():
                boot = slope_of(wide[rng.integers(0, len(seeds), size=(repetitions, len(seeds)))].mean(axis=1))
                unit = "paired_seeds"
            else:
                fit = means.mean() + slope * x
                boot = slope_of(fit + (means - fit)[rng.integers(0, 5, size=(repetitions, 5))])
                unit = "dose_point_residuals"
            found = [float(slope), *map(float, np.quantile(boot, [a, 1 - a]))]
        out = {n: pa.array([v], pa.float64()) for n, v in zip(("slope", "slope_low", "slope_high"), found, strict=True)}
        return pa.table({k: table[k].slice(0, 1) for k in keys} | out | {"unit": pa.array([unit])})

    rows = per_seed.select(*keys, "dose", "seed", "standardised")
    return rows.groupBy(*keys).applyInArrow(run, f"{kinds}, slope double, slope_low double, slope_high double, unit string")


def dose_nodes(scales: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """parameter, node_id: micro nodes that a parameter drives, the meso nodes they lead to, and the macro nodes those do."""
    of = lambda s, name: scales.filter(F.col("scale") == s).select(F.col("node_id").alias(name))
    step = edges.select("source", "target").distinct()
    micro = roots.select("parameter", F.col("root").alias("node_id")).distinct().join(of("micro", "node_id"), "node_id").select("parameter", "node_id")
    out, at = [micro], micro
    for scale in SCALES[1:]:
        at = at.join(step, at["node_id"] == step["source"]).select("parameter", F.col("target").alias("node_id")).distinct()
        at = at.join(of(scale, "node_id"), "node_id").select("parameter", "node_id")
        out.append(at)
    return out[0].union(out[1]).union(out[2]).distinct()


def path_doses(paths: DataFrame, trends: DataFrame) -> DataFrame:
    """paths with the dose slope of each of their nodes; trends: parameter, node_id, slope. Only qualified or supported paths have a row."""
    rows = paths.filter("path_temporally_qualified OR path_classification = 'supported'")
    for s in SCALES:
        rows = rows.join(trends.select("parameter", F.col("node_id").alias(s), F.col("slope").alias(f"{s}_trend")), ["parameter", s], "left")
    supported = (F.col("path_classification") == "supported").alias("supported")
    return rows.select("path_id", "parameter", F.col("path_temporally_qualified").alias("qualified"), supported, *[f"{s}_trend" for s in SCALES])


def relations(candidates: DataFrame, edges: DataFrame, tried: DataFrame) -> DataFrame:
    """source, target, direction, temporal, interventions: each candidate edge with its edges found and its attempts, as sorted lists.

    candidates: source, target, direction. Both lists are made before they are joined: no pair is
    multiplied by the other's rows.
    """
    on = ["source", "target"]
    found = edges.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("group", "lag", "beta"))).alias("temporal"))
    told = tried.filter(F.col("parameter").isNotNull()).groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("parameter", "direction", "root", "primary_class"))).alias("interventions"))
    rows = candidates.join(found, on, "left").join(told, on, "left")
    empty = lambda c, df: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    return rows.select(*on, "direction", empty("temporal", found), empty("interventions", told))


def graph_table(edges: DataFrame, cells: DataFrame, by) -> DataFrame:
    """by, candidates, retained, qualification_rate, stability, lag_support, lag_std: of each row of cells (by, candidates), without edges too.

    edges: by, support, lag_support, lag_std. More edges than candidates are an error.
    """
    by = list(by)
    own = edges.groupBy(*by).agg(F.count("*").alias("retained"), F.avg("support").alias("stability"), F.avg("lag_support").alias("lag_support"), F.avg("lag_std").alias("lag_std"))
    rows = cells.join(own, by, "left").withColumn("retained", F.coalesce("retained", F.lit(0).cast("long")))
    rate = F.when(F.col("retained") > F.greatest("candidates", F.lit(1)), F.raise_error(F.lit("more edges than candidates")).cast("double")).otherwise(
        F.col("retained") / F.greatest("candidates", F.lit(1))
    )
    return rows.select(*by, "candidates", "retained", rate.alias("qualification_rate"), "stability", "lag_support", "lag_std")


def scale_pairs(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """source, target of all pairs of neighbouring scales, micro to meso and meso to macro, that are not among existing. nodes: node_id, scale.

    Each node meets those of the next scale only: an equi-join on the scale's place.
    """
    place = F.when(F.col("scale") == "micro", 0).when(F.col("scale") == "meso", 1).when(F.col("scale") == "macro", 2)
    at = nodes.select("node_id", place.alias("_p")).filter("_p IS NOT NULL").distinct()
    pairs = at.select(F.col("node_id").alias("source"), (F.col("_p") + 1).alias("_p")).join(at.withColumnRenamed("node_id", "target"), "_p").select("source", "target")
    return pairs if existing is None else pairs.join(existing.select("source", "target").distinct(), ["source", "target"], "left_anti")


def best_generation(generations: DataFrame, by=()) -> DataFrame:
    """The generation of each `by` of most diverse sources, parameters driven, meso structures and macro concepts, then of fewest repairs, then of the least hash."""
    order = [F.desc("source_diversity"), F.desc("direct_parameters"), F.desc("meso_diversity"), F.desc("macro_diversity"), F.asc("repair_rounds"), F.asc("hash")]
    return generations.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_k = 1").drop("_k")


def in_order(df: DataFrame, *keys: str, scale: str | None = None) -> DataFrame:
    """df sorted by keys, and by scale from micro to macro where named: one range shuffle, for the sink."""
    place = [] if scale is None else [F.array_position(F.array(*map(F.lit, SCALES)), F.col(scale))]
    return df.orderBy(*keys, *place)


def one_table(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are missing there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
