"""Paired effects of interventions, their confidence bands and onsets, and what they say of edges and paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.nulls import TINY
from driftline.functions.stats import stable_seed
from driftline.operators.components import kept

CONFIG = {
    "bootstrap_repetitions": 500,
    "confidence_level": 0.95,
    "minimum_standardised_effect": 0.1,
    "onset_detection_start": 0,
    "onset_consecutive_steps": 4,
    "evaluation_start": 15,
    "terminal_window": 10,
    "master_seed": 0,
}
#: Seeds and times of an effect that one task resamples.
SEEDS, TIMES = 1024, 64
SUMMARY = (
    "cumulative_effect_standardised double, cumulative_ci_low double, cumulative_ci_high double, cumulative_effect_raw double, "
    "cumulative_raw_ci_low double, cumulative_raw_ci_high double, baseline_sd double, terminal_effect_standardised double, "
    "onset_time int, onset_ci_low double, onset_ci_high double, peak_time int, effect_sign int, sign_consistency double, "
    "significant boolean, estimable boolean"
)


def pair_runs(baseline: DataFrame, intervention: DataFrame, by, on=("seed", "time", "node_id"), check: bool = True) -> DataFrame:
    """by, on, baseline, value, difference: equal rows of both (value columns); ValueError where seeds differ.

    by: columns of the intervention that the baseline lacks.
    """
    shared = [c for c in intervention.columns if c in baseline.columns and c != "value" and c not in by]
    left = baseline.select(*shared, F.col("value").alias("baseline"))
    if check:
        a, b = baseline.select("seed").distinct(), intervention.select(*by, "seed").distinct()
        expected = intervention.select(*by).distinct().crossJoin(a)  # conditions by seeds, the rows that must be there
        if not expected.join(b, [*by, "seed"], "left_anti").isEmpty() or not b.join(a, "seed", "left_anti").isEmpty():
            raise ValueError("baseline and intervention have different seeds")
    return intervention.join(left, shared).select(*by, *shared, "baseline", "value", (F.col("value") - F.col("baseline")).alias("difference"))


def unpaired(baseline: DataFrame, master: int, *label) -> DataFrame:
    """baseline with its seeds dealt anew by a random permutation, so that pairs share nothing but time and node."""
    spark, kind = baseline.sparkSession, baseline.schema["seed"].dataType.simpleString()
    seeds = sorted(r["seed"] for r in baseline.select("seed").distinct().collect())  # few
    order = np.random.default_rng(stable_seed(master, "unpaired", *label)).permutation(len(seeds))
    moved = spark.createDataFrame([(seeds[j], seeds[i]) for i, j in enumerate(order)], f"seed {kind}, _to {kind}")
    return baseline.join(moved, "seed").drop("seed").withColumnRenamed("_to", "seed").select(*baseline.columns)


def mean_effects(pairs: DataFrame, keys, evaluation_start: int) -> DataFrame:
    """keys, raw, baseline_sd, standardised: mean difference from evaluation_start on, and over the baseline's spread."""
    late = F.col("time") >= evaluation_start
    by_seed = pairs.filter(late).groupBy(*keys, "seed").agg(F.avg("difference").alias("_d"))
    spread = pairs.filter(late).groupBy(*keys).agg(F.stddev_samp("baseline").alias("baseline_sd"))
    raw = by_seed.groupBy(*keys).agg(F.avg("_d").alias("raw"))
    return raw.join(spread, list(keys)).select(*keys, "raw", "baseline_sd", F.when(F.col("baseline_sd") > TINY, F.col("raw") / F.col("baseline_sd")).alias("standardised"))


def _blocks(pairs: DataFrame, keys: list, start: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the times that every seed of their effect has (keys, seed, time, difference, _i: the seed's place, _n: their number), and each effect's baseline_sd.

    Repeated rows count with their mean, NaN as missing; effects with a null key take no part.
    """
    number = lambda c: F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c)
    rows = pairs.groupBy(*keys, "seed", F.col("time").cast("long").alias("time")).agg(number("baseline"), number("difference"))
    effect = Window.partitionBy(*keys)  # a row for each seed, not for each time
    places = rows.select(*keys, "seed").distinct().withColumns({"_i": F.row_number().over(effect.orderBy("seed")) - 1, "_n": F.count("*").over(effect)})
    whole = F.count("difference").over(Window.partitionBy(*keys, "time")) == F.col("_n")
    rows = kept(rows.join(places, [*keys, "seed"]).withColumn("_whole", whole), "effects")
    own = F.when(F.col("_whole") & (F.col("time") >= start), F.col("baseline"))
    return rows.filter("_whole").drop("_whole", "baseline"), rows.groupBy(*keys).agg(F.stddev_samp(own).alias("baseline_sd"))


def _resampled(rows: DataFrame, keys: list, config: dict) -> DataFrame:
    """keys, time, replicate, mean: the mean difference of all seeds, replicate 0, and of resamples of whole seeds.

    A task holds SEEDS seeds at TIMES times of an effect and gives their part of each mean. All nodes of
    one parameter and direction share the draws, which a task makes anew, a replicate at a time.
    """
    replicates, named = config["bootstrap_repetitions"], [k for k in keys if k != "node_id"]

    def run(table: pa.Table) -> pa.Table:
        i, time, diff = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("_i", "time", "difference"))
        n, low = table["_n"][0].as_py(), table["_s"][0].as_py() * SEEDS
        times, j = np.unique(time, return_inverse=True)
        part = np.zeros((min(SEEDS, n - low), len(times)))
        part[i - low, j] = diff
        rng = np.random.default_rng(stable_seed(config["master_seed"], "effect", *(table[k][0].as_py() for k in named)))
        weights = np.ones((replicates + 1, len(part)))
        for r in range(1, replicates + 1):
            weights[r] = np.bincount(rng.integers(0, n, size=n), minlength=n)[low : low + len(part)]
        sums = weights @ part / n
        out = {k: pa.array([table[k][0].as_py()] * sums.size, table[k].type) for k in keys}
        out |= {"time": np.tile(times, len(sums)), "replicate": np.repeat(np.arange(len(sums), dtype=np.int32), len(times)), "part": sums.ravel()}
        return pa.table(out)

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    dealt = rows.withColumns({"_s": F.floor(F.col("_i") / SEEDS), "_t": F.floor(F.col("time") / TIMES)})
    parts = dealt.groupBy(*keys, "_s", "_t").applyInArrow(run, f"{kinds}, time long, replicate int, part double")
    return parts.groupBy(*keys, "time", "replicate").agg(F.sum("part").alias("mean"))


def _scale() -> Column:
    """The baseline's spread, null where it is none to measure by."""
    return F.when(F.col("baseline_sd") > TINY, F.col("baseline_sd"))


def _courses(means: DataFrame, spread: DataFrame, keys: list, config: dict) -> DataFrame:
    """keys, time, raw, _band of raw means, baseline_sd, significant."""
    low, limit = (1 - config["confidence_level"]) / 2, config["minimum_standardised_effect"]
    again = F.when(F.col("replicate") > 0, F.col("mean"))
    courses = means.groupBy(*keys, "time").agg(F.max(F.when(F.col("replicate") == 0, F.col("mean"))).alias("raw"), F.percentile(again, [low, 1 - low]).alias("_band"))
    beyond = (F.col("_band")[0] / _scale() > limit) | (F.col("_band")[1] / _scale() < -limit)
    return courses.join(spread, keys).withColumn("significant", F.coalesce(beyond, F.lit(False)))


def _first_run(rows: DataFrame, by: list, sign: Column, config: dict) -> DataFrame:
    """rows with _starts: its time, if from it on enough steps in a row have one sign."""
    n = config["onset_consecutive_steps"]
    ahead = Window.partitionBy(*by).orderBy("time").rowsBetween(0, n - 1)
    same = (F.min("_sign").over(ahead) == F.max("_sign").over(ahead)) & (F.count("_sign").over(ahead) == n) & (F.col("_sign") != 0)
    return rows.withColumn("_sign", sign).withColumn("_starts", F.when(same & (F.col("time") >= config["onset_detection_start"]), F.col("time")))


def effect_summaries(pairs: DataFrame, keys=("scenario", "parameter", "direction", "node_id"), config: dict | None = None) -> DataFrame:
    """keys and SUMMARY: effects of paired runs with bands from resamples of seeds.

    Means of resamples are made of blocks of seeds and times (_resampled); bands, onsets and peaks are
    aggregates of them, so no task holds an effect's runs. Starts, onsets and peaks are times, not places;
    times that not every seed has are left out. What there is of an effect without such times is null.
    """
    config, keys = CONFIG | (config or {}), list(keys)
    low, limit = (1 - config["confidence_level"]) / 2, config["minimum_standardised_effect"]
    rows, spread = _blocks(pairs, keys, config["evaluation_start"])
    means = kept(_resampled(rows, keys, config), "effects")
    late, sd = F.col("time") >= config["evaluation_start"], _scale()

    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("time"))) <= config["terminal_window"]
    course = _first_run(_courses(means, spread, keys, config), keys, F.when(F.col("significant"), F.signum("raw")).otherwise(0.0), config)
    found = course.withColumn("_last", last).groupBy(*keys).agg(
        F.avg(F.when(late, F.col("raw"))).alias("_raw"),
        F.avg(F.when(F.col("_last"), F.col("raw"))).alias("_terminal"),
        F.min("_starts").alias("_onset"),
        F.min_by("time", F.when(late, F.struct(-F.abs("raw"), "time"))).alias("_peak"),
    )
    loud = F.when(F.abs(F.col("mean") / sd) >= limit, F.signum("mean")).otherwise(0.0)
    again = _first_run(means.filter("replicate > 0").join(spread, keys), [*keys, "replicate"], loud, config)
    again = again.groupBy(*keys, "replicate").agg(F.avg(F.when(late, F.col("mean"))).alias("_m"), F.min("_starts").alias("_at"))
    again = again.groupBy(*keys).agg(F.percentile("_m", [low, 1 - low]).alias("_band"), F.percentile("_at", [low, 1 - low]).alias("_onsets"))
    by_seed = rows.filter(late).groupBy(*keys, "seed").agg(F.avg("difference").alias("_d"))
    agree = by_seed.join(found.select(*keys, "_raw"), keys).groupBy(*keys).agg(F.avg((F.signum("_d") == F.signum("_raw")).cast("double")).alias("_agree"))

    raw, band = F.col("_raw"), F.col("_band")
    good = sd.isNotNull() & raw.isNotNull()
    told = lambda c: F.when(good, c)
    measures = {
        "cumulative_effect_standardised": told(raw / sd),
        "cumulative_ci_low": told(band[0] / sd),
        "cumulative_ci_high": told(band[1] / sd),
        "cumulative_effect_raw": raw,
        "cumulative_raw_ci_low": band[0],
        "cumulative_raw_ci_high": band[1],
        "baseline_sd": F.col("baseline_sd"),
        "terminal_effect_standardised": told(F.col("_terminal") / sd),
        "onset_time": F.coalesce(told(F.col("_onset")), F.lit(-1)),
        "onset_ci_low": told(F.col("_onsets")[0]),
        "onset_ci_high": told(F.col("_onsets")[1]),
        "peak_time": F.coalesce(told(F.col("_peak")), F.lit(-1)),
        "effect_sign": F.coalesce(told(F.signum(raw)), F.lit(0.0)),
        "sign_consistency": told(F.when(raw != 0, F.col("_agree")).otherwise(0.0)),
        "significant": F.coalesce(told(F.col("_onset").isNotNull() & ((band[0] / sd > limit) | (band[1] / sd < -limit))), F.lit(False)),
        "estimable": good,
    }
    kinds = dict(x.split() for x in SUMMARY.split(", "))
    out = spread.join(found, keys, "left").join(again, keys, "left").join(agree, keys, "left")
    return out.select(*keys, *[c.cast(kinds[n]).alias(n) for n, c in measures.items()])


def effect_curves(pairs: DataFrame, keys=("scenario", "parameter", "direction", "node_id"), config: dict | None = None) -> DataFrame:
    """keys, time, mean_raw, low_raw, high_raw, mean, low, high, significant: an effect's course with its bands."""
    config, keys = CONFIG | (config or {}), list(keys)
    rows, spread = _blocks(pairs, keys, config["evaluation_start"])
    raw = {"mean": F.col("raw"), "low": F.col("_band")[0], "high": F.col("_band")[1]}
    return _courses(_resampled(rows, keys, config), spread, keys, config).select(
        *keys, "time", *[c.alias(f"{n}_raw") for n, c in raw.items()], *[(c / _scale()).alias(n) for n, c in raw.items()], "significant"
    )


def manipulation_routes(edges: DataFrame, scales: DataFrame, roots: DataFrame, paths: DataFrame | None, candidates: DataFrame | None = None) -> DataFrame:
    """source, target, root, parameter, scope: which parameters can move an edge's source.

    scales: node_id, scale. roots: parameter, root (micro indicators that a parameter drives
    directly). paths: micro, meso, macro. A micro-meso edge has its source as root, a meso-macro edge
    the micro indicators of its paths; without paths, those that a candidate edge (source, target) leads
    from to its source.
    """
    s, t = scales.select(F.col("node_id").alias("source"), F.col("scale").alias("_s")), scales.select(F.col("node_id").alias("target"), F.col("scale").alias("_t"))
    typed = edges.select("source", "target").distinct().join(s, "source").join(t, "target")
    direct = typed.filter("_s = 'micro' AND _t = 'meso'").select("source", "target", F.col("source").alias("root"), F.lit("direct_root").alias("scope"))
    if paths is not None:
        on, upstream = ["source", "target"], paths.select(F.col("meso").alias("source"), F.col("macro").alias("target"), F.col("micro").alias("root"))
    else:
        micro = scales.filter("scale = 'micro'").select(F.col("node_id").alias("root"))
        on, upstream = ["source"], candidates.select(F.col("source").alias("root"), F.col("target").alias("source")).join(micro, "root")
    mediated = typed.filter("_s = 'meso' AND _t = 'macro'").join(upstream.distinct(), on).select("source", "target", "root", F.lit("upstream_mediated").alias("scope"))
    return direct.union(mediated).join(roots, "root").select("source", "target", "root", "parameter", "scope").distinct()


def testable_edges(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """The edges that some manipulation can test."""
    return edges.join(routes.select("source", "target").distinct(), ["source", "target"], "left_semi")


def attempts(edges: DataFrame, routes: DataFrame, effects: DataFrame, directions: DataFrame, tolerance: int, gated: bool = False) -> DataFrame:
    """What each manipulation says of each edge: edges x routes x directions, with a class.

    edges: source, target, group, lag, beta. effects: parameter, direction, node_id,
    cumulative_effect_standardised, onset_time, significant. directions: direction. gated asks for
    the expected sign and lag as well.
    """
    fields = ["cumulative_effect_standardised", "onset_time", "significant"]

    def of(role: str) -> DataFrame:
        named = [F.col(c).alias(f"{role}_{n}") for c, n in zip(fields, ("effect", "onset", "moved"), strict=True)]
        return effects.select("parameter", "direction", F.col("node_id").alias(role), F.lit(True).alias(f"{role}_there"), *named)

    tried = edges.join(routes, ["source", "target"], "left")
    tried = tried.join(F.broadcast(directions), F.col("parameter").isNotNull(), "left")
    for role in ("root", "source", "target"):
        tried = tried.join(of(role), ["parameter", "direction", role], "left")
    # an attempt without one of its three effects says nothing of the others
    there = F.coalesce(F.col("root_there") & F.col("source_there") & F.col("target_there"), F.lit(False))
    tried = tried.withColumns({f"{x}_{n}": F.when(there, F.col(f"{x}_{n}")) for x in ("root", "source", "target") for n in ("effect", "onset", "moved")})
    missing = F.col("parameter").isNotNull() & F.col("root_moved").isNull()
    s_on, t_on, r_on = (F.col(f"{x}_onset") for x in ("source", "target", "root"))
    delay = F.when((s_on >= 0) & (t_on >= 0), t_on - s_on)
    ordered = F.coalesce((s_on >= 0) & (t_on >= s_on), F.lit(False))
    expected = F.coalesce(F.signum(F.col("source_effect") * F.col("beta")), F.lit(0.0))
    observed = F.coalesce(F.signum("target_effect"), F.lit(0.0))
    agrees = F.when((expected != 0) & (observed != 0), expected == observed)
    on_time = F.when(delay.isNotNull(), F.abs(delay - F.col("lag")) <= tolerance)
    last: Column
    if gated:
        in_order = F.coalesce((r_on >= 0) & (s_on >= r_on) & (t_on >= s_on) & on_time, F.lit(False))
        last = (
            F.when(expected == 0, "inconclusive")
            .when(~F.coalesce(agrees, F.lit(False)), "directionally_contradicted")
            .when(in_order, "supported")
            .otherwise("inconclusive")
        )
    else:
        last = F.when(ordered, "supported").otherwise("inconclusive")
    verdict = (
        F.when(F.col("parameter").isNull(), "not_applicable")
        .when(missing | F.col("root_effect").isNull(), "inconclusive")
        .when(~F.col("root_moved"), "manipulation_failure")
        .when(F.col("source_effect").isNull() | F.col("target_effect").isNull(), "inconclusive")
        .when(~F.col("source_moved") | ~F.col("target_moved"), "no_stable_downstream_effect")
        .otherwise(last)
    )
    return tried.select(
        "group", "source", "target", "root", "parameter", "direction", "scope", "lag", "beta",
        verdict.alias("primary_class"),
        F.coalesce(F.col("root_moved") & F.col("root_effect").isNotNull(), F.lit(False)).alias("manipulation_success"),
        F.coalesce("source_moved", F.lit(False)).alias("source_significant"),
        F.coalesce("target_moved", F.lit(False)).alias("target_significant"),
        ordered.alias("propagation_order_supported"),
        *[F.coalesce(x, F.lit(-1)).alias(f"{n}_onset") for x, n in ((r_on, "root"), (s_on, "source"), (t_on, "target"))],
        delay.alias("intervention_delay"), (delay - F.col("lag")).alias("lag_difference"),
        agrees.alias("temporal_direction_concordant"), on_time.alias("lag_concordant"),
        "root_effect", "source_effect", "target_effect",
    )


def edge_evidence(tried: DataFrame, keys=("group", "source", "target"), holdout: bool = False) -> DataFrame:
    """keys, edge_class and counts of attempts: one verdict for each edge.

    Contradiction goes before support, support before failure; a failure to move the root counts only
    if every attempt failed so, in a holdout if any did.
    """
    c = F.col("primary_class")
    applies = c != "not_applicable"
    n = F.count_if(applies)
    has = lambda name: F.coalesce(F.max(c == name), F.lit(False))
    failed = has("manipulation_failure") if holdout else F.count_if(c == "manipulation_failure") == n
    verdict = (
        F.when(n == 0, "not_applicable")
        .when(has("directionally_contradicted"), "directionally_contradicted")
        .when(has("supported"), "supported")
        .when(failed, "manipulation_failure")
        .when(has("no_stable_downstream_effect"), "no_stable_downstream_effect")
        .otherwise("inconclusive")
    )
    return tried.groupBy(*keys).agg(
        verdict.alias("edge_class"),
        F.count("*").alias("attempt_count"),
        n.alias("applicable_attempt_count"),
        F.count_if(c == "supported").alias("supported_attempt_count"),
        F.count_if(c == "directionally_contradicted").alias("contradiction_attempt_count"),
    )


def group_of(macro: Column) -> Column:
    return F.concat(F.lit("macro_outcome_"), macro)


def qualified_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (path_id, micro, meso, macro, ...) with both edges of their macro's group, and whether both were retained."""
    out = paths.withColumn("group", group_of(F.col("macro")))
    for name, a, b in (("micro_meso", "micro", "meso"), ("meso_macro", "meso", "macro")):
        own = edges.select("group", F.col("source").alias(a), F.col("target").alias(b), F.lit(True).alias(f"{name}_retained"), *[F.col(c).alias(f"{name}_{c}") for c in ("lag", "beta", "q", "support")])
        out = out.join(own, ["group", a, b], "left").withColumn(f"{name}_retained", F.coalesce(f"{name}_retained", F.lit(False)))
    return out.withColumn("path_temporally_qualified", F.col("micro_meso_retained") & F.col("meso_macro_retained"))


def classify_paths(qualified: DataFrame, tried: DataFrame) -> DataFrame:
    """path_id, path_classification, reason and what they rest on.

    qualified: qualified_paths() of paths that have parameter, direction and expected_micro, _meso and
    _macro (increase or decrease). Classes of edges and lags do not decide.
    """
    def step(name: str, a: str, b: str) -> DataFrame:
        own = tried.filter(F.col("primary_class") != "not_applicable")
        return own.select(
            "parameter", "direction", "group", F.col("root").alias("micro"), F.col("source").alias("_a"), F.col("target").alias("_b"),
            F.struct("manipulation_success", "target_significant", "root_effect", "target_effect", "root_onset", "target_onset").alias(name),
        )

    # of repeated attempts the least in every field
    on = ["parameter", "direction", "group", "micro"]
    first = step("_1", "micro", "meso").filter("_a = micro").groupBy(*on, F.col("_b").alias("meso")).agg(F.min("_1").alias("_1"))
    second = step("_2", "meso", "macro").groupBy(*on, F.col("_a").alias("meso"), F.col("_b").alias("macro")).agg(F.min("_2").alias("_2"))
    joined = qualified.join(first, [*on, "meso"], "left").join(second, [*on, "meso", "macro"], "left")
    effects = [F.col("_1.root_effect"), F.col("_1.target_effect"), F.col("_2.target_effect")]
    onsets = [F.col("_1.root_onset"), F.col("_1.target_onset"), F.col("_2.target_onset")]
    moved = [F.coalesce(c, F.lit(False)) for c in (F.col("_1.manipulation_success"), F.col("_1.target_significant"), F.col("_2.target_significant"))]
    stable = moved[0] & moved[1] & moved[2]
    for e in effects:
        stable = stable & e.isNotNull()
    agrees = F.lit(True)
    for e, x in zip(effects, ("expected_micro", "expected_meso", "expected_macro"), strict=True):
        agrees = agrees & F.coalesce(F.signum(e) == F.when(F.col(x) == "increase", 1.0).otherwise(-1.0), F.lit(False))
    ordered = F.coalesce((onsets[0] >= 0) & (onsets[1] >= onsets[0]) & (onsets[2] >= onsets[1]), F.lit(False))
    q = F.col("path_temporally_qualified")
    verdict = (
        F.when(~q, F.struct(F.lit("inconclusive").alias("c"), F.lit("path_not_temporally_qualified").alias("r")))
        .when(~moved[0], F.struct(F.lit("manipulation_failure").alias("c"), F.lit("required_micro_manipulation_failed").alias("r")))
        .when(~stable, F.struct(F.lit("inconclusive").alias("c"), F.lit("required_multiscale_response_not_stable").alias("r")))
        .when(~agrees, F.struct(F.lit("contradicted").alias("c"), F.lit("frozen_response_direction_contradicted").alias("r")))
        .when(~ordered, F.struct(F.lit("inconclusive").alias("c"), F.lit("intervention_onset_order_not_supported").alias("r")))
        .otherwise(F.struct(F.lit("supported").alias("c"), F.lit("all_criteria_supported").alias("r")))
    )
    return joined.select(
        "path_id", "parameter", "direction", "group", "micro", "meso", "macro", q, moved[0].alias("manipulation_success"),
        moved[1].alias("meso_significant"), moved[2].alias("macro_significant"), agrees.alias("direction_supported"), ordered.alias("onset_order_supported"),
        verdict["c"].alias("path_classification"), verdict["r"].alias("reason"),
    )
