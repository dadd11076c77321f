"""Secondary analyses: dose response, holdout confirmation, attenuation, recovery, funnels, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.nulls import TINY, correlation
from driftline.functions.stats import stable_seed
from driftline.operators import discovery
from driftline.operators.windows import average_rank, circular_shift

#: Places of the five doses on the normalised scale.
DOSES = {"minus": -1.0, "mid_minus": -0.5, "base": 0.0, "mid_plus": 0.5, "plus": 1.0}


def dose_levels(minus: float, base: float, plus: float) -> dict[str, float]:
    """Five doses: the given three and the means between them."""
    if not minus < base < plus:
        raise ValueError("doses must rise")
    return {"minus": minus, "mid_minus": (minus + base) / 2, "base": base, "mid_plus": (base + plus) / 2, "plus": plus}


def dose_summary(effects: DataFrame, keys) -> DataFrame:
    """keys, slope, rho, monotone, adjacent, delta_r2, nonlinear of effects (keys, dose, effect) at five doses.

    dose is the normalised one (-1 to 1 by halves), on which the gain of a quadratic has a closed
    form. A group with a missing effect has missing measures; another number of doses is an error.
    """
    part = Window.partitionBy(*keys)
    full = effects.withColumns({"_n": F.count("*").over(part), "_k": F.count("effect").over(part)})
    bad = full.filter("_n <> 5").head(1)
    if bad:
        raise ValueError(f"incomplete five-point dose grid: {bad[0].asDict()}")
    ordered = part.orderBy("dose")
    full = full.withColumns(
        {"_rank": average_rank(F.col("effect"), part), "_place": F.row_number().over(ordered).cast("double"), "_last": F.lag("effect").over(ordered)}
    )
    own = full.groupBy(*keys).agg(
        F.max("_k").alias("_k"),
        F.regr_slope("effect", "dose").alias("slope"),
        correlation(F.col("_rank"), F.col("_place")).alias("_rho"),
        (F.var_pop("effect") * 5).alias("_sst"),
        F.sum(F.col("effect") * (F.col("dose") * F.col("dose") - 0.5)).alias("_q"),
        F.collect_list(F.col("effect") - F.col("_last")).alias("_steps"),
        F.sort_array(F.collect_list(F.struct("dose", "effect"))).alias("_points"),
    )
    sign = F.signum("slope")
    pairs = F.flatten(
        F.transform("_points", lambda a: F.transform(F.filter("_points", lambda b: b["dose"] > a["dose"]), lambda b: b["effect"] - a["effect"]))
    )
    def share(steps):
        agree = F.size(F.filter(steps, lambda s: F.when(sign == 0, F.abs(s) <= 1e-8).otherwise(sign * s >= 0)))
        return agree / F.size(steps)

    known = F.col("_k") == 5
    delta = F.when(F.col("_sst") <= 1e-15, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_q") * F.col("_q") / 0.875 / F.col("_sst")))
    return own.select(
        *keys,
        F.when(known, F.col("slope")).alias("slope"),
        F.when(known & (F.col("_sst") > 1e-15), F.col("_rho")).alias("rho"),
        F.when(known, share(pairs)).alias("monotone"),
        F.when(known, share(F.col("_steps"))).alias("adjacent"),
        F.when(known, delta).alias("delta_r2"),
        F.when(known, delta > 0.05).alias("nonlinear"),
    )


def confirm_holdout(frozen: DataFrame, holdout: DataFrame, keys, verdict: str = "path_classification") -> DataFrame:
    """frozen with confirmation: what the holdout's verdict of the same keys says; inconclusive without one."""
    c = F.col("_v")
    told = (
        F.when(c == "supported", "confirmed")
        .when(c == "manipulation_failure", "manipulation_failure")
        .when(c.isin("contradicted", "directionally_contradicted", "no_stable_downstream_effect"), "failed_confirmation")
        .otherwise("inconclusive")
    )
    return frozen.join(holdout.select(*keys, F.col(verdict).alias("_v")), list(keys), "left").withColumn("confirmation", told).drop("_v")


def attenuation(effects: DataFrame, keys) -> DataFrame:
    """keys, retained, attenuation of effects (keys, baseline, disabled): 1 - |disabled| / |baseline|; missing for no effect."""
    ratio = F.when(F.abs("baseline") > TINY, F.abs("disabled") / F.abs("baseline"))
    return effects.select(*keys, "baseline", "disabled", ratio.alias("retained"), (1 - ratio).alias("attenuation"))


def recovery(truth: DataFrame, found: DataFrame, by=()) -> DataFrame:
    """by, precision, recall, f1, shd, lag_mae, direction_accuracy, stability, retained of found edges (by, source, target, lag, beta, support).

    Lag errors count for edges found at a lag, directions for those found with a finite coefficient
    other than 0; stability is the mean support of all edges found.
    """
    on = [*by, "source", "target"]
    a = truth.select(*on, F.col("lag").alias("_tl"), F.col("beta").alias("_tb"), F.lit(True).alias("_t"))
    b = found.select(*on, F.col("lag").alias("_fl"), F.col("beta").alias("_fb"), F.col("support").alias("_fs"), F.lit(True).alias("_f"))
    both = F.col("_t") & F.col("_f")
    hit, missed, extra = F.count_if(F.coalesce(both, F.lit(False))), F.count_if(F.col("_f").isNull()), F.count_if(F.col("_t").isNull())
    p, r = hit / F.greatest(hit + extra, F.lit(1)), hit / F.greatest(hit + missed, F.lit(1))
    signed = ~F.isnan("_fb") & (F.col("_fb") != 0) & (F.abs("_fb") < float("inf"))
    return (
        a.join(b, on, "full")
        .groupBy(*by)
        .agg(
            p.alias("precision"),
            r.alias("recall"),
            F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
            (missed + extra).alias("shd"),
            F.avg(F.when(both & (F.col("_fl") > 0), F.abs(F.col("_fl") - F.col("_tl")).cast("double"))).alias("lag_mae"),
            F.avg(F.when(both & signed, (F.signum("_fb") == F.signum("_tb")).cast("double"))).alias("direction_accuracy"),
            F.avg("_fs").alias("stability"),
            F.count("_f").alias("retained"),
        )
    )


def path_funnel(paths: DataFrame, by=()) -> DataFrame:
    """by, candidates, qualified, supported, contradicted and their shares of the candidates."""
    n = F.count("*")
    steps = {
        "qualified": F.count_if("path_temporally_qualified"),
        "supported": F.count_if(F.col("path_classification") == "supported"),
        "contradicted": F.count_if(F.col("path_classification") == "contradicted"),
    }
    cols = [n.alias("candidates")]
    for name, c in steps.items():
        cols += [c.alias(name), (c / F.greatest(n, F.lit(1))).alias(f"{name}_rate")]
    return paths.groupBy(*by).agg(*cols)


def verdict_rates(verdicts: DataFrame, column: str = "edge_class", by=()) -> DataFrame:
    """by, applicable, support_rate, contradiction_rate: shares over verdicts that are applicable."""
    c = F.col(column)
    n = F.count_if(c != "not_applicable")
    of = lambda name: F.when(n > 0, F.count_if(c == name) / n)
    return verdicts.groupBy(*by).agg(n.alias("applicable"), of("supported").alias("support_rate"), of("directionally_contradicted").alias("contradiction_rate"))


def jaccard(sets: DataFrame, key: str, items: str) -> DataFrame:
    """a, b, jaccard of each pair of sets (key, items: array) with a before b; 1 for two empty sets."""
    left = sets.select(F.col(key).alias("a"), F.col(items).alias("_x"))
    right = sets.select(F.col(key).alias("b"), F.col(items).alias("_y"))
    union = F.size(F.array_union("_x", "_y"))
    # generations are few: every pair is the result
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("_x", "_y")) / union).alias("jaccard"))


def edges_of_paths(paths: DataFrame) -> DataFrame:
    """source, target, direction, groups, path_ids: the two edges of each path, those of several paths as one.

    paths: path_id, micro, meso, macro, micro_meso_direction, meso_macro_direction. Edges whose paths
    differ in direction are mixed.
    """
    steps = F.explode(
        F.array(
            F.struct(F.col("micro").alias("source"), F.col("meso").alias("target"), F.col("micro_meso_direction").alias("d")),
            F.struct(F.col("meso").alias("source"), F.col("macro").alias("target"), F.col("meso_macro_direction").alias("d")),
        )
    )
    rows = paths.select("path_id", F.concat(F.lit("macro_outcome_"), "macro").alias("g"), steps.alias("e"))
    return rows.groupBy(F.col("e.source").alias("source"), F.col("e.target").alias("target")).agg(
        F.when(F.min("e.d") == F.max("e.d"), F.min("e.d")).otherwise("mixed").alias("direction"),
        F.array_sort(F.collect_set("g")).alias("groups"),
        F.array_sort(F.collect_set("path_id")).alias("path_ids"),
    )


def shifted_parents(series: DataFrame, parents, least: int, most: int, master: int = 0, repetition: int = 0) -> DataFrame:
    """seed, node_id, time, value: series of parents turned round by least to most steps, each by a draw of its own."""
    kind = series.schema["seed"].dataType.simpleString()
    every = series.select("seed", "node_id").distinct()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            seeds, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [int(np.random.default_rng(stable_seed(master, "shift", repetition, s, n)).integers(least, most + 1)) if n in parents else 0 for s, n in zip(seeds, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], ["seed", "node_id", "shift"])

    shifts = every.mapInArrow(run, f"seed {kind}, node_id string, shift int")
    return circular_shift(series.select("seed", "node_id", "time", "value"), ["seed", "node_id"], "value", shifts)


def shifted_repetitions(series: DataFrame, parents, least: int, most: int, master: int, repetitions: int) -> DataFrame:
    """cell, seed, node_id, time, value: shifted_parents() of each repetition as a cell, and the series as it is as cell -1.

    A table of shifts, a row for each (cell, seed, node), is joined once: the series is read once for all.
    """
    kind = series.schema["seed"].dataType.simpleString()
    own = series.select("seed", "node_id", "time", "value")
    every = own.groupBy("seed", "node_id").agg(F.count("*").alias("_n"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for seed, node, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((-1, seed, node, n, 0))
                for r in range(repetitions):
                    draw = int(np.random.default_rng(stable_seed(master, "shift", r, seed, node)).integers(least, most + 1)) if node in parents else 0
                    rows.append((r, seed, node, n, draw))
            types = (pa.int32(), batch.schema.field(0).type, pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], ["cell", "seed", "node_id", "_n", "_shift"])

    shifts = every.mapInArrow(run, f"cell int, seed {kind}, node_id string, _n long, _shift int")
    time = F.pmod(F.col("time") + F.col("_shift"), F.col("_n")).cast(series.schema["time"].dataType)
    return own.join(shifts, ["seed", "node_id"]).select("cell", "seed", "node_id", time.alias("time"), "value")


def negative_control(
    series: DataFrame, pairs, lag: int, parent_alpha: float, fdr_alpha: float, replicates: int, support: float, least: int, most: int, master: int = 0, repetition: int = 0
) -> DataFrame:
    """The bootstrap graph of series whose parents, the sources of pairs, are turned round by more steps than the lag."""
    if least <= lag or most < least:
        raise ValueError("shifts must be longer than the lag")
    turned = shifted_parents(series, {s for s, _, _ in pairs}, least, most, master, repetition)
    return discovery.bootstrap_graph(turned, pairs, lag, parent_alpha, fdr_alpha, replicates, support, master, f"negative:{repetition}")[0]


def bootstrap_mean(values: DataFrame, keys, value: str, replicates: int, level: float, master: int, label: str) -> DataFrame:
    """keys, mean, low, high: percentile bounds of the mean over resamples of the rows' seeds.

    values has one row for each (keys, seed), with the same seeds in every group. The draws are a
    table of replicates x seeds counts, joined on seed: no group is gathered.
    """
    import numpy as np

    from driftline.functions.stats import draws

    spark = values.sparkSession
    seeds = sorted(r["seed"] for r in values.select("seed").distinct().collect())
    table = []
    for r, row in enumerate(draws(master, label, replicates, len(seeds)) if seeds else []):
        table += [(r, seeds[i], float(n)) for i, n in zip(*np.unique(row, return_counts=True), strict=True)]
    weights = spark.createDataFrame(table, f"replicate int, seed {values.schema['seed'].dataType.simpleString()}, w double")
    a = (1 - level) / 2
    means = values.join(weights, "seed").groupBy(*keys, "replicate").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("_m"))
    bounds = means.groupBy(*keys).agg(F.percentile("_m", F.lit(a)).alias("low"), F.percentile("_m", F.lit(1 - a)).alias("high"))
    return values.groupBy(*keys).agg(F.avg(value).alias("mean")).join(bounds, list(keys))


def dose_effects(runs: DataFrame, keys, base: float, evaluation_start: int) -> DataFrame:
    """keys, dose, seed, effect, standardised: mean difference from the base dose of the same seed and time.

    runs: keys, dose, seed, time, value. standardised is over the spread of the base dose's values;
    missing without one. A seed whose doses don't have the base dose's times is an error; seeds without a base
    dose are left out.
    """
    late = runs.filter(F.col("time") >= evaluation_start)
    centre = late.filter(F.col("dose") == base).select(*keys, "seed", "time", F.col("value").alias("_b"))
    centre = centre.withColumns({"_m": F.lit(1), "_n": F.count("*").over(Window.partitionBy(*keys, "seed"))})
    spread = centre.groupBy(*keys).agg(F.stddev_samp("_b").alias("_sd"))
    per = late.join(centre, [*keys, "seed", "time"], "left").groupBy(*keys, "dose", "seed")
    per = per.agg(F.avg(F.col("value") - F.col("_b")).alias("effect"), F.count("*").alias("_own"), F.count("_m").alias("_met"), F.max("_n").alias("_n"))
    same = (F.col("_own") == F.col("_met")) & (F.col("_met") == F.col("_n"))
    other = F.raise_error(F.concat(F.lit("times differ from the base dose's: seed "), F.col("seed").cast("string"), F.lit(", dose "), F.col("dose").cast("string")))
    per = per.join(centre.select(*keys, "seed").distinct(), [*keys, "seed"], "left_semi").withColumn("effect", F.when(same, F.col("effect")).otherwise(other.cast("double")))
    return per.join(spread, list(keys)).select(*keys, "dose", "seed", "effect", F.when(F.col("_sd") > TINY, F.col("effect") / F.col("_sd")).alias("standardised"))


def path_timing(qualified: DataFrame, effects: DataFrame, tolerance: int) -> DataFrame:
    """path_id, scale, node_id, onset_time, observational_lag, response_delay, lag_difference, concordant of qualified paths.

    Paths for which one of the three nodes has no effect row are left out. Timing decides nothing.
    """
    own = qualified.filter("path_temporally_qualified").select("path_id", "parameter", "direction", "micro", "meso", "macro", "micro_meso_lag", "meso_macro_lag")
    rows = own.select(
        "path_id", "parameter", "direction",
        F.explode(
            F.array(
                F.struct(F.lit("micro").alias("scale"), F.col("micro").alias("node_id"), F.lit(0).alias("_k"), F.lit(None).cast("int").alias("observational_lag")),
                F.struct(F.lit("meso").alias("scale"), F.col("meso").alias("node_id"), F.lit(1).alias("_k"), F.col("micro_meso_lag").cast("int").alias("observational_lag")),
                F.struct(F.lit("macro").alias("scale"), F.col("macro").alias("node_id"), F.lit(2).alias("_k"), F.col("meso_macro_lag").cast("int").alias("observational_lag")),
            )
        ).alias("s"),
    ).select("path_id", "parameter", "direction", "s.*")
    found = rows.join(effects.select("parameter", "direction", "node_id", "onset_time", "significant", "cumulative_effect_standardised"), ["parameter", "direction", "node_id"])
    part = Window.partitionBy("path_id", "parameter", "direction")
    before = F.lag("onset_time").over(part.orderBy("_k"))
    delay = F.when((F.col("onset_time") >= 0) & (before >= 0), F.col("onset_time") - before)
    return (
        found.withColumns({"_n": F.count("*").over(part), "response_delay": delay})
        .filter("_n = 3")
        .withColumn("lag_difference", F.col("response_delay") - F.col("observational_lag"))
        .withColumn("concordant", F.abs("lag_difference") <= tolerance)
        .drop("_n")
    )


def propagating_paths(timing: DataFrame, evidence: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """path_id of paths whose three responses are significant, in order of onset, and whose edges are supported.

    timing: path_timing(). evidence: parameter, direction, root, source, target, edge_class; paths:
    path_id, parameter, direction, micro, meso, macro. Without evidence the timing alone decides.
    """
    good = (
        timing.groupBy("path_id", "parameter", "direction")
        .agg(
            F.count("*").alias("n"),
            F.min("significant").alias("all"),
            F.min("onset_time").alias("first"),
            F.array_sort(F.collect_list(F.struct("_k", "onset_time"))).alias("o"),
        )
        .filter((F.col("n") == 3) & F.col("all") & (F.col("first") >= 0) & (F.col("o")[0]["onset_time"] <= F.col("o")[1]["onset_time"]) & (F.col("o")[1]["onset_time"] <= F.col("o")[2]["onset_time"]))
        .select("path_id", "parameter", "direction")
    )
    if evidence is None:
        return good.select("path_id").distinct()
    own = evidence.filter("edge_class = 'supported'")
    steps = good.join(paths, ["path_id", "parameter", "direction"])
    for a, b in (("micro", "meso"), ("meso", "macro")):
        edge = own.select("parameter", "direction", F.col("root").alias("micro"), F.col("source").alias(f"_{a}"), F.col("target").alias(b))
        edge = edge.withColumnRenamed("_meso", "meso") if a == "meso" else edge.filter("_micro = micro").drop("_micro")
        steps = steps.join(edge.distinct(), [c for c in edge.columns if c in steps.columns], "left_semi")
    return steps.select("path_id").distinct()


def representatives(paths: DataFrame, by) -> DataFrame:
    """by, path_id: a supported and confirmed path before a supported one, then the first by path_id; else missing.

    paths: by, path_id, path_classification, confirmation.
    """
    supported = F.col("path_classification") == "supported"
    key = F.struct((F.col("confirmation") != "confirmed").alias("a"), F.col("path_id").alias("b"))
    return paths.groupBy(*by).agg(F.min(F.when(supported, key)).alias("_k")).select(*by, F.col("_k.b").alias("path_id"), (~F.col("_k.a")).alias("confirmed"))


def bidirectional(effects: DataFrame, keys, measures=("cumulative_effect_standardised", "onset_time", "significant")) -> DataFrame:
    """keys and a column direction_scale_measure for each: effects of both directions and all scales side by side.

    Without a row an effect is missing, an onset -1 and a significance false.
    """
    rest = {"onset_time": F.lit(-1), "significant": F.lit(False)}
    cols = []
    for d in ("minus", "plus"):
        for s in ("micro", "meso", "macro"):
            for m in measures:
                c = F.max(F.when((F.col("direction") == d) & (F.col("scale") == s), F.col(m)))
                cols.append((F.coalesce(c, rest[m]) if m in rest else c).alias(f"{d}_{s}_{m}"))
    return effects.groupBy(*keys).agg(*cols)


def node_means(series: DataFrame, keys, condition: str = "condition", baseline: str = "baseline", disabled: str = "mechanism_disabled") -> DataFrame:
    """keys, baseline, disabled, difference: means of a node under both conditions."""
    of = lambda c: F.avg(F.when(F.col(condition) == c, F.col("value")))
    return series.groupBy(*keys).agg(of(baseline).alias("baseline"), of(disabled).alias("disabled")).withColumn("difference", F.col("disabled") - F.col("baseline"))


def intervention_recovery(truth: DataFrame, eligible: DataFrame, supported: DataFrame) -> DataFrame:
    """precision, recall, eligible_recall of supported edges (source, target): recall over all true edges and over eligible ones."""
    flag = lambda df, n: df.select("source", "target", F.lit(True).alias(n)).distinct()
    on = ["source", "target"]
    j = flag(truth, "t").join(flag(eligible, "e"), on, "full").join(flag(supported, "s"), on, "full")
    yes = lambda *names: F.count_if(F.coalesce(F.expr(" AND ".join(names)), F.lit(False)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return j.agg(share(yes("t", "s"), yes("s")).alias("precision"), share(yes("t", "s"), yes("t")).alias("recall"), share(yes("t", "e", "s"), yes("t", "e")).alias("eligible_recall"))


def prospective(predictions: DataFrame, paths: DataFrame) -> DataFrame:
    """predictions (prediction_id, path_id) with the classification of their path; each prediction has one path."""
    repeated = predictions.groupBy("prediction_id").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError("a prediction has several paths")
    return predictions.join(paths.select("path_id", "path_classification"), "path_id", "left").withColumn("path_classification", F.coalesce("path_classification", F.lit("inconclusive")))
