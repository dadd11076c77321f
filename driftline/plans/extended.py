"""More named queries: confirmation, timing, doses with bands, sources and sinks, sweeps.

Registers them beside those of the catalog; QUERIES and ORACLE_SQL here are the whole set.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.functions.stats import draws, stable_seed
from driftline.operators import confirmation as conf
from driftline.operators import discovery, effects, robustness, secondary, sweeps
from driftline.plans import catalog as c
from driftline.plans import scenarios  # noqa: F401  registers its queries
from driftline.plans.catalog import ORACLE_SQL, QUERIES, query
from driftline.sources import adapters as a
from driftline.sources import graphs, npz, tables

SEEDS = list(range(10))


def with_sql(name: str, sql: str) -> None:
    """SQL beside a query that is registered without any."""
    query(name, sql)(QUERIES[name])


def values(rows) -> str:
    return c._values(rows)


def counted(drawn: np.ndarray, items: list) -> list[tuple]:
    """(replicate, item, how often) of each row of drawn places."""
    return [(r, items[i], int(n)) for r, row in enumerate(drawn) for i, n in zip(*np.unique(row, return_counts=True), strict=True)]


# ---- effects with bands ------------------------------------------------------------------------

_FLAG_DRAWS = [
    (d, *row)
    for d in ("N", "R")
    for row in counted(np.random.default_rng(stable_seed(0, "effect", d)).integers(0, len(SEEDS), size=(200, len(SEEDS))), SEEDS)
]
_BOOT = f"""{c.FLAGS}, drawn(direction, rep, seed, k) AS (VALUES {values(_FLAG_DRAWS)}),
 whole AS (SELECT * FROM paired WHERE (direction, node_id, time) IN (SELECT (direction, node_id, time) FROM paired GROUP BY direction, node_id, time HAVING count(*) = {len(SEEDS)})),
 sd AS (SELECT direction, node_id, stddev_samp(base) AS sd FROM whole WHERE time >= 15 GROUP BY 1, 2),
 curve AS (SELECT direction, node_id, time, avg(d) AS raw FROM whole GROUP BY 1, 2, 3),
 boot AS (SELECT w.direction, node_id, time, rep, sum(k * d) / {len(SEEDS)} AS m FROM whole w JOIN drawn USING (direction, seed) GROUP BY 1, 2, 3, 4),
 band AS (SELECT direction, node_id, time, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM boot GROUP BY 1, 2, 3),
 bands AS (SELECT direction, node_id, time, raw, lo, hi, sd, coalesce(sd > 1e-12, false) AND (lo / sd > 0.1 OR hi / sd < -0.1) AS sig FROM curve JOIN band USING (direction, node_id, time) LEFT JOIN sd USING (direction, node_id))"""
with_sql(
    "effect_curves",
    f"""WITH {_BOOT} SELECT direction, node_id, time, round(raw, 6) + 0.0 AS mean_raw, round(lo, 6) + 0.0 AS low_raw, round(hi, 6) + 0.0 AS high_raw,
     round(raw / sd, 6) + 0.0 AS mean, round(lo / sd, 6) + 0.0 AS low, round(hi / sd, 6) + 0.0 AS high, sig AS significant FROM bands""",
)
_AHEAD = "ORDER BY time ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"
with_sql(
    "effect_bands",
    f"""WITH {_BOOT}, late AS (SELECT direction, node_id, seed, avg(d) AS d FROM whole WHERE time >= 15 GROUP BY 1, 2, 3),
     total AS (SELECT direction, node_id, avg(d) AS raw FROM late GROUP BY 1, 2),
     cum AS (SELECT direction, node_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT direction, node_id, rep, avg(m) AS m FROM boot WHERE time >= 15 GROUP BY 1, 2, 3) GROUP BY 1, 2),
     signs AS (SELECT *, CASE WHEN sig THEN sign(raw) ELSE 0 END AS s FROM bands),
     starts AS (SELECT direction, node_id, time, s, min(s) OVER w AS a, max(s) OVER w AS b, count(*) OVER w AS n FROM signs WINDOW w AS (PARTITION BY direction, node_id {_AHEAD}),
     onset AS (SELECT direction, node_id, coalesce(min(time) FILTER (s <> 0 AND a = b AND n = 4 AND time >= 0), -1) AS onset FROM starts GROUP BY 1, 2),
     bsigns AS (SELECT boot.direction, boot.node_id, rep, time, CASE WHEN abs(m / sd) >= 0.1 THEN sign(m) ELSE 0 END AS s FROM boot JOIN sd USING (direction, node_id)),
     bstarts AS (SELECT *, min(s) OVER w AS a, max(s) OVER w AS b, count(*) OVER w AS n FROM bsigns WINDOW w AS (PARTITION BY direction, node_id, rep {_AHEAD}),
     bonset AS (SELECT direction, node_id, rep, min(time) AS t FROM bstarts WHERE s <> 0 AND a = b AND n = 4 GROUP BY 1, 2, 3),
     oci AS (SELECT direction, node_id, quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM bonset GROUP BY 1, 2),
     term AS (SELECT direction, node_id, avg(raw) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY direction, node_id ORDER BY time DESC) AS k FROM curve) WHERE k <= 10 GROUP BY 1, 2),
     peak AS (SELECT direction, node_id, arg_min(time, (-abs(raw), time)) AS t FROM curve WHERE time >= 15 GROUP BY 1, 2),
     agree AS (SELECT l.direction, l.node_id, avg(CASE WHEN sign(l.d) = sign(t.raw) THEN 1.0 ELSE 0.0 END) AS share FROM late l JOIN total t USING (direction, node_id) GROUP BY 1, 2)
     SELECT direction, node_id, round(total.raw / sd, 6) + 0.0 AS cumulative_effect_standardised, round(cum.lo / sd, 6) + 0.0 AS cumulative_ci_low, round(cum.hi / sd, 6) + 0.0 AS cumulative_ci_high,
       round(total.raw, 6) + 0.0 AS cumulative_effect_raw, round(cum.lo, 6) + 0.0 AS cumulative_raw_ci_low, round(cum.hi, 6) + 0.0 AS cumulative_raw_ci_high, round(sd, 6) + 0.0 AS baseline_sd,
       round(term.raw / sd, 6) + 0.0 AS terminal_effect_standardised, CAST(onset AS INTEGER) AS onset_time, round(oci.lo, 6) + 0.0 AS onset_ci_low, round(oci.hi, 6) + 0.0 AS onset_ci_high, CAST(peak.t AS INTEGER) AS peak_time,
       CAST(sign(total.raw) AS INTEGER) AS effect_sign, round(share, 6) + 0.0 AS sign_consistency, onset >= 0 AND (cum.lo / sd > 0.1 OR cum.hi / sd < -0.1) AS significant, sd > 1e-12 AS estimable
     FROM total JOIN cum USING (direction, node_id) JOIN sd USING (direction, node_id) JOIN onset USING (direction, node_id) LEFT JOIN oci USING (direction, node_id) JOIN term USING (direction, node_id)
       JOIN peak USING (direction, node_id) JOIN agree USING (direction, node_id)""",
)
with_sql(
    "bootstrap_means",
    f"""WITH {c.FLAGS}, drawn(rep, seed, k) AS (VALUES {values(counted(draws(0, "mean", 200, len(SEEDS)), SEEDS))}), s AS (SELECT direction, node_id, seed, avg(d) AS d FROM paired GROUP BY 1, 2, 3),
     m AS (SELECT direction, node_id, rep, sum(k * d) / sum(k) AS m FROM s JOIN drawn USING (seed) GROUP BY 1, 2, 3), b AS (SELECT direction, node_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1, 2)
     SELECT direction, node_id, round(avg(d), 6) + 0.0 AS mean, round(max(lo), 6) + 0.0 AS low, round(max(hi), 6) + 0.0 AS high FROM s JOIN b USING (direction, node_id) GROUP BY 1, 2""",
)

_ORDER = np.random.default_rng(stable_seed(0, "unpaired", "flags")).permutation(len(SEEDS))


@query(
    "unpaired_effects",
    f"""WITH {c.FLAGS}, dealt(old, seed) AS (VALUES {values([(SEEDS[j], SEEDS[i]) for i, j in enumerate(_ORDER)])}),
     loose AS (SELECT i.direction, i.seed, i.time, i.node_id, b.value AS base, i.value - b.value AS d FROM runs i JOIN dealt USING (seed) JOIN runs b ON b.seed = old AND b.time = i.time AND b.node_id = i.node_id WHERE i.direction <> 'A' AND b.direction = 'A'),
     late AS (SELECT * FROM loose WHERE time >= 15), s AS (SELECT direction, node_id, seed, avg(d) AS d FROM late GROUP BY 1, 2, 3), r AS (SELECT direction, node_id, avg(d) AS raw FROM s GROUP BY 1, 2),
     sd AS (SELECT direction, node_id, stddev_samp(base) AS sd FROM late GROUP BY 1, 2)
     SELECT direction, node_id, round(raw, 6) + 0.0 AS raw, round(sd, 6) + 0.0 AS baseline_sd, round(raw / sd, 6) + 0.0 AS standardised FROM r JOIN sd USING (direction, node_id)""",
)
def unpaired_effects(spark, sf_dir):
    runs = a.flag_runs(spark, sf_dir)
    loose = effects.unpaired(runs.filter("direction = 'A'"), 0, "flags")
    return effects.mean_effects(effects.pair_runs(loose, runs.filter("direction <> 'A'"), ["direction"]), ["direction", "node_id"], 15)


# ---- routes and evidence -------------------------------------------------------------------------


def _routes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    eff, edges, _, _ = c._decision_inputs(spark, sf_dir)
    scales = spark.createDataFrame(list(c._ROLES.items()), "node_id string, scale string")
    roots = eff.select("parameter").distinct().withColumn("root", F.explode(F.array(F.lit("v0"), F.lit("v1"))))
    return edges, scales, roots, effects.manipulation_routes(edges, scales, roots, None, edges)


_FALLBACK = f"""{c._ATTEMPTS}, loose AS (SELECT DISTINCT source, target, root, parameter FROM (SELECT source, target, source AS root FROM typed WHERE ss = 'micro' AND ts = 'meso'
   UNION ALL SELECT t.source, t.target, e.source FROM typed t JOIN typed e ON e.target = t.source AND e.ss = 'micro' WHERE t.ss = 'meso' AND t.ts = 'macro') CROSS JOIN pars WHERE root IN ('v0', 'v1'))"""


@query("fallback_routes", f"WITH {_FALLBACK} SELECT source, target, root, parameter FROM loose")
def fallback_routes(spark, sf_dir):
    return _routes(spark, sf_dir)[3].select("source", "target", "root", "parameter")


@query("testable_edges", f"WITH {_FALLBACK} SELECT source, target, lag FROM edges WHERE (source, target) IN (SELECT (source, target) FROM loose)")
def testable_edges(spark, sf_dir):
    edges, _, _, routes = _routes(spark, sf_dir)
    return effects.testable_edges(edges, routes).select("source", "target", "lag")


def _paths(spark, sf_dir) -> DataFrame:
    eff, _, paths, _ = c._decision_inputs(spark, sf_dir)
    known = eff.select("parameter", "direction").distinct()
    return known.withColumn("p", F.explode(F.array(*[F.struct(*[F.lit(x).alias(s) for x, s in zip(m, conf.SCALES, strict=True)]) for m in c._MIDS]))).select(
        F.concat_ws(":", "parameter", "direction", "p.micro", "p.meso", "p.macro").alias("path_id"), "parameter", "direction", "p.*",
        F.lit("increase").alias("expected_micro"), F.lit("decrease").alias("expected_meso"), F.lit("increase").alias("expected_macro"),
    )


_PATH_ID = "concat_ws(':', parameter, direction, micro, meso, macro)"
_METHOD = "CASE WHEN root = 'v0' THEN 'full_method' WHEN direction = 'minus' THEN 'frozen_full_method' ELSE 'trajectory_vote' END"


@query(
    "path_edge_evidence",
    f"""WITH {c._CLASSIFIED}, own AS (SELECT *, {_METHOD} AS method FROM att WHERE parameter IS NOT NULL), e AS (SELECT grp, root, source, target, parameter, direction, {c._EVIDENCE} AS cls FROM own WHERE method <> 'trajectory_vote' GROUP BY 1, 2, 3, 4, 5, 6)
     SELECT concat_ws(':', n.parameter, n.direction, micro, meso, macro) AS path_id, coalesce(x.cls, 'inconclusive') AS micro_meso_class, coalesce(y.cls, 'inconclusive') AS meso_macro_class FROM named n
     LEFT JOIN e x ON x.parameter = n.parameter AND x.direction = n.direction AND x.root = micro AND x.source = micro AND x.target = meso AND x.grp = n.grp
     LEFT JOIN e y ON y.parameter = n.parameter AND y.direction = n.direction AND y.root = micro AND y.source = meso AND y.target = macro AND y.grp = n.grp""",
)
def path_edge_evidence(spark, sf_dir):
    tried = c._decision_inputs(spark, sf_dir)[3].filter("parameter IS NOT NULL").withColumn("method", F.expr(_METHOD))
    return conf.path_edge_evidence(_paths(spark, sf_dir), tried).select("path_id", "micro_meso_class", "meso_macro_class")


_LATER = "CASE WHEN root = 'v1' AND direction = 'minus' AND {0} = 'supported' THEN 'manipulation_failure' ELSE {0} END"


@query(
    "mechanism_confirmation",
    f"""WITH {c._ATTEMPTS}, frozen AS (SELECT DISTINCT grp, root, source, target, parameter, direction FROM att WHERE cls = 'supported'),
     later AS (SELECT grp, root, source, target, parameter, direction, {_LATER.format("cls")} AS cls FROM att WHERE right(parameter, 1) <> '1'),
     h AS (SELECT f.*, CASE WHEN count(l.cls) FILTER (l.cls <> 'not_applicable') = 0 THEN 'inconclusive' WHEN bool_or(l.cls = 'directionally_contradicted') THEN 'directionally_contradicted' WHEN bool_or(l.cls = 'supported') THEN 'supported'
       WHEN bool_or(l.cls = 'manipulation_failure') THEN 'manipulation_failure' WHEN bool_or(l.cls = 'no_stable_downstream_effect') THEN 'no_stable_downstream_effect' ELSE 'inconclusive' END AS holdout_class
       FROM frozen f LEFT JOIN later l USING (grp, root, source, target, parameter, direction) GROUP BY ALL)
     SELECT grp AS "group", root, source, target, parameter, direction, holdout_class, CASE holdout_class WHEN 'supported' THEN 'confirmed' WHEN 'manipulation_failure' THEN 'manipulation_failure' WHEN 'inconclusive' THEN 'inconclusive' ELSE 'failed_confirmation' END AS classification,
       true AS retained_baseline, (grp, source, target) IN (SELECT (grp, source, target) FROM edges WHERE lag > 1) AS retained_disabled FROM h""",
)
def mechanism_confirmation(spark, sf_dir):
    _, edges, _, tried = c._decision_inputs(spark, sf_dir)
    later = tried.filter("right(parameter, 1) <> '1'").withColumn("primary_class", F.expr(_LATER.format("primary_class")))
    return conf.confirm_mechanisms(tried, later, edges, edges.filter("lag > 1"))


def _signed(eff: DataFrame) -> DataFrame:
    return eff.withColumn("effect_sign", F.signum("cumulative_effect_standardised").cast("int"))


_THREE = """three AS (SELECT n.*, a.moved AS m1, b.moved AS m2, c.moved AS m3, a.effect AS e1, b.effect AS e2, c.effect AS e3, a.onset AS o1, b.onset AS o2, c.onset AS o3,
   EXISTS (SELECT 1 FROM edges e WHERE e.source = micro AND e.target = meso AND e.grp = n.grp) AND EXISTS (SELECT 1 FROM edges e WHERE e.source = meso AND e.target = macro AND e.grp = n.grp) AS kept FROM named n
   LEFT JOIN eff a ON a.parameter = n.parameter AND a.direction = n.direction AND a.node_id = micro LEFT JOIN eff b ON b.parameter = n.parameter AND b.direction = n.direction AND b.node_id = meso
   LEFT JOIN eff c ON c.parameter = n.parameter AND c.direction = n.direction AND c.node_id = macro)"""
_AGREES = "coalesce(m1 AND m2 AND m3 AND e1 > 0 AND e2 < 0 AND e3 > 0, false)"
_ORDERED = "coalesce(o1 >= 0 AND o2 >= o1 AND o3 >= o2, false)"


@query(
    "prospective_confirmation",
    f"""WITH {c._CLASSIFIED}, {_THREE} SELECT concat('pred:', {_PATH_ID}) AS prediction_id, {_PATH_ID} AS path_id, parameter, direction, micro, meso, macro,
     CASE WHEN NOT coalesce(m1, false) THEN 'manipulation_failure' WHEN NOT coalesce(m2 AND m3, false) THEN 'inconclusive' WHEN NOT ({_AGREES} AND {_ORDERED} AND kept) THEN 'failed_confirmation' ELSE 'confirmed' END AS classification,
     kept AS retained, {_AGREES} AS direction_supported, {_ORDERED} AS onset_order_supported, coalesce(m2 AND m3, false) AS downstream_supported FROM three""",
)
def prospective_confirmation(spark, sf_dir):
    eff, edges, _, _ = c._decision_inputs(spark, sf_dir)
    paths = _paths(spark, sf_dir)
    predictions = paths.select(F.concat(F.lit("pred:"), "path_id").alias("prediction_id"), "path_id")
    return conf.confirm_predictions(predictions, paths, edges, _signed(eff))


@query(
    "prediction_requirements",
    f"""WITH {c._CLASSIFIED}, {_THREE}, t AS (SELECT *, CASE WHEN m1 THEN coalesce(e1 > 0, false) END AS a1, CASE WHEN m2 THEN coalesce(e2 < 0, false) END AS a2, CASE WHEN m3 THEN coalesce(e3 > 0, false) END AS a3 FROM three)
     SELECT {_PATH_ID} AS path_id, CASE WHEN NOT coalesce(m1, false) THEN 'manipulation_failure' WHEN NOT coalesce(m2, false) OR a1 = false OR a2 = false OR a3 = false OR NOT kept THEN 'contradicted'
       WHEN a1 AND a2 THEN 'supported' WHEN a1 OR a2 OR a3 THEN 'partially_supported' ELSE 'inconclusive' END AS verdict FROM t""",
)
def prediction_requirements(spark, sf_dir):
    eff, edges, _, _ = c._decision_inputs(spark, sf_dir)
    rows = conf._three(conf._with_retained(_paths(spark, sf_dir), edges), _signed(eff), ("significant", "effect_sign", "onset_time"))
    for s, sign in zip(conf.SCALES, (1, -1, 1), strict=True):
        r = F.col(f"_{s}")
        rows = rows.withColumn(s, F.when(r.isNotNull(), F.struct(r["significant"].alias("significant"), (r["effect_sign"] == sign).alias("agrees"), r["onset_time"].alias("onset_time"))))
    return conf.requirements(rows, (True, False), order_required=False).select("path_id", "verdict")


_QUALIFIED = f"""{c._CLASSIFIED}, lagged AS (SELECT q.*, x.lag AS l1, x.beta AS b1, y.lag AS l2, y.beta AS b2 FROM q JOIN edges x ON x.source = micro AND x.target = meso AND x.grp = q.grp JOIN edges y ON y.source = meso AND y.target = macro AND y.grp = q.grp),
 times AS (SELECT l.*, a.effect AS e1, b.effect AS e2, c.effect AS e3, coalesce(a.onset, -1) AS o1, coalesce(b.onset, -1) AS o2, coalesce(c.onset, -1) AS o3, coalesce(a.moved, false) AS m1 FROM lagged l
   LEFT JOIN eff a ON a.parameter = l.parameter AND a.direction = l.direction AND a.node_id = micro LEFT JOIN eff b ON b.parameter = l.parameter AND b.direction = l.direction AND b.node_id = meso
   LEFT JOIN eff c ON c.parameter = l.parameter AND c.direction = l.direction AND c.node_id = macro),
 d AS (SELECT *, CASE WHEN o1 >= 0 AND o2 >= 0 THEN o2 - o1 END AS d1, CASE WHEN o2 >= 0 AND o3 >= 0 THEN o3 - o2 END AS d2, CASE WHEN o1 >= 0 AND o3 >= 0 THEN o3 - o1 END AS dt FROM times)"""


@query(
    "path_concordance",
    f"""WITH {_QUALIFIED} SELECT {_PATH_ID} AS path_id, parameter, direction, micro, meso, macro, o1 AS micro_onset, o2 AS meso_onset, o3 AS macro_onset,
     d1 AS micro_meso_delay, d1 - l1 AS micro_meso_lag_difference, coalesce(abs(d1 - l1) <= 2, false) AS micro_meso_lag_concordant, CASE WHEN e1 * e2 IS NOT NULL THEN sign(e1 * e2) <> 0 AND sign(e1 * e2) = sign(b1) END AS micro_meso_sign_concordant,
     d2 AS meso_macro_delay, d2 - l2 AS meso_macro_lag_difference, coalesce(abs(d2 - l2) <= 2, false) AS meso_macro_lag_concordant, CASE WHEN e2 * e3 IS NOT NULL THEN sign(e2 * e3) <> 0 AND sign(e2 * e3) = sign(b2) END AS meso_macro_sign_concordant,
     l1 + l2 AS total_lag, dt AS total_latency, dt - l1 - l2 AS total_lag_difference, coalesce(abs(dt - l1 - l2) <= 2, false) AS total_lag_concordant, m1 AND e1 IS NOT NULL AS manipulation_success FROM d""",
)
def path_concordance(spark, sf_dir):
    eff, edges, _, _ = c._decision_inputs(spark, sf_dir)
    return conf.path_concordance(effects.qualified_paths(_paths(spark, sf_dir), edges), eff, 2)


with_sql(
    "propagating_paths",
    f"""WITH {_QUALIFIED}, ev AS (SELECT parameter, direction, root, source, target, {c._EVIDENCE} AS cls FROM att WHERE root IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
     SELECT {_PATH_ID} AS path_id FROM d JOIN eff b ON b.parameter = d.parameter AND b.direction = d.direction AND b.node_id = meso JOIN eff x ON x.parameter = d.parameter AND x.direction = d.direction AND x.node_id = macro
     WHERE m1 AND b.moved AND x.moved AND o1 >= 0 AND o2 >= o1 AND o3 >= o2
       AND EXISTS (SELECT 1 FROM ev WHERE ev.parameter = d.parameter AND ev.direction = d.direction AND root = micro AND source = micro AND target = meso AND cls = 'supported')
       AND EXISTS (SELECT 1 FROM ev WHERE ev.parameter = d.parameter AND ev.direction = d.direction AND root = micro AND source = meso AND target = macro AND cls = 'supported')""".replace("concat_ws(':', parameter, direction,", "concat_ws(':', d.parameter, d.direction,"),
)

_MEASURES = {"effect": "effect", "ci_low": "effect - 1", "ci_high": "effect + 1", "onset": "onset", "significant": "moved", "effect_sign": "CAST(sign(effect) AS INTEGER)"}
_REST = {"onset": "-1", "significant": "false", "effect_sign": "0"}


def _wide(d: str, m: str) -> str:
    return f"max({_MEASURES[m]}) FILTER (direction = '{d}') AS {d}_{m}".replace("max(moved)", "bool_or(moved)")


def _shown(d: str, s: str, m: str) -> str:
    x = f"{s}_.{d}_{m}"
    x = f"coalesce({x}, {_REST[m]})" if m in _REST else f"round({x}, 6) + 0.0"
    return f"{x} AS {d}_{s}_{m}"


@query(
    "path_responses",
    f"""WITH {c._ATTEMPTS}, wide AS (SELECT parameter, node_id, {", ".join(_wide(d, m) for d in ("minus", "plus") for m in _MEASURES)} FROM eff GROUP BY 1, 2)
     SELECT p.parameter, micro, meso, macro, {", ".join(_shown(d, s, m) for d in ("minus", "plus") for s in conf.SCALES for m in _MEASURES)} FROM pars p CROSS JOIN mids
     {" ".join(f"LEFT JOIN wide {s}_ ON {s}_.parameter = p.parameter AND {s}_.node_id = {s}" for s in conf.SCALES)}""",
)
def path_responses(spark, sf_dir):
    eff = _signed(c._decision_inputs(spark, sf_dir)[0]).withColumnsRenamed({"cumulative_effect_standardised": "effect", "onset_time": "onset"})
    eff = eff.withColumns({"ci_low": F.col("effect") - 1, "ci_high": F.col("effect") + 1})
    return conf.path_responses(_paths(spark, sf_dir).select("parameter", *conf.SCALES).distinct(), eff)


@query(
    "path_attenuation",
    f"""WITH edges(source, target, grp, lag, beta) AS (VALUES {values(c._EDGES)}), mids(micro, meso, macro) AS (VALUES {values(c._MIDS)}),
     m AS (SELECT concat('v', p_partkey % 6) AS node_id, avg(p_size) - 25 AS b, avg(p_size) FILTER (p_partkey % 2 = 0 OR p_partkey % 3 = 1) - 25 AS d FROM part GROUP BY 1),
     n AS (SELECT concat_ws(':', micro, meso, macro) AS path_id, concat('macro_outcome_', macro) AS grp, unnest([struct_pack(scale := 'micro', node := micro, parent := NULL), struct_pack(scale := 'meso', node := meso, parent := micro), struct_pack(scale := 'macro', node := macro, parent := meso)]) AS x FROM mids)
     SELECT path_id, x.scale AS scale, x.node AS node_id, round(b, 6) + 0.0 AS baseline, round(d, 6) + 0.0 AS disabled, round(CASE WHEN abs(b) > 1e-12 THEN abs(d) / abs(b) END, 6) + 0.0 AS retained, round(CASE WHEN abs(b) > 1e-12 THEN 1 - abs(d) / abs(b) END, 6) + 0.0 AS attenuation,
       CASE WHEN x.parent IS NOT NULL THEN EXISTS (SELECT 1 FROM edges e WHERE e.source = x.parent AND e.target = x.node AND e.grp = n.grp) END AS edge_baseline,
       CASE WHEN x.parent IS NOT NULL THEN EXISTS (SELECT 1 FROM edges e WHERE e.source = x.parent AND e.target = x.node AND e.grp = n.grp AND lag > 1) END AS edge_disabled FROM n LEFT JOIN m ON m.node_id = x.node""",
)
def path_attenuation(spark, sf_dir):
    p = a.read(spark, sf_dir, "part")
    off = F.avg(F.when((F.col("p_partkey") % 2 == 0) | (F.col("p_partkey") % 3 == 1), F.col("p_size"))) - 25
    metrics = p.groupBy(F.concat(F.lit("v"), F.col("p_partkey") % 6).alias("node_id")).agg((F.avg("p_size") - 25).alias("baseline"), off.alias("disabled"))
    edges = spark.createDataFrame(c._EDGES, "source string, target string, group string, lag int, beta double")
    paths = spark.createDataFrame([(":".join(m), *m) for m in c._MIDS], "path_id string, micro string, meso string, macro string")
    return conf.path_attenuation(paths, metrics, edges, edges.filter("lag > 1"))


@query(
    "dose_nodes",
    f"""WITH {c._ATTEMPTS}, one AS (SELECT parameter, node_id FROM pars CROSS JOIN roles WHERE node_id IN ('v0', 'v1') AND scale = 'micro'),
     two AS (SELECT DISTINCT parameter, target AS node_id FROM one JOIN typed ON source = node_id WHERE ts = 'meso'), three AS (SELECT DISTINCT parameter, target AS node_id FROM two JOIN typed ON source = node_id WHERE ts = 'macro')
     SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three""",
)
def dose_nodes(spark, sf_dir):
    edges, scales, roots, _ = _routes(spark, sf_dir)
    return conf.dose_nodes(scales, roots, edges)


@query(
    "path_doses",
    f"""WITH {c._CLASSIFIED}, trend AS (SELECT parameter, node_id, sum(CASE direction WHEN 'plus' THEN effect ELSE -effect END) / 2 AS slope FROM eff GROUP BY 1, 2)
     SELECT concat_ws(':', v.parameter, direction, micro, meso, macro) AS path_id, v.parameter, qualified, cls2 = 'supported' AS supported, round(a.slope, 6) + 0.0 AS micro_trend, round(b.slope, 6) + 0.0 AS meso_trend, round(c.slope, 6) + 0.0 AS macro_trend FROM verdict v
     LEFT JOIN trend a ON a.parameter = v.parameter AND a.node_id = micro LEFT JOIN trend b ON b.parameter = v.parameter AND b.node_id = meso LEFT JOIN trend c ON c.parameter = v.parameter AND c.node_id = macro WHERE qualified OR cls2 = 'supported'""",
)
def path_doses(spark, sf_dir):
    eff = c._decision_inputs(spark, sf_dir)[0]
    e = F.col("cumulative_effect_standardised")
    trends = eff.groupBy("parameter", "node_id").agg((F.sum(F.when(F.col("direction") == "plus", e).otherwise(-e)) / 2).alias("slope"))
    return conf.path_doses(c._classified(spark, sf_dir)[1], trends)


@query(
    "relations",
    f"""WITH {c._ATTEMPTS} SELECT source, target, CASE WHEN max(e.beta) > 0 THEN 'increase' ELSE 'decrease' END AS direction,
     (SELECT string_agg(concat_ws(':', x.grp, x.lag), ';' ORDER BY x.grp, x.lag) FROM edges x WHERE x.source = e.source AND x.target = e.target) AS temporal,
     coalesce((SELECT string_agg(concat_ws(':', x.parameter, x.direction, x.root, x.cls), ';' ORDER BY x.parameter, x.direction, x.root, x.cls) FROM att x WHERE x.source = e.source AND x.target = e.target AND x.parameter IS NOT NULL), '') AS interventions
     FROM edges e GROUP BY source, target""",
)
def relations(spark, sf_dir):
    _, edges, _, tried = c._decision_inputs(spark, sf_dir)
    candidates = edges.select("source", "target", F.when(F.col("beta") > 0, "increase").otherwise("decrease").alias("direction"))
    found = conf.relations(candidates, edges, tried)
    line = lambda col, f: F.array_join(F.transform(col, f), ";").alias(col)
    return found.select(
        "source", "target", "direction", line("temporal", lambda x: F.concat_ws(":", x["group"], x["lag"])),
        line("interventions", lambda x: F.concat_ws(":", x["parameter"], x["direction"], x["root"], x["primary_class"])),
    )


# ---- doses with bands ----------------------------------------------------------------------------

_DOSES, _SEVEN, _REPS = [-1.0, -0.5, 0.0, 0.5, 1.0], list(range(7)), 60
_DOSE_DRAWS = [
    (dose, kind, *row)
    for dose in _DOSES
    for kind in ("raw", "std")
    for row in counted(np.random.default_rng(stable_seed(0, "dose", "price", dose, kind)).integers(0, 7, size=(_REPS, 7)), _SEVEN)
]
_SLOPE_DRAWS = counted(np.random.default_rng(stable_seed(0, "dose_slope", "price")).integers(0, 7, size=(_REPS, 7)), _SEVEN)
_PER_SEED = f"""r AS (SELECT c_nationkey % 7 AS seed, year(o_orderdate) - 1995 AS time, CAST({c._DOSE} AS DOUBLE) AS dose, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
 b AS (SELECT seed, time, value FROM r WHERE dose = 0 AND time >= 1), sd AS (SELECT stddev_samp(value) AS sd FROM b),
 per AS (SELECT dose, r.seed, avg(r.value - b.value) AS raw, avg(r.value - b.value) / max(sd) AS std FROM r JOIN b USING (seed, time), sd GROUP BY dose, r.seed)"""


def _per_seed(spark, sf_dir) -> DataFrame:
    o, cu = a.read(spark, sf_dir, "orders"), a.read(spark, sf_dir, "customer")
    r = o.join(cu, o["o_custkey"] == cu["c_custkey"]).groupBy(
        F.lit("price").alias("node_id"), (F.col("c_nationkey") % 7).alias("seed"), (F.year("o_orderdate") - 1995).alias("time"), F.expr(f"CAST({c._DOSE} AS DOUBLE)").alias("dose")
    )
    return secondary.dose_effects(r.agg(F.avg("o_totalprice").alias("value")), ["node_id"], 0.0, 1)


@query(
    "dose_intervals",
    f"""WITH {_PER_SEED}, drawn(dose, kind, rep, seed, k) AS (VALUES {values(_DOSE_DRAWS)}), m AS (SELECT dose, kind, rep, sum(k * CASE kind WHEN 'raw' THEN raw ELSE std END) / 7 AS m FROM per JOIN drawn USING (dose, seed) GROUP BY 1, 2, 3),
     q AS (SELECT dose, kind, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1, 2), t AS (SELECT dose, avg(raw) AS raw, avg(std) AS std, count(*) AS n FROM per GROUP BY 1),
     s AS (SELECT p.dose, avg(CASE WHEN sign(p.std) = sign(t.std) THEN 1.0 ELSE 0.0 END) AS share FROM per p JOIN t USING (dose) GROUP BY 1)
     SELECT 'price' AS node_id, dose, round(t.raw, 6) + 0.0 AS mean_raw, round(x.lo, 6) + 0.0 AS raw_low, round(x.hi, 6) + 0.0 AS raw_high, round(t.std, 6) + 0.0 AS mean, round(y.lo, 6) + 0.0 AS low, round(y.hi, 6) + 0.0 AS high, round(share, 6) + 0.0 AS consistency, n AS seeds
     FROM t JOIN q x USING (dose) JOIN q y USING (dose) JOIN s USING (dose) WHERE x.kind = 'raw' AND y.kind = 'std'""",
)
def dose_intervals(spark, sf_dir):
    return conf.dose_intervals(_per_seed(spark, sf_dir), ["node_id"], _REPS, 0.95, 0)


@query(
    "dose_slopes",
    f"""WITH {_PER_SEED}, drawn(rep, seed, k) AS (VALUES {values(_SLOPE_DRAWS)}), m AS (SELECT rep, sum(k * dose * std) / 7 / 2.5 AS slope FROM per JOIN drawn USING (seed) GROUP BY 1)
     SELECT 'price' AS node_id, round((SELECT sum(dose * std) / 7 / 2.5 FROM per), 6) + 0.0 AS slope, round(quantile_cont(slope, 0.025), 6) + 0.0 AS slope_low, round(quantile_cont(slope, 0.975), 6) + 0.0 AS slope_high, 'paired_seeds' AS unit FROM m""",
)
def dose_slopes(spark, sf_dir):
    return conf.dose_slopes(_per_seed(spark, sf_dir), ["node_id"], _REPS, 0.95, 0)


# ---- tables of measures, sets and orders -------------------------------------------------------------

_TABLE = f"""{c.TRADE}, g AS (SELECT CASE time WHEN 0 THEN 'full_method' ELSE 'trajectory_vote' END AS method, (u + v) % 5 / 4.0 AS support, u % 3 / 2.0 AS lag_support, v % 3 + 0.0 AS lag_std FROM edges WHERE time < 2),
 cells(method, candidates) AS (VALUES ('full_method', 300), ('trajectory_vote', 310), ('single_trajectory', 0))"""


@query(
    "discovery_table",
    f"""WITH {_TABLE} SELECT c.method, CAST(max(candidates) AS BIGINT) AS candidates, count(support) AS retained, round(count(support) / greatest(max(candidates), 1), 6) + 0.0 AS qualification_rate, round(avg(support), 6) + 0.0 AS stability,
     round(avg(lag_support), 6) + 0.0 AS lag_support, round(avg(lag_std), 6) + 0.0 AS lag_std FROM cells c LEFT JOIN g USING (method) GROUP BY c.method""",
)
def discovery_table(spark, sf_dir):
    links = a.trade(spark, sf_dir).tables[("time", "edge")].filter("time < 2")
    u, v = F.col("link_0"), F.col("link_1")
    edges = links.select(F.when(F.col("time") == 0, "full_method").otherwise("trajectory_vote").alias("method"), ((u + v) % 5 / 4.0).alias("support"), (u % 3 / 2.0).alias("lag_support"), (v % 3 + 0.0).cast("double").alias("lag_std"))
    cells = spark.createDataFrame([("full_method", 300), ("trajectory_vote", 310), ("single_trajectory", 0)], "method string, candidates long")
    return conf.graph_table(edges, cells, ["method"])


@query(
    "support_rates",
    f"""WITH {c._ATTEMPTS}, e AS (SELECT grp, source, target, parameter, {c._EVIDENCE} AS cls FROM att WHERE parameter IS NOT NULL GROUP BY 1, 2, 3, 4)
     SELECT parameter, count(*) FILTER (cls <> 'not_applicable') AS applicable, round(count(*) FILTER (cls = 'supported') / count(*) FILTER (cls <> 'not_applicable'), 6) + 0.0 AS support_rate,
     round(count(*) FILTER (cls = 'directionally_contradicted') / count(*) FILTER (cls <> 'not_applicable'), 6) + 0.0 AS contradiction_rate FROM e GROUP BY parameter""",
)
def support_rates(spark, sf_dir):
    tried = c._decision_inputs(spark, sf_dir)[3].filter("parameter IS NOT NULL")
    return secondary.verdict_rates(effects.edge_evidence(tried, ["group", "source", "target", "parameter"]), by=["parameter"])


_NODE = "concat('p', p_partkey % 60)"


@query(
    "scale_pairs",
    f"""WITH n AS (SELECT DISTINCT {_NODE} AS node_id, p_partkey % 3 AS s FROM part), old AS (SELECT DISTINCT {_NODE} AS source, concat('p', (p_partkey * 7 + 1) % 60) AS target FROM part)
     SELECT a.node_id AS source, b.node_id AS target FROM n a JOIN n b ON b.s = a.s + 1 WHERE (a.node_id, b.node_id) NOT IN (SELECT (source, target) FROM old)""",
)
def scale_pairs(spark, sf_dir):
    p = a.read(spark, sf_dir, "part")
    name = F.concat(F.lit("p"), F.col("p_partkey") % 60)
    nodes = p.select(name.alias("node_id"), F.element_at(F.array(*map(F.lit, conf.SCALES)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("scale")).distinct()
    old = p.select(name.alias("source"), F.concat(F.lit("p"), (F.col("p_partkey") * 7 + 1) % 60).alias("target"))
    return conf.scale_pairs(nodes, old)


_GENERATIONS = """SELECT s_nationkey AS scenario, s_suppkey AS generation, s_suppkey % 3 AS source_diversity, s_suppkey % 2 AS direct_parameters, s_suppkey * 7 % 4 AS meso_diversity, s_suppkey % 5 AS macro_diversity, s_suppkey % 4 AS repair_rounds, {hash} AS hash FROM {table}"""


@query(
    "best_generations",
    f"""WITH g AS ({_GENERATIONS.format(hash="sha256(s_name)", table="supplier")}) SELECT scenario, generation, hash FROM
     (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY source_diversity DESC, direct_parameters DESC, meso_diversity DESC, macro_diversity DESC, repair_rounds, hash) AS k FROM g) WHERE k = 1""",
)
def best_generations(spark, sf_dir):
    a.read(spark, sf_dir, "supplier").createOrReplaceTempView("driftline_supplier")
    g = spark.sql(_GENERATIONS.format(hash="sha2(s_name, 256)", table="driftline_supplier"))
    return conf.best_generation(g, ["scenario"]).select("scenario", "generation", "hash")


@query(
    "effects_in_order",
    f"""WITH {c._ATTEMPTS} SELECT parameter, direction, node_id, scale FROM eff JOIN roles USING (node_id) ORDER BY parameter, direction, CASE scale WHEN 'micro' THEN 0 WHEN 'meso' THEN 1 ELSE 2 END, node_id LIMIT 25""",
)
def effects_in_order(spark, sf_dir):
    eff = c._decision_inputs(spark, sf_dir)[0]
    scales = spark.createDataFrame(list(c._ROLES.items()), "node_id string, scale string")
    rows = eff.join(scales, "node_id").select("parameter", "direction", "node_id", "scale")
    place = F.array_position(F.array(*map(F.lit, conf.SCALES)), F.col("scale"))
    return conf.in_order(rows.withColumn("_p", place), "parameter", "direction", "_p", "node_id").drop("_p").limit(25)


@query("one_table", f"""WITH {c.TRADE} SELECT u AS source, v AS target, u % 3 AS lag, NULL AS beta FROM edges WHERE time = 0 UNION ALL SELECT u, v, NULL, v % 3 - 1.0 FROM edges WHERE time = 1""".replace("v % 3 - 1.0", "CAST(v % 3 - 1 AS DOUBLE)"))
def one_table(spark, sf_dir):
    x, y = c._graphs(spark, sf_dir)
    return conf.one_table(x.select("source", "target", "lag"), y.select("source", "target", ((F.col("target") % 3) - 1).cast("double").alias("beta")))


@query("group_medians", f"WITH {c.FLAGS} SELECT node_id, time, round(median(value), 6) + 0.0 AS median, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM runs GROUP BY node_id, time")
def group_medians(spark, sf_dir):
    rows = a.flag_runs(spark, sf_dir)
    return rows.groupBy("node_id", F.col("time").cast("long").alias("time")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"), F.count("*").alias("n"))


_SAMPLED = {
    "without": np.random.default_rng(stable_seed(0, "without")).choice(10, 4, replace=False),
    "with": np.random.default_rng(stable_seed(0, "with")).integers(0, 10, 10),
    "permutation": np.random.default_rng(stable_seed(0, "permutation")).permutation(10),
}


@query(
    "seed_samples",
    f"""WITH {c.FLAGS}, s(kind, place, drawn) AS (VALUES {values([(k, i, int(x)) for k, v in _SAMPLED.items() for i, x in enumerate(v)])}), m AS (SELECT seed, avg(value) AS value FROM runs WHERE node_id = 'quantity' GROUP BY seed)
     SELECT kind, place, m.seed, round(value, 6) + 0.0 AS value FROM s JOIN m ON m.seed = drawn""",
)
def seed_samples(spark, sf_dir):
    means = a.flag_runs(spark, sf_dir).filter("node_id = 'quantity'").groupBy("seed").agg(F.avg("value").alias("value"))
    parts = [robustness.sample(means, "seed", kind, n, 0) for kind, n in (("without", 4), ("with", 10), ("permutation", 10))]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "semantic_graph",
    f"""WITH p AS {c._PATHS}, e AS (SELECT path_id, macro, micro AS source, meso AS target, d1 AS d FROM p UNION ALL SELECT path_id, macro, meso, macro, d2 FROM p),
     k AS (SELECT source, target, CASE WHEN min(d) = max(d) THEN min(d) ELSE 'mixed' END AS direction, list(DISTINCT concat('macro_outcome_', macro)) AS gs FROM e GROUP BY 1, 2)
     SELECT source, target, unnest(gs) AS "group", 0 AS lag, CASE direction WHEN 'increase' THEN 1.0::DOUBLE WHEN 'decrease' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS beta, direction FROM k""",
)
def semantic_graph(spark, sf_dir):
    a.read(spark, sf_dir, "customer").createOrReplaceTempView("driftline_customer")
    paths = spark.sql(c._PATHS.strip("()").replace("FROM customer", "FROM driftline_customer")).withColumnsRenamed({"d1": "micro_meso_direction", "d2": "meso_macro_direction"})
    edges = secondary.edges_of_paths(paths)
    return discovery.prior_graph(edges.select("source", "target", F.explode("groups").alias("group"), F.col("direction").alias("expected_direction")))


def _kinds_sql() -> str:
    parts = []
    for kind in ("delete_candidate_relation", "irrelevant_indicator", "redundant_semantic_indicator"):
        chosen = [int(i) for i in np.random.default_rng(stable_seed(0, kind, 0.2)).choice(20, 4, replace=False)]
        if kind == "delete_candidate_relation":
            parts.append(f"SELECT '{kind}' AS kind, source, target FROM p WHERE i NOT IN ({', '.join(map(str, chosen))})")
        else:
            parts.append(f"SELECT '{kind}' AS kind, source, target FROM p UNION ALL SELECT '{kind}', concat('{kind}_', k), target FROM p JOIN (VALUES {values(list(enumerate(chosen)))}) x(k, j) ON i = j")
    return " UNION ALL ".join(parts)


@query(
    "corrupted_sets",
    f"""WITH t AS (SELECT DISTINCT event_type AS e FROM events), p AS (SELECT x.e AS source, y.e AS target, row_number() OVER (ORDER BY x.e, y.e) - 1 AS i FROM t x JOIN t y ON x.e <> y.e) {_kinds_sql()}""",
)
def corrupted_sets(spark, sf_dir):
    pairs = c._series(spark, sf_dir)[1]
    rows = []
    for kind in ("delete_candidate_relation", "irrelevant_indicator", "redundant_semantic_indicator"):
        rows += [(kind, s, t) for s, t, _ in robustness.corrupt(pairs, kind, 0.2, 0)[0]]
    return spark.createDataFrame(rows, "kind string, source string, target string")


_TABLE = """n AS (SELECT DISTINCT c_nationkey AS k FROM customer), nodes AS (SELECT concat('n', k) AS node_id, CASE k % 3 WHEN 0 THEN 'micro' WHEN 1 THEN 'meso' ELSE 'macro' END AS scale FROM n),
 cand AS (SELECT DISTINCT concat('n', c_nationkey) AS source, concat('n', c_custkey % 25) AS target, concat('g', c_custkey % 4) AS grp FROM customer WHERE c_nationkey <> c_custkey % 25 AND c_custkey % 7 < 3)"""


def _lowest(kind: str, rows: str, columns: str) -> str:
    order = f"md5(concat_ws(':', '0:{kind}', {columns})), {columns}"
    return f"(SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM {rows} QUALIFY i < (SELECT greatest(1, round_even(0.1 * count(*), 0)) FROM cand))"


_CORRUPTED = {
    "delete_candidate_relation": "SELECT source, target, grp, CAST(NULL AS VARCHAR) AS copied FROM cand ANTI JOIN {low} x USING (source, target, grp)",
    "wrong_hypothesis_group_assignment": "SELECT source, target, grp, NULL FROM cand ANTI JOIN {low} x USING (source, target, grp) UNION SELECT source, target, concat('misassigned_', i % 4), NULL FROM {low}",
    "cross_hypothesis_group_relation": "SELECT source, target, grp, NULL FROM cand UNION ALL SELECT source, target, 'corrupt_macro_outcome_group', NULL FROM {new}",
    "irrelevant_indicator": "SELECT source, target, grp, NULL FROM cand UNION ALL SELECT concat('corrupt_irrelevant_indicator_', lpad(CAST(i AS VARCHAR), 3, '0')), target, grp, NULL FROM {low}",
    "redundant_semantic_indicator": "SELECT source, target, grp, NULL FROM cand UNION ALL SELECT concat('corrupt_redundant_semantic_indicator_', lpad(CAST(i AS VARCHAR), 3, '0')), target, grp, source FROM {low}",
}
_STEPS = "(SELECT a.node_id AS source, b.node_id AS target FROM nodes a JOIN nodes b ON (a.scale = 'micro' AND b.scale = 'meso') OR (a.scale = 'meso' AND b.scale = 'macro') WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.source = a.node_id AND cand.target = b.node_id))"


@query(
    "corrupted_tables",
    f"WITH {_TABLE} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, source, target, grp AS \"group\", copied FROM ({sql.format(low=_lowest(k, 'cand', 'source, target, grp'), new=_lowest(k, _STEPS, 'source, target'))}) AS t(source, target, grp, copied)"
        for k, sql in _CORRUPTED.items()
    ),
)
def corrupted_tables(spark, sf_dir):
    a.read(spark, sf_dir, "customer").createOrReplaceTempView("driftline_customer")
    of = lambda name: spark.sql(f"WITH {_TABLE.replace('FROM customer', 'FROM driftline_customer')} SELECT * FROM {name}")
    rows = None
    for kind in robustness.KINDS:
        found, added = robustness.corrupt_table(of("cand").withColumnRenamed("grp", "group"), of("nodes"), kind, 0.1)
        added = added.select(F.col("node_id").alias("source"), F.col("source").alias("copied"))
        own = found.join(added, "source", "left").select(F.lit(kind).alias("kind"), "source", "target", "group", "copied")
        rows = own if rows is None else rows.union(own)
    return rows


# ---- scalars, sources and sinks ------------------------------------------------------------------------

_FENCED = "concat('```json\n{{\"name\": \"', p_name, '\", \"size\": ', p_size, '}}\n```')".replace("{{", "{").replace("}}", "}")


@query(
    "identifiers",
    f"""WITH n AS (SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN '7 ' ELSE '--' END, p_name, ' (', p_brand, ')') AS name, {_FENCED} AS fenced FROM part), b AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS bare FROM n)
     SELECT p_partkey, left(CASE WHEN regexp_matches(bare, '^[a-z]') THEN bare ELSE concat('item_', bare) END, 64) AS slug, regexp_matches(p_name_, '^[a-z][a-z0-9_]*$') AS plain, CAST(json_extract(regexp_extract(fenced, '(?s)(\\{{.*\\}})', 1), '$.size') AS INTEGER) AS size
     FROM b JOIN (SELECT p_partkey AS k, p_name AS p_name_ FROM part) ON k = p_partkey""",
)
def identifiers(spark, sf_dir):
    p = a.read(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "7 ").otherwise("--"), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    fenced = F.concat(F.lit('```json\n{"name": "'), "p_name", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}\n```"))
    return p.select("p_partkey", text.slug(name).alias("slug"), text.is_identifier(F.col("p_name")).alias("plain"), F.get_json_object(text.json_object(fenced), "$.size").cast("int").alias("size"))


@query("csv_round_trip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf_dir):
    path = tables.scratch(spark, "csv")
    tables.write_csv(a.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return tables.read_csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("graph_lines", f"WITH {c.TRADE} SELECT CASE time WHEN 0 THEN 'full_method' ELSE 'trajectory_vote' END AS method, CAST(u AS VARCHAR) AS source, CAST(v AS VARCHAR) AS target, CAST(u % 3 AS INTEGER) AS lag FROM edges WHERE time < 2")
def graph_lines(spark, sf_dir):
    links = a.trade(spark, sf_dir).tables[("time", "edge")].filter("time < 2")
    none = {n: F.lit(None).cast(t) for n, t in (x.split() for x in graphs.EDGE.split(", "))}
    none |= {"source": F.col("link_0").cast("string"), "target": F.col("link_1").cast("string"), "lag": (F.col("link_0") % 3).cast("int")}
    rows = links.select(F.lit("trade").alias("scenario"), F.when(F.col("time") == 0, "full_method").otherwise("trajectory_vote").alias("method"), *[v.alias(k) for k, v in none.items()])
    path = tables.scratch(spark, "graphs")
    graphs.write_graphs(rows, path)
    return graphs.read_graphs(spark, path).select("method", "source", "target", "lag")


@query(
    "phase_scan",
    f"""WITH {c.FLAGS} SELECT direction AS condition, seed, time, node_id, round(value, 6) + 0.0 AS value FROM runs WHERE direction <> 'A' AND seed < 6""",
)
def phase_scan(spark, sf_dir):
    runs = a.flag_runs(spark, sf_dir).withColumnRenamed("direction", "condition").withColumn("condition", F.when(F.col("condition") == "A", "baseline").otherwise(F.col("condition")))
    manifest = runs.select("condition", "seed").distinct().withColumn("partition", F.when(F.col("seed") < 6, "primary").otherwise("holdout"))
    return tables.scan_phase(runs, manifest, "intervention", "primary").select("condition", "seed", F.col("time").cast("long").alias("time"), "node_id", "value")


@query("trajectory_split", f"WITH {c.FLAGS} SELECT seed, time, node_id, round(value, 6) + 0.0 AS value, row_number() OVER (PARTITION BY seed, node_id ORDER BY time) AS step FROM runs WHERE direction = 'R'")
def trajectory_split(spark, sf_dir):
    return tables.split(a.flag_runs(spark, sf_dir).withColumnRenamed("direction", "condition"), "R").select("seed", F.col("time").cast("long").alias("time"), "node_id", "value", F.col("step").cast("long").alias("step"))


@query("written_once", "SELECT CAST(count(*) AS BIGINT) AS row_count, 3 AS columns, true AS refused FROM supplier")
def written_once(spark, sf_dir):
    path, df = tables.scratch(spark, "once"), a.read(spark, sf_dir, "supplier")
    told = graphs.write_once(df, path, ["s_suppkey", "s_name", "s_nationkey"])
    try:
        graphs.write_once(df, path)
        refused = False
    except Exception:  # noqa: BLE001  Spark's own error of an existing path
        refused = True
    return spark.createDataFrame([(told["row_count"], len(told["columns"]), refused)], "row_count long, columns int, refused boolean")


def _archived(spark, sf_dir):
    runs = a.flag_runs(spark, sf_dir)
    return runs.select(F.concat_ws("-", "direction", F.col("seed").cast("string"), "node_id").alias("name"), F.col("time").cast("long").alias("time"), F.col("value").cast("double").alias("value"))


_ARCHIVED = f"WITH {c.FLAGS}, named AS (SELECT concat_ws('-', direction, CAST(seed AS VARCHAR), node_id) AS name, time, value FROM runs)"


@query("npz_round_trip", f"{_ARCHIVED} SELECT name, CAST(time AS BIGINT) AS time, round(value, 6) + 0.0 AS value FROM named")
def npz_round_trip(spark, sf_dir):
    path = tables.scratch(spark, "npz")
    npz.write_archives(_archived(spark, sf_dir), path)
    return npz.read_archives(spark, path, "name string, time long, value double", verify=True)


@query(
    "hidden_pair",
    f"{_ARCHIVED} SELECT name, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(time) AS BIGINT) AS times, round(sum(value), 6) + 0.0 AS total, CAST(0 AS BIGINT) AS shown FROM named GROUP BY name",
)
def hidden_pair(spark, sf_dir):
    public, hidden, schema = tables.scratch(spark, "public"), tables.scratch(spark, "hidden"), "name string, time long, value double"
    npz.write_archives(_archived(spark, sf_dir), public, ("value",), hidden)
    whole = npz.read_archives(spark, public, schema, hidden).groupBy("name").agg(F.count("*").alias("row_count"), F.sum("time").alias("times"), F.sum("value").alias("total"))
    shown = npz.read_archives(spark, public, schema).groupBy("name").agg(F.count("value").alias("shown"))
    return whole.join(shown, "name")


# ---- sweeps: one job each ---------------------------------------------------------------------------------

_FIT = {"lag": 2, "parent_alpha": 0.5, "fdr_alpha": 0.9, "support": 0.2, "votes": 0.1, "replicates": 20}


def _sweep(name: str, make) -> None:
    def run(spark, sf_dir):
        s, pairs = c._series(spark, sf_dir)
        return make(s, pairs, sorted({p[0] for p in pairs}))

    query(name)(run)


_sweep("data_efficiency", lambda s, pairs, nodes: sweeps.data_efficiency(s, pairs, (1, 4, 8), 3, _FIT))
_sweep("observation_robustness", lambda s, pairs, nodes: sweeps.observation_robustness(s, pairs, (0.1, 0.3), (0.05, 0.2), (0.1, 0.5), 2, _FIT))
_sweep("representation_robustness", lambda s, pairs, nodes: sweeps.representation_robustness(s, pairs, (0.1, 0.3), 2, _FIT))
_sweep("causal_scalability", lambda s, pairs, nodes: sweeps.timed_scalability(s, nodes, (3, 5, 10), 2, _FIT))
_sweep("functional_ablations", lambda s, pairs, nodes: sweeps.ablations(s, pairs[::2], nodes, _FIT))
_sweep("control_summary", lambda s, pairs, nodes: sweeps.control_summary(s, pairs, [tuple(nodes[:3]), tuple(nodes[1:4])], 4, 5, 12, fit=_FIT))


_FLAG_NODES = ["discount", "quantity"]


@query("mechanism_checks")
def mechanism_checks(spark, sf_dir):
    """Runs of the condition that turns the mechanism off: returned goods."""
    runs = a.flag_runs(spark, sf_dir).filter("direction = 'R'").select("seed", "time", "node_id", "value")
    return sweeps.mechanism_checks(runs, discovery.all_pairs(_FLAG_NODES), "returned", "sale", _FIT)


@query("intervention_ablations")
def intervention_ablations(spark, sf_dir):
    runs = a.flag_runs(spark, sf_dir)
    baseline = runs.filter("direction = 'A'").select("seed", "time", "node_id", "value")
    others = runs.filter("direction <> 'A'").select(F.lit("flag").alias("parameter"), "direction", "seed", "time", "node_id", "value")
    given, given_pairs = c._series(spark, sf_dir)
    config = {"bootstrap_repetitions": 100, "evaluation_start": 4, "onset_consecutive_steps": 2}
    return sweeps.intervention_ablations(baseline, others, [("quantity", "discount", "sale")], _FLAG_NODES, (given, given_pairs), _FIT, config)
