"""Windows, statistics, discovery and effects on series with known answers."""

from __future__ import annotations

import numpy as np
import pytest

from driftline.functions import stats
from driftline.operators import discovery, effects, secondary, windows
from tests.test_bands import first_onset


def test_false_discovery(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.002])], "g int, i int, p double")
    got = [r["q"] for r in windows.false_discovery(df, ["g"]).orderBy("i").collect()]
    assert got == pytest.approx([0.02, 0.04, 0.04, 0.008])


def test_onset(spark):
    v = [0.2, 0.2, 0.0, 0.3, 0.3, 0.3, 0.3]
    df = spark.createDataFrame([(0, t, x, abs(x) >= 0.1) for t, x in enumerate(v)], "k int, time int, value double, flag boolean")
    assert windows.onset(df, ["k"], "flag", "value", 0, 4).first()["onset"] == 3
    assert windows.onset(df, ["k"], "flag", "value", 4, 4).first()["onset"] == -1
    assert first_onset(np.array(v), np.abs(v) >= 0.1, 0, 4) == 3


def test_student_tail():
    assert stats.t_two_sided(np.array([2.228139]), 10)[0] == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(np.array([0.0]), 7)[0] == pytest.approx(1)


def test_fit_from_moments_matches_least_squares():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 4))
    x[:, 3] = x[:, 2]  # collinear
    y = 0.5 * x[:, 0] - x[:, 2] + rng.standard_normal(80)
    beta, p = stats.standardised_fit(stats.factor(np.column_stack([y, x])), 0, [1, 2, 3, 4])
    z = lambda a: (a - a.mean(0)) / a.std(0, ddof=1)
    want = np.linalg.lstsq(z(x), z(y), rcond=None)[0]
    assert beta == pytest.approx(want, abs=1e-8) and p[0] < 0.01
    flat = np.column_stack([y, np.ones(80)])
    assert stats.standardised_fit(stats.factor(flat), 0, [1]) == (pytest.approx([0]), pytest.approx([1]))


def lagged(spark, seeds=8, steps=260):
    rows = []
    for s in range(seeds):
        rng = np.random.default_rng(s)
        source, target = rng.standard_normal(steps), np.zeros(steps)
        for t in range(2, steps):
            target[t] = 0.45 * target[t - 1] + 0.85 * source[t - 2] + 0.25 * rng.standard_normal()
        rows += [(s, t, n, float(v[t])) for n, v in (("source", source), ("target", target)) for t in range(steps)]
    return spark.createDataFrame(rows, "seed int, time int, node_id string, value double")


PAIRS = [("source", "target", "g")]


def test_recovers_a_lagged_edge(spark):
    series = lagged(spark)
    edge = discovery.point_graph(series, PAIRS, 3, 0.1, 0.05).collect()
    assert len(edge) == 1 and edge[0]["lag"] == 2 and edge[0]["beta"] > 0 and edge[0]["q"] < 0.05
    kept, replicates = discovery.bootstrap_graph(series, PAIRS, 3, 0.1, 0.05, 5, 0.65)
    assert [(r["lag"], r["support"]) for r in kept.collect()] == [(2, 1.0)]
    again = discovery.bootstrap_graph(series.repartition(7), PAIRS, 3, 0.1, 0.05, 5, 0.65)[1]
    key = lambda df: sorted((r["replicate"], r["source"], r["lag"], round(r["beta"], 9)) for r in df.collect())
    assert key(replicates) == key(again)
    assert discovery.vote_graph(series, PAIRS, 3, 0.1, 0.05, 0.5).first()["lag"] == 2
    assert discovery.single_graph(series, PAIRS, 3, 0.1, 0.05).first()["lag"] == 2


def effect_runs(spark, shift=0.2, seeds=8, steps=40, flat=False):
    rows = []
    for s in range(seeds):
        base = np.zeros(steps) if flat else np.linspace(0, 1, steps) + 0.01 * s
        rows += [(s, t, "n", float(base[t]), float(base[t] + shift)) for t in range(steps)]
    df = spark.createDataFrame(rows, "seed int, time int, node_id string, b double, i double")
    b = df.select("seed", "time", "node_id", df.b.alias("value"))
    i = df.selectExpr("'p' AS parameter", "'plus' AS direction", "seed", "time", "node_id", "i AS value")
    return effects.pair_runs(b, i, ["parameter", "direction"])


CONFIG = {"bootstrap_repetitions": 30, "evaluation_start": 15, "terminal_window": 10}


def test_effects(spark):
    keys = ["parameter", "direction", "node_id"]
    r = effects.effect_summaries(effect_runs(spark), keys, CONFIG).first()
    assert r["cumulative_effect_raw"] == pytest.approx(0.2) and r["cumulative_effect_standardised"] > 0.3
    assert r["onset_time"] == 0 and r["significant"] and r["effect_sign"] == 1 and r["sign_consistency"] == 1
    m = effects.mean_effects(effect_runs(spark), keys, 15).first()
    assert m["standardised"] == pytest.approx(r["cumulative_effect_standardised"])


def test_effect_of_a_flat_baseline_is_not_estimable(spark):
    r = effects.effect_summaries(effect_runs(spark, 0.5, flat=True), ["parameter", "direction", "node_id"], CONFIG).first()
    assert not r["estimable"] and r["cumulative_effect_raw"] == pytest.approx(0.5)
    assert r["cumulative_effect_standardised"] is None and r["onset_time"] == -1 and r["peak_time"] == -1 and not r["significant"]


def test_unequal_seeds_are_an_error(spark):
    b = spark.createDataFrame([(0, 0, "n", 1.0), (1, 0, "n", 1.0)], "seed int, time int, node_id string, value double")
    i = b.filter("seed = 0").selectExpr("'p' AS parameter", "*")
    with pytest.raises(ValueError):
        effects.pair_runs(b, i, ["parameter"])


def classify(spark, macro_effect=0.3, macro_moved=True, onsets=(0, 0, 5), root_moved=True):
    e = spark.createDataFrame(
        [("p", "plus", "a", 0.5, onsets[0], root_moved), ("p", "plus", "b", 0.4, onsets[1], True), ("p", "plus", "c", macro_effect, onsets[2], macro_moved)],
        "parameter string, direction string, node_id string, cumulative_effect_standardised double, onset_time int, significant boolean",
    )
    graph = spark.createDataFrame([("a", "b", "macro_outcome_c", 4, -0.4, 0.01, 1.0), ("b", "c", "macro_outcome_c", 1, 0.4, 0.01, 1.0)], "source string, target string, group string, lag int, beta double, q double, support double")
    scales = spark.createDataFrame([("a", "micro"), ("b", "meso"), ("c", "macro")], "node_id string, scale string")
    roots = spark.createDataFrame([("p", "a")], "parameter string, root string")
    paths = spark.createDataFrame([("x", "p", "plus", "a", "b", "c", "increase", "increase", "increase")], "path_id string, parameter string, direction string, micro string, meso string, macro string, expected_micro string, expected_meso string, expected_macro string")
    routes = effects.manipulation_routes(graph, scales, roots, paths)
    tried = effects.attempts(graph, routes, e, spark.createDataFrame([("plus",)], "direction string"), 2)
    return effects.classify_paths(effects.qualified_paths(paths, graph), tried).first(), tried


def test_path_decisions(spark):
    row, tried = classify(spark)
    assert row["path_classification"] == "supported"  # lags and signs of edges do not decide
    assert {r["scope"] for r in tried.collect()} == {"direct_root", "upstream_mediated"}
    assert classify(spark, macro_effect=-0.3)[0]["path_classification"] == "contradicted"
    assert classify(spark, macro_moved=False)[0]["path_classification"] == "inconclusive"
    assert classify(spark, onsets=(2, 5, 3))[0]["path_classification"] == "inconclusive"
    assert classify(spark, root_moved=False)[0]["path_classification"] == "manipulation_failure"


@pytest.mark.parametrize(
    ("classes", "want", "holdout"),
    [
        (["supported", "directionally_contradicted"], "directionally_contradicted", "directionally_contradicted"),
        (["supported", "manipulation_failure"], "supported", "supported"),
        (["manipulation_failure", "manipulation_failure"], "manipulation_failure", "manipulation_failure"),
        (["manipulation_failure", "inconclusive"], "inconclusive", "manipulation_failure"),
        (["not_applicable"], "not_applicable", "not_applicable"),
        (["no_stable_downstream_effect", "inconclusive"], "no_stable_downstream_effect", "no_stable_downstream_effect"),
    ],
)
def test_edge_evidence(spark, classes, want, holdout):
    df = spark.createDataFrame([("g", "a", "b", c) for c in classes], "group string, source string, target string, primary_class string")
    assert effects.edge_evidence(df).first()["edge_class"] == want
    assert effects.edge_evidence(df, holdout=True).first()["edge_class"] == holdout


def test_doses(spark):
    assert list(secondary.dose_levels(0.2, 0.5, 0.9).values()) == pytest.approx([0.2, 0.35, 0.5, 0.7, 0.9])
    df = spark.createDataFrame([("k", d, 2 * d) for d in secondary.DOSES.values()] + [("q", d, d * d) for d in secondary.DOSES.values()], "k string, dose double, effect double")
    rows = {r["k"]: r for r in secondary.dose_summary(df, ["k"]).collect()}
    assert rows["k"]["slope"] == pytest.approx(2) and rows["k"]["rho"] == pytest.approx(1) and rows["k"]["monotone"] == rows["k"]["adjacent"] == 1
    assert rows["q"]["delta_r2"] == pytest.approx(1) and rows["q"]["nonlinear"]
    with pytest.raises(ValueError, match="incomplete"):
        secondary.dose_summary(df.filter("dose < 1"), ["k"])


def test_attenuation_and_agreement(spark):
    df = spark.createDataFrame([("a", 4.0, 1.0), ("b", 0.0, 1.0)], "k string, baseline double, disabled double")
    assert [r["attenuation"] for r in secondary.attenuation(df, ["k"]).orderBy("k").collect()] == [0.75, None]
    sets = spark.createDataFrame([(0, []), (1, []), (2, ["x"])], "g int, items array<string>")
    assert {(r["a"], r["b"]): r["jaccard"] for r in secondary.jaccard(sets, "g", "items").collect()} == {(0, 1): 1.0, (0, 2): 0.0, (1, 2): 0.0}


def test_interpolation_and_shift(spark):
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate([None, 1.0, None, 3.0, None])], "k int, time int, value double")
    assert [r["value"] for r in windows.interpolate(df, ["k"], "value").orderBy("time").collect()] == [1, 1, 2, 3, 3]
    shifts = spark.createDataFrame([(0, 2)], "k int, shift int")
    full = spark.createDataFrame([(0, t, float(t)) for t in range(5)], "k int, time int, value double")
    assert [r["value"] for r in windows.circular_shift(full, ["k"], "value", shifts).orderBy("time").collect()] == [3, 4, 0, 1, 2]


def test_stable_seed_is_fixed():
    assert stats.stable_seed(7, "a", 1) == stats.stable_seed(7, "a", 1) != stats.stable_seed(7, "a", 2)
    assert stats.draws(0, "x", 3, 5).shape == (3, 5)
