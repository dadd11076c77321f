"""Graphs against least squares on stacked rows, sweeps as cells, and the tables around them."""

from __future__ import annotations

import random
import json

import numpy as np
import pytest

from driftline.functions import stats
from driftline.operators import confirmation, discovery, effects, secondary, sweeps
from driftline.sources import tables

NODES = ["a", "b", "c"]
FIT = {"lag": 2, "parent_alpha": 0.2, "fdr_alpha": 0.1, "support": 0.5, "votes": 0.3, "replicates": 8}


def rows(seeds=6, steps=60):
    out = []
    for s in range(seeds):
        rng = np.random.default_rng(s)
        x = rng.standard_normal((steps, 3))
        for t in range(2, steps):
            x[t, 1] += 0.8 * x[t - 2, 0]
            x[t, 2] += 0.6 * x[t - 1, 1]
        out += [(s, t, n, float(x[t, i])) for i, n in enumerate(NODES) for t in range(steps)]
    return out


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(rows(), "seed int, time int, node_id string, value double").cache()


def stacked(data, target, sources, lag, seeds):
    """The lagged design of whole trajectories, row by row."""
    by = {(s, n): {} for s in seeds for n in NODES}
    for s, t, n, v in data:
        if (s, n) in by:
            by[s, n][t] = v
    x, y = [], []
    for s in seeds:
        for t in range(lag, len(by[s, target])):
            y.append(by[s, target][t])
            x.append([by[s, n][t - k] for n in (target, *sources) for k in range(1, lag + 1)])
    return np.array(x), np.array(y)


def plain_fit(x, y):
    n = len(y)
    z, r = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    b, _, rank, _ = np.linalg.lstsq(z, r, rcond=None)
    dof = max(n - rank, 1)
    rest = r - z @ b
    se = np.sqrt(np.diag(np.linalg.pinv(z.T @ z)) * (rest @ rest) / dof)
    return b, stats.t_two_sided(b / se, dof)


def plain_graph(data, seeds, lag, parent, fdr):
    """Point graph by the definition: screen, refit, false-discovery control over all terms, best lag of each pair."""
    terms = []
    for target in NODES:
        sources = [n for n in NODES if n != target]
        x, y = stacked(data, target, sources, lag, seeds)
        _, p = plain_fit(x, y)
        kept = [i for i in range(lag, x.shape[1]) if p[i] < parent]
        if kept:
            b, q = plain_fit(x[:, [*range(lag), *kept]], y)
            terms += [(sources[i // lag - 1], target, i % lag + 1, b[lag + k], q[lag + k]) for k, i in enumerate(kept)]
    order = sorted(range(len(terms)), key=lambda i: terms[i][4])
    q, low = {}, 1.0
    for rank in range(len(order), 0, -1):
        low = min(low, terms[order[rank - 1]][4] * len(terms) / rank)
        q[order[rank - 1]] = low
    best = {}
    for i, (s, t, k, b, p) in enumerate(terms):
        if (s, t) not in best or (q[i], k) < best[s, t][:2]:
            best[s, t] = (q[i], k, b, p)
    return {pair: v for pair, v in best.items() if v[0] < fdr}


def test_point_and_bootstrap_graphs_equal_stacked_least_squares(series):
    pairs, data = discovery.all_pairs(NODES), rows()
    want = plain_graph(data, range(6), 2, 0.2, 0.1)
    got = {(r["source"], r["target"]): r for r in discovery.point_graph(series, pairs, 2, 0.2, 0.1).collect()}
    assert set(got) == set(want) and len(want) >= 2
    for pair, (q, lag, b, p) in want.items():
        r = got[pair]
        assert r["lag"] == lag and r["beta"] == pytest.approx(b, abs=1e-9) and r["p"] == pytest.approx(p, abs=1e-9) and r["q"] == pytest.approx(q, abs=1e-9)
    kept, resampled = discovery.bootstrap_graph(series, pairs, 2, 0.2, 0.1, 5, 0.0)
    every = [plain_graph(data, list(map(int, row)), 2, 0.2, 0.1) for row in _draws_as_runs(5)]
    support = {(r["source"], r["target"]): r["support"] for r in kept.collect()}
    assert support == {pair: pytest.approx(sum(pair in g for g in every) / 5) for pair in want}
    found = {(r["replicate"], r["source"], r["target"]): (r["lag"], round(r["beta"], 7)) for r in resampled.collect()}
    assert found == {(i, *pair): (v[1], round(v[2], 7)) for i, g in enumerate(every) for pair, v in g.items()}


def _draws_as_runs(n):
    return stats.draws(0, "bootstrap", n, 6)


def test_near_collinear_columns_lose_nothing():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3))
    x = np.column_stack([x, x[:, 0] + 1e-6 * rng.standard_normal(300)])
    y = x @ [1.0, 0.5, 0, 0] + rng.standard_normal(300)
    beta, p = stats.standardised_fit(stats.factor(np.column_stack([y + 1e6, x + 1e4])), 0, [1, 2, 3, 4])
    b, q = plain_fit(x + 1e4, y + 1e6)
    assert beta == pytest.approx(b, rel=1e-3) and p == pytest.approx(q, abs=1e-3)


def test_votes_and_single(series):
    pairs, data = discovery.all_pairs(NODES), rows()
    each = [plain_graph(data, [s], 2, 0.2, 0.1) for s in range(6)]
    got = {(r["source"], r["target"]): r["support"] for r in discovery.vote_graph(series, pairs, 2, 0.2, 0.1, 0.3).collect()}
    counts = {pair: sum(pair in g for g in each) / 6 for g in each for pair in g}
    assert got == {p: pytest.approx(v) for p, v in counts.items() if v >= 0.3}
    assert {(r["source"], r["target"]) for r in discovery.single_graph(series, pairs, 2, 0.2, 0.1).collect()} == set(each[0])


def test_sweeps_have_a_row_for_each_setting(series):
    pairs = discovery.all_pairs(NODES)
    eff = sweeps.data_efficiency(series, pairs, (1, 4, 6), 2, FIT).collect()
    assert len(eff) == 12 and all(r["estimable"] == (r["trajectories"] > 1) for r in eff)
    whole = next(r for r in eff if r["trajectories"] == 6 and r["method"] == "full_method")
    assert whole["retained"] >= 2 and whole["rate_low"] <= whole["rate_high"] and whole["stability"] > 0.5
    obs = sweeps.observation_robustness(series, pairs, (0.0, 5.0), (0.3,), (0.5, 1.01), 1, FIT).collect()
    by = {(r["factor"], r["noise"], r["missing"], r["support_level"]): r["retained"] for r in obs}
    assert len(obs) == 5 and by["support_threshold", 0.0, 0.0, 1.01] == 0 and by["observation_noise", 0.0, 0.0, 0.5] >= 2
    rep = sweeps.representation_robustness(series, pairs, (0.4,), 1, FIT).collect()
    assert len(rep) == 5 and len({r["candidate_sha256"] for r in rep}) >= 4
    deleted = next(r for r in rep if r["operator"] == "delete_candidate_relation")
    assert deleted["candidates"] == 4 and all(r["retained"] <= r["candidates"] for r in rep)
    scale = {r["indicators"]: (r["candidates"], r["edges"]) for r in sweeps.scalability(series, NODES, (2, 5), 1, FIT).collect()}
    timed = sweeps.timed_scalability(series, NODES, (2, 5), 1, FIT).collect()
    assert {r["indicators"]: r["candidates"] for r in timed} == {k: v[0] for k, v in scale.items()}
    assert all(r["seconds"] > 0 and r["edges"] <= r["candidates"] for r in timed)
    assert scale[2][0] == 2 and scale[5][0] == 20 and scale[5][1] >= 2
    control = sweeps.control_summary(series, pairs, [("a", "b", "c")], 2, 5, 12, 4, FIT).collect()
    assert len(control) == 2 and all(r["ratio_to_primary"] == r["retained"] / 4 for r in control)
    assert {r["variant"] for r in sweeps.ablations(series, pairs[:4], NODES, FIT).collect()} >= {"full_method", "without_bootstrap"}
    assert sweeps.mechanism_checks(series, pairs, "v", "t", FIT).first()["retained"] >= 2


def test_recovery_counts_found_lags_and_found_directions(spark):
    truth = spark.createDataFrame([("a", "b", 0, 1.0), ("b", "c", 2, 0.0), ("c", "d", 1, 1.0)], "source string, target string, lag int, beta double")
    found = spark.createDataFrame([("a", "b", 3, 0.5, 0.5), ("b", "c", 0, 0.4, 1.0), ("x", "y", 1, 1.0, None)], "source string, target string, lag int, beta double, support double")
    r = secondary.recovery(truth, found).first()
    assert (r["lag_mae"], r["direction_accuracy"], r["stability"], r["retained"], r["shd"]) == (3.0, 0.5, 0.75, 3, 2)


def test_onsets_and_peaks_are_times(spark):
    data = [(s, t, "n", 0.01 * s + 0.1 * (t % 3), 0.01 * s + 0.1 * (t % 3) + (5.0 if t >= 108 else 0.0)) for s in range(6) for t in range(100, 120)]
    df = spark.createDataFrame(data, "seed int, time int, node_id string, b double, i double")
    pairs = effects.pair_runs(df.selectExpr("seed", "time", "node_id", "b AS value"), df.selectExpr("'p' AS parameter", "seed", "time", "node_id", "i AS value"), ["parameter"])
    r = effects.effect_summaries(pairs, ["parameter", "node_id"], {"bootstrap_repetitions": 20, "evaluation_start": 105}).first()
    assert (r["onset_time"], r["peak_time"], r["significant"]) == (108, 108, True)
    assert r["cumulative_effect_raw"] == pytest.approx(effects.mean_effects(pairs, ["parameter", "node_id"], 105).first()["raw"])


def test_more_edges_than_candidates_and_unknown_paths_are_errors(spark):
    edges = spark.createDataFrame([("m", 1.0, 1.0, 0.0)] * 3, "method string, support double, lag_support double, lag_std double")
    with pytest.raises(Exception, match="more edges"):
        confirmation.graph_table(edges, spark.createDataFrame([("m", 2)], "method string, candidates long"), ["method"]).collect()
    paths = spark.createDataFrame([("p", "x", "plus", "a", "b", "c", "increase", "increase", "increase")], "path_id string, parameter string, direction string, micro string, meso string, macro string, expected_micro string, expected_meso string, expected_macro string")
    with pytest.raises(ValueError):
        confirmation.confirm_predictions(spark.createDataFrame([("1", "q")], "prediction_id string, path_id string"), paths, edges, edges)


def test_frozen_values_and_immutable_files(tmp_path, spark):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": {"b": 1}, "c": 2}))
    assert tables.load_config(str(path), {"a.b": 1})["c"] == 2
    with pytest.raises(ValueError, match="a.b"):
        tables.load_config(str(path), {"a.b": 3, "c": 2})
    out = str(tmp_path / "x.json")
    assert tables.write_immutable(out, {"k": 1}) == tables.write_immutable(out, {"k": 1})
    with pytest.raises(ValueError):
        tables.write_immutable(out, {"k": 2})
    with pytest.raises(ValueError):
        tables.check_rows(spark.range(0), {"id": "bigint"})
    with pytest.raises(ValueError):
        tables.check_rows(spark.range(3), {"id": "string"})
    runs = spark.createDataFrame([("baseline", 1), ("x", 1)], "condition string, seed int")
    twice = runs.union(runs).selectExpr("*", "'primary' AS partition")
    with pytest.raises(ValueError):
        tables.scan_phase(runs, twice, "baseline")


def test_six_ablations_and_what_deals_seeds_anew_changes(spark):
    r = random.Random(4)
    base, more = [], []
    for s in range(8):
        a = [r.gauss(0, 1) + s for _ in range(40)]
        for t in range(40):
            b = 0.9 * a[t - 1] + 0.1 * r.gauss(0, 1) if t else 0.0
            base += [(s, t, "a", a[t]), (s, t, "b", b)]
            for d, step in (("up", 3.0), ("down", -3.0)):
                more += [("p", d, s, t, "a", a[t] + step * (t > 9)), ("p", d, s, t, "b", b + step * (t > 10))]
    baseline = spark.createDataFrame(base, "seed int, time int, node_id string, value double")
    moved = spark.createDataFrame(more, "parameter string, direction string, seed int, time int, node_id string, value double")
    config = {"bootstrap_repetitions": 40, "evaluation_start": 12, "onset_consecutive_steps": 3}
    given = baseline.replace({"a": "x", "b": "y"}, subset=["node_id"])
    got = {x["variant"]: x for x in sweeps.intervention_ablations(baseline, moved, [("a", "b", "g")], ["a", "b"], (given, [("x", "y", "g")]), FIT, config).collect()}
    assert len(got) == 6 and all(x["retained"] <= x["candidates"] for x in got.values())
    full, unpaired, given = got["full_method"], got["without_paired_seeds"], got["predefined_observable_baseline"]
    assert full["retained"] == unpaired["retained"] == given["retained"] == 1 and full["intervention_support_rate"] == 1.0
    assert unpaired["mean_ci_width"] > 5 * full["mean_ci_width"] and given["mean_ci_width"] is None and given["intervention_support_rate"] is None
    assert got["without_structured_representation"]["candidates"] == 2 and got["without_bootstrap"]["stability"] is None
