"""Given representations, hidden channels and validators, against plain versions."""

from __future__ import annotations

import copy
import math

import numpy as np
import pytest

from driftline.operators import channels
from driftline.plans import comparators, grammar, validators
from driftline.sources import adapters

SCENARIOS = sorted(comparators.INDICATORS)


def _fields(spark, sf, scenario):
    return (adapters.city if scenario == "schelling" else adapters.circle)(spark, sf).fields


@pytest.fixture(scope="module")
def fields(spark, sf):
    return {s: _fields(spark, sf, s) for s in SCENARIOS}


@pytest.mark.parametrize("scenario", SCENARIOS)
def test_twenty_eight_indicators_over_time(fields, scenario):
    found = comparators.indicators(scenario)
    assert len(found) == 28 and all(grammar.analyze_indicator(n, fields[scenario]).dims == ("time",) for n in found.values())
    edges = comparators.candidate_edges(scenario)
    assert len(edges) == len(set(edges)) == 28 and {n for e in edges for n in e} == set(found)
    scale = lambda n: n.split("_")[1]
    assert {(scale(s), scale(t)) for s, t in edges} == {("micro", "meso"), ("meso", "macro")}


@pytest.mark.parametrize("scenario", SCENARIOS)
def test_truth_is_typed_and_linked(fields, scenario):
    known = fields[scenario] | {"mechanism_channel": grammar.TensorType("numeric", ("time", "channel"))}
    found = comparators.processes(scenario)
    assert len(found) == 12 and all(grammar.analyze(n, known).dims == ("time",) for n in found.values())
    relations = comparators.relations(scenario)
    assert len(relations) == 8 and {n for r in relations for n in r[:2]} == set(found)
    variant, mechanism = comparators.DISABLED[scenario]
    assert comparators.disabled_mechanism(scenario, variant) == mechanism in {r[4] for r in relations}
    assert comparators.disabled_mechanism(scenario, "baseline") is None
    with pytest.raises(ValueError):
        comparators.disabled_mechanism(scenario, "other")


def _plain_channel(driver, context, shocks, lag, sign, memory, disabled):
    out = [0.5]
    for t in range(1, len(driver)):
        goal = 0.5 + 0.3 * (min(max(context[t], 0), 1) - 0.5) + shocks[t]
        if t >= lag and not disabled:
            goal += 0.6 * sign * (min(max(driver[t - lag], 0), 1) - 0.5)
        out.append(min(max(memory * out[-1] + (1 - memory) * goal, 0), 1))
    return out


@pytest.mark.parametrize("lag, sign, disabled", [(1, 1, False), (5, -1, False), (3, 1, True), (50, 1, False)])
def test_delayed_channel_equals_a_loop(lag, sign, disabled):
    rng = np.random.default_rng(lag)
    driver, context = rng.uniform(-0.5, 1.5, (2, 40))
    shocks = channels.noise(3, 40, 700)
    got = channels.delayed(driver, context, shocks, lag, sign, 0.45, disabled)
    assert got == pytest.approx(_plain_channel(driver, context, shocks, lag, sign, 0.45, disabled), abs=1e-12)
    assert len(channels.delayed(driver[:0], context[:0], shocks[:0], lag, sign, 0.45)) == 0
    with pytest.raises(ValueError):
        channels.delayed(driver, context[:-1], shocks, lag, sign, 0.45)


def test_hidden_channels_of_runs(spark):
    names = list(comparators.drivers("schelling"))
    value = lambda seed, t, i: ((seed * 31 + t * 7 + i * 3) % 10) / 10
    rows = [(s, t * 2, n, value(s, t, i)) for s in (1, 2) for t in range(9) for i, n in enumerate(names)]
    series = spark.createDataFrame(rows, "seed long, time long, node_id string, value double").repartition(3)
    got = {(r["seed"], r["time"]): r for r in channels.hidden_channels(series, "schelling", ("seed",), "seed", "disable_homophilic_relocation").collect()}
    assert len(got) == 18
    for s in (1, 2):
        for i, (mechanism, _, _, lag, sign, late, _, _) in enumerate(comparators.CHAINS["schelling"]):
            of = {n: [value(s, t, k) for t in range(9)] for k, n in enumerate(names)}
            off = mechanism == "homophilic_destination_selection"
            meso = _plain_channel(of[f"driver_{i}"], of[f"meso_{i}"], channels.noise(s, 9, 700 + i), lag, sign, 0.45, off)
            macro = _plain_channel(meso, of[f"macro_{i}"], channels.noise(s, 9, 800 + i), late, 1, 0.7, off)
            assert [got[s, t * 2][f"mechanism_channel_{i}"] for t in range(9)] == pytest.approx(meso, abs=1e-12)
            assert [got[s, t * 2][f"mechanism_channel_{i + 4}"] for t in range(9)] == pytest.approx(macro, abs=1e-12)
    gap = series.filter("NOT (seed = 1 AND time = 6 AND node_id = 'meso_0')")
    lost = {(r["seed"], r["time"]): r["mechanism_channel_0"] for r in channels.hidden_channels(gap, "schelling", ("seed",), "seed").collect()}
    assert [lost[1, t * 2] is None for t in range(9)] == [False] * 3 + [True] * 6 and lost[2, 16] is not None
    assert channels.hidden_channels(series.limit(0), "schelling", ("seed",), "seed").count() == 0


# ---- validators ----------------------------------------------------------------------------------

BUDGET = {"micro": 16, "meso": 8, "macro": 4}


def _faults(value, fields, scenario="schelling", **more):
    levels = {f: "agent" if "agent" in t.dims else "edge" if "edge" in t.dims else "cell" for f, t in fields[scenario].items()}
    return validators.indicator_faults(value, scenario, fields[scenario], levels, set(comparators.DIRECT[scenario].values()), BUDGET, **more)


@pytest.mark.parametrize("scenario", SCENARIOS)
def test_given_sets_are_sound_but_for_meso_shape(fields, scenario):
    """What the meso rules refuse in the given sets is refused for that alone."""
    found = _faults(comparators.representation(scenario), fields, scenario)
    assert {what for _, what in found} <= {"meso compares no intermediate units"}


def _changed(at, **keys):
    value = copy.deepcopy(comparators.representation("schelling"))
    (value if at is None else value["indicators"][at]).update(keys)
    return value


@pytest.mark.parametrize(
    "at, keys, where, what",
    [
        (None, {"scenario": "deffuant"}, "set", "scenario is not"),
        (None, {"interpretation_boundary": "Temporal only."}, "set", "boundary"),
        (0, {"scale": "meso", "entity_scope": "district"}, "set", "15 of 16 micro"),
        (0, {"entity_scope": "district"}, "sfix_micro_00", "no scope"),
        (1, {"source_fields": ["unhappy"]}, "sfix_micro_01", "source fields are ['moved']"),
        (2, {"computation": comparators.field("unhappy")}, "sfix_micro_02", "an indicator is a number over time"),
        (2, {"computation": {"op": "warp"}}, "sfix_micro_02", "no operator"),
        (2, {"temporal_aggregation": {"op": "rolling_mean"}}, "sfix_micro_02", "other keys"),
        (3, {"computation": comparators.one("connected_component_count", "state_grid"), "source_fields": ["state_grid"]}, "sfix_micro_03", "micro measures the whole system"),
        (3, {"computation": comparators.agents("mean", "neighbour_count"), "source_fields": ["neighbour_count"]}, "set", "equal computations"),
        (16, {"computation": comparators.agents("mean", "agent_group")}, "sfix_meso_00", "no intermediate units"),
        (0, {"parameter_associations": []}, "set", "['tolerance']"),
        (4, {"parameter_associations": [{"parameter": "wind", "relationship": "direct"}]}, "sfix_micro_04", "unknown parameter wind"),
        (5, {"id": "sfix_micro_04"}, "set", "repeated indicator sfix_micro_04"),
    ],
)
def test_faults_of_sets(fields, at, keys, where, what):
    found = _faults(_changed(at, **keys), fields)
    assert any(w == where and what in fault for w, fault in found), found


def _paths():
    micro = {p: f"sfix_micro_{i:02d}" for i, p in comparators.DIRECT["schelling"].items()}
    return [
        {"path_id": f"{p}:{i}", "parameter": p, "micro_indicator": m, "meso_indicator": f"sfix_meso_{(i + k) % 8:02d}", "macro_indicator": f"sfix_macro_{[0, 2, 3, 0 if p == 'move_probability' else 1][i]:02d}"}
        for k, (p, m) in enumerate(micro.items())
        for i in range(4)
    ]


def _path_faults(paths, predictions=None, total=(12, 16)):
    chosen = [p["path_id"] for p in paths][:: max(len(paths) // 6, 1)][:6] if predictions is None else predictions
    return validators.path_faults(paths, chosen, comparators.representation("schelling"), set(comparators.DIRECT["schelling"].values()), {}, total)


def test_faults_of_paths():
    paths = _paths()
    assert _path_faults(paths) == []
    change = lambda **k: [paths[0] | k, *paths[1:]]
    for changed, what in [
        (paths[1:], "11 paths"),
        (paths[1:], "has 3 paths, not 4"),
        (change(parameter="wind"), "unknown parameter"),
        (change(micro_indicator="none"), "unknown indicators ['none']"),
        (change(meso_indicator="sfix_macro_00"), "not micro, meso and macro"),
        (change(micro_indicator="sfix_micro_03"), "not moved directly"),
        # the fourth macro indicator is the rolled share of movers, which is the micro indicator itself
        ([p | {"macro_indicator": "sfix_macro_01"} if p["parameter"] == "move_probability" else p for p in paths], "one measure"),
    ]:
        found = _path_faults(changed)
        assert any(what in fault for _, fault in found), (what, found)
    assert ("predictions", "1 of 6") in _path_faults(paths, ["tolerance:0"])
    assert ("predictions", "not every parameter is predicted") in _path_faults(paths, [f"tolerance:{i}" for i in range(4)] * 2)


def test_scopes_cover_the_scales():
    assert set(validators.SCOPES) == set(validators.SCALES) == set(BUDGET) and not math.prod(len(s) for s in validators.SCOPES.values()) == 0
