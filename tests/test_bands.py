"""Bands made of blocks of seeds and times equal those of whole matrices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.stats import stable_seed
from driftline.operators import effects

CONFIG = effects.CONFIG | {"bootstrap_repetitions": 40, "evaluation_start": 5, "terminal_window": 4, "onset_consecutive_steps": 3}
KEYS = ["parameter", "direction", "node_id"]


def first_onset(curve: np.ndarray, significant: np.ndarray, start: int, run: int, times: np.ndarray | None = None) -> int:
    """The first time (step, without times) from start on that begins `run` significant steps of one sign, or -1."""
    sign = np.where(significant, np.sign(np.nan_to_num(curve)), 0)
    times = np.arange(len(sign)) if times is None else times
    for t in range(len(sign) - run + 1):
        if times[t] >= start and sign[t] != 0 and (sign[t : t + run] == sign[t]).all():
            return int(times[t])
    return -1


def plain_summary(rows, config) -> dict:
    """The summary of one effect (seed, time, baseline, difference) from whole matrices; its key is p, plus."""
    seeds, times = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    b, d = np.full((len(seeds), len(times)), np.nan), np.full((len(seeds), len(times)), np.nan)
    for s, t, base, diff in rows:
        if diff is not None:
            b[seeds.index(s), times.index(t)], d[seeds.index(s), times.index(t)] = base, diff
    full = ~np.isnan(d).any(axis=0)
    b, d, times = b[:, full], d[:, full], np.array(times)[full]
    late = times >= config["evaluation_start"]
    sd = b[:, late].std(ddof=1)
    index = np.random.default_rng(stable_seed(config["master_seed"], "effect", "p", "plus")).integers(0, len(seeds), size=(config["bootstrap_repetitions"], len(seeds)))
    boot, mean, t = d[index].mean(axis=1) / sd, d.mean(axis=0) / sd, config["minimum_standardised_effect"]
    curve, total = np.quantile(boot, [0.025, 0.975], axis=0), np.quantile(boot[:, late].mean(axis=1), [0.025, 0.975])
    how = (config["onset_detection_start"], config["onset_consecutive_steps"], times)
    onset = first_onset(mean, (curve[0] > t) | (curve[1] < -t), *how)
    onsets = [x for x in (first_onset(c, np.abs(c) >= t, *how) for c in boot) if x >= 0]
    raw = mean[late].mean()
    return {
        "cumulative_effect_standardised": raw, "cumulative_ci_low": total[0], "cumulative_ci_high": total[1], "baseline_sd": sd,
        "terminal_effect_standardised": mean[-config["terminal_window"] :].mean(), "onset_time": onset,
        "onset_ci_low": np.quantile(onsets, 0.025) if onsets else None, "onset_ci_high": np.quantile(onsets, 0.975) if onsets else None,
        "peak_time": times[late][np.argmax(np.abs(mean[late]))], "effect_sign": np.sign(raw), "sign_consistency": (np.sign(d[:, late].mean(axis=1)) == np.sign(raw)).mean(),
        "significant": onset >= 0 and bool(total[0] > t or total[1] < -t), "estimable": True, "_curve": curve, "_times": times,
    }


def _rows(shift: float, gap: bool):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.normal()), float(shift * (t >= 7) + rng.normal() / 4)) for s in range(11) for t in range(20)]
    return [r if not (gap and r[:2] == (4, 9)) else (4, 9, None, None) for r in rows if not (gap and r[:2] == (2, 12))]


def _pairs(spark, rows):
    return spark.createDataFrame([("p", "plus", "n", *r) for r in rows], "parameter string, direction string, node_id string, seed int, time int, baseline double, difference double")


@pytest.mark.parametrize("block", [(1024, 64), (4, 6)])
@pytest.mark.parametrize("shift, gap", [(0.6, False), (-0.4, True), (0.0, True)])
def test_blocks_equal_matrices(spark, monkeypatch, block, shift, gap):
    monkeypatch.setattr(effects, "SEEDS", block[0])
    monkeypatch.setattr(effects, "TIMES", block[1])
    rows = _rows(shift, gap)
    want = plain_summary(rows, CONFIG)
    curve, times = want.pop("_curve"), want.pop("_times")
    got = effects.effect_summaries(_pairs(spark, rows), KEYS, CONFIG).collect()
    assert len(got) == 1
    for name, x in want.items():
        assert got[0][name] == (pytest.approx(float(x)) if x is not None else None), name
    course = effects.effect_curves(_pairs(spark, rows), KEYS, CONFIG).orderBy("time").collect()
    assert [r["time"] for r in course] == list(times)
    assert np.allclose([[r["low"] for r in course], [r["high"] for r in course]], curve)


def test_odd_pairs(spark):
    """Repeated rows count once, NaN is missing, an effect without a whole time is told but not estimated, null keys go."""
    rows = _rows(0.6, False)
    once = effects.effect_summaries(_pairs(spark, rows), KEYS, CONFIG).first()
    twice = effects.effect_summaries(_pairs(spark, rows + rows[:30]), KEYS, CONFIG).first()
    assert all(twice[n] == (pytest.approx(x) if isinstance(x, float) else x) for n, x in once.asDict().items())  # sums of another order
    nan = [(s, t, b, float("nan") if t == 3 else d) for s, t, b, d in rows]
    assert 3 not in {r["time"] for r in effects.effect_curves(_pairs(spark, nan), KEYS, CONFIG).collect()}
    none = effects.effect_summaries(_pairs(spark, [(0, 1, 0.0, 1.0), (1, 2, 0.0, 1.0)]), KEYS, CONFIG).first()
    assert not none["estimable"] and none["cumulative_effect_raw"] is None and none["onset_time"] == -1 and not none["significant"]
    assert effects.effect_summaries(_pairs(spark, []), KEYS, CONFIG).isEmpty() and effects.effect_curves(_pairs(spark, []), KEYS, CONFIG).isEmpty()
    assert effects.effect_summaries(_pairs(spark, rows).withColumn("direction", F.lit(None).cast("string")), KEYS, CONFIG).isEmpty()
