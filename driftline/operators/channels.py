"""Hidden channels: delayed answers to a driver, in a context, with a memory.

Each step needs the one before, so a run is one group; runs are as parallel as there are runs, and a
group holds one run's twelve series, never its agents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.nulls import clean
from driftline.plans import comparators
from driftline.sources.simulators import chance

# First streams and memories of meso and macro channels, spread of the noise, weights of context and driver.
STREAMS, MEMORY = {"meso": 700, "macro": 800}, {"meso": 0.45, "macro": 0.70}
NOISE, CONTEXT, DRIVER = 0.025, 0.30, 0.60


def noise(seed: int, steps: int, stream: int) -> np.ndarray:
    return np.array([chance(seed, t, stream).normal(0.0, NOISE) for t in range(steps)])


def delayed(driver: np.ndarray, context: np.ndarray, shocks: np.ndarray, lag: int, sign: int, memory: float, disabled: bool = False) -> np.ndarray:
    """The channel: 0.5 at first, then memory of itself and a target of context, shock and the driver lag steps ago.

    A missing driver or context leaves the channel missing from there on.
    """
    if len(driver) != len(context):
        raise ValueError("driver and context are of different lengths")
    goal = 0.5 + CONTEXT * (np.clip(context, 0, 1) - 0.5) + shocks
    if not disabled:
        goal[lag:] += DRIVER * sign * (np.clip(driver, 0, 1) - 0.5)[: max(len(driver) - lag, 0)]
    out = np.full(len(driver), 0.5)
    for t in range(1, len(out)):
        out[t] = np.clip(memory * out[t - 1] + (1 - memory) * goal[t], 0, 1)
    return out


def hidden_channels(series: DataFrame, scenario: str, keys: tuple[str, ...], seed: str, variant: str = "baseline") -> DataFrame:
    """keys, time, mechanism_channel_0 to _7 (four meso, four macro).

    series: keys, time, node_id, value of comparators.drivers(scenario); steps are ranks of time, seed is
    one of keys, a whole number. A step that lacks a series has it missing.
    """
    off = comparators.disabled_mechanism(scenario, variant)
    rows = [(mechanism, lag, sign, late) for mechanism, _, _, lag, sign, late, _, _ in comparators.CHAINS[scenario]]
    names = list(comparators.drivers(scenario))
    wide = series.groupBy(*keys, "time").pivot("node_id", names).agg(F.first("value"))
    kinds = dict(wide.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in (*keys, "time")] + [f"mechanism_channel_{i} double" for i in range(8)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        of = {n: pdf[n].to_numpy(float) for n in names}
        out = pdf[[*keys, "time"]].copy()
        number, steps = int(pdf[seed].iloc[0]), len(pdf)
        for i, (mechanism, lag, sign, late) in enumerate(rows):
            shocks = [noise(number, steps, STREAMS[s] + i) for s in ("meso", "macro")]
            meso = delayed(of[f"driver_{i}"], of[f"meso_{i}"], shocks[0], lag, sign, MEMORY["meso"], mechanism == off)
            out[f"mechanism_channel_{i}"] = meso
            out[f"mechanism_channel_{i + 4}"] = delayed(meso, of[f"macro_{i}"], shocks[1], late, 1, MEMORY["macro"], mechanism == off)
        return out

    found = wide.groupBy(*keys).applyInPandas(run, schema)
    return found.select(*keys, "time", *[clean(F.col(f"mechanism_channel_{i}")).alias(f"mechanism_channel_{i}") for i in range(8)])
