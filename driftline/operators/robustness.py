"""Robustness sweeps: perturbed, thinned and corrupted inputs as tables, then the same discovery."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.stats import stable_seed
from driftline.operators import confirmation
from driftline.operators.windows import interpolate

CORRUPTIONS = (
    "irrelevant_indicator",
    "cross_hypothesis_group_relation",
    "delete_candidate_relation",
    "wrong_hypothesis_group_assignment",
    "redundant_semantic_indicator",
)


def add_noise(series: DataFrame, level: float, master: int, label: str = "noise") -> DataFrame:
    """series with normal noise of level times each trajectory's spread of a node, its own draws for each."""
    kind = series.schema["seed"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("time")
        v = table["value"].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
        rng = np.random.default_rng(stable_seed(master, label, level, table["seed"][0].as_py(), table["node_id"][0].as_py()))
        sd = np.nanstd(v, ddof=1) if np.isfinite(v).sum() > 1 else 0.0
        out = v + rng.standard_normal(len(v)) * sd * level
        return table.set_column(table.schema.get_field_index("value"), "value", pa.array(out, from_pandas=True))

    rows = series.select("seed", "time", "node_id", "value")
    return rows.groupBy("seed", "node_id").applyInArrow(run, f"seed {kind}, time {rows.schema['time'].dataType.simpleString()}, node_id string, value double")


def drop_values(series: DataFrame, fraction: float, master: int, label: str = "missing") -> DataFrame:
    """series with a fraction of its values missing, chosen by a hash of their place, and filled by interpolation."""
    u = F.pmod(F.xxhash64("seed", "node_id", "time", F.lit(f"{master}:{label}")), F.lit(1 << 30)) / float(1 << 30)
    thin = series.select("seed", "node_id", "time", F.when(u >= fraction, F.col("value")).alias("value"))
    return interpolate(thin, ["seed", "node_id"], "value")


def subset(series: DataFrame, n: int, master: int, label: str = "subset", repetition: int = 0) -> DataFrame:
    """n whole trajectories without replacement."""
    seeds = sorted(r["seed"] for r in series.select("seed").distinct().collect())
    if n > len(seeds):
        raise ValueError(f"{n} trajectories of {len(seeds)}")
    rng = np.random.default_rng(stable_seed(master, label, n, repetition))
    chosen = [seeds[i] for i in rng.choice(len(seeds), n, replace=False)]
    return series.filter(F.col("seed").isin(chosen))


def corrupt(pairs: list[tuple[str, str, str]], kind: str, ratio: float, master: int) -> tuple[list[tuple[str, str, str]], dict[str, str | None]]:
    """Candidates with max(1, round(ratio * n)) of them corrupted, and series to add: name -> copied node, or None for noise."""
    rng = np.random.default_rng(stable_seed(master, kind, ratio))
    count, out, added = max(1, round(ratio * len(pairs))), list(pairs), {}
    groups = sorted({p[2] for p in pairs})
    chosen = [int(i) for i in rng.choice(len(pairs), min(count, len(pairs)), replace=False)]
    if kind == "delete_candidate_relation":
        out = [p for i, p in enumerate(pairs) if i not in chosen]
    elif kind == "wrong_hypothesis_group_assignment":
        for i in chosen:
            others = [x for x in groups if x != out[i][2]] or ["other"]
            out[i] = (*out[i][:2], others[int(rng.integers(len(others)))])
    elif kind == "cross_hypothesis_group_relation":
        new = sorted({(p[0], q[1], p[2]) for p in pairs for q in pairs if p[2] != q[2] and p[0] != q[1]} - set(pairs))
        out += [new[int(i)] for i in rng.choice(len(new), min(count, len(new)), replace=False)]
    elif kind in ("irrelevant_indicator", "redundant_semantic_indicator"):
        for k, i in enumerate(chosen):
            name = f"{kind}_{k}"
            added[name] = pairs[i][0] if kind == "redundant_semantic_indicator" else None
            out.append((name, pairs[i][1], pairs[i][2]))
    else:
        raise ValueError(kind)
    return sorted({p for p in out if p[0] != p[1]}), added


KINDS = ("delete_candidate_relation", "wrong_hypothesis_group_assignment", "cross_hypothesis_group_relation", "irrelevant_indicator", "redundant_semantic_indicator")


def corrupt_table(candidates: DataFrame, nodes: DataFrame, kind: str, ratio: float, master: int = 0) -> tuple[DataFrame, DataFrame]:
    """candidates (source, target, group) with max(1, round(ratio * n)) of them corrupted, and node_id, source of the series to add (source: null for noise).

    The ones taken have the lowest hashes of what they are, so that nothing hangs on partitions. nodes: node_id, scale;
    new relations lead from a scale to the next and are no candidates yet: a join of scales and an anti-join.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    rows = candidates.select("source", "target", "group").distinct()
    count = max(1, round(ratio * rows.count()))

    def lowest(df: DataFrame) -> DataFrame:
        order = (F.md5(F.concat_ws(":", F.lit(f"{master}:{kind}"), *df.columns)), *df.columns)
        taken = df.orderBy(*order).limit(count)
        return taken.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1)

    none = rows.sparkSession.createDataFrame([], "node_id string, source string")
    if kind == "cross_hypothesis_group_relation":
        new = lowest(confirmation.scale_pairs(nodes, rows)).select("source", "target", F.lit("corrupt_macro_outcome_group"))
        return rows.union(new), none
    chosen = lowest(rows)
    rest = rows.join(chosen, ["source", "target", "group"], "left_anti")
    if kind == "delete_candidate_relation":
        return rest, none
    if kind == "wrong_hypothesis_group_assignment":
        return rest.union(chosen.select("source", "target", F.concat(F.lit("misassigned_"), (F.col("_i") % 4).cast("string")))).distinct(), none
    name = F.concat(F.lit(f"corrupt_{kind}_"), F.lpad(F.col("_i").cast("string"), 3, "0"))
    copied = F.col("source") if kind == "redundant_semantic_indicator" else F.lit(None).cast("string")
    return rows.union(chosen.select(name, "target", "group")), chosen.select(name.alias("node_id"), copied.alias("source"))


def add_series(series: DataFrame, added: dict[str, str | None], master: int) -> DataFrame:
    """series with copies of nodes, or standard normal noise, under new names."""
    out = series.select("seed", "time", "node_id", "value")
    every = out.select("seed", "time").distinct()
    for name, source in added.items():
        if source is not None:
            more = series.filter(F.col("node_id") == source).select("seed", "time", F.lit(name).alias("node_id"), "value")
        else:
            # two hashed uniforms make a normal number; a function of place, not of partition
            u = [(F.pmod(F.xxhash64("seed", "time", F.lit(f"{master}:{name}:{i}")), F.lit(1 << 30)) + 0.5) / float(1 << 30) for i in (0, 1)]
            normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
            more = every.select("seed", "time", F.lit(name).alias("node_id"), normal.alias("value"))
        out = out.unionByName(more)
    return out


def extra_series(rows: DataFrame, more: list[tuple[int, str, str | None]], master: int) -> DataFrame:
    """cell, seed, time, node_id, value of series to add to rows (of the same columns): (cell, name, copied node or None for noise)."""
    wanted = rows.sparkSession.createDataFrame(more, "cell int, _name string, _source string")
    copies = rows.join(wanted, (rows["node_id"] == wanted["_source"]) & (rows["cell"] == wanted["cell"])).select(
        rows["cell"], "seed", "time", F.col("_name").alias("node_id"), "value"
    )
    # two hashed uniforms make a normal number; a function of place, not of partition
    u = [(F.pmod(F.xxhash64("seed", "time", "cell", "_name", F.lit(f"{master}:{i}")), F.lit(1 << 30)) + 0.5) / float(1 << 30) for i in (0, 1)]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
    places = rows.select("cell", "seed", "time").distinct()
    noise = places.join(wanted.filter("_source IS NULL"), "cell").select("cell", "seed", "time", F.col("_name").alias("node_id"), normal.alias("value"))
    return copies.unionByName(noise)


def sample(df: DataFrame, key: str, kind: str, n: int, master: int) -> DataFrame:
    """kind, place and df's row of each key drawn: without or with replacement, or a permutation of all (n of them). Keys are few."""
    keys = sorted(r[key] for r in df.select(key).distinct().collect())
    rng = np.random.default_rng(stable_seed(master, kind))
    places = {"without": lambda: rng.choice(len(keys), n, replace=False), "with": lambda: rng.integers(0, len(keys), n), "permutation": lambda: rng.permutation(len(keys))}[kind]()
    rows = [(kind, i, keys[p]) for i, p in enumerate(places)]
    drawn = df.sparkSession.createDataFrame(rows, f"kind string, place int, {key} {df.schema[key].dataType.simpleString()}")
    return drawn.join(df, key).select("kind", "place", *df.columns)
