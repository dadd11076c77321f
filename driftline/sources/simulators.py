"""Row generators: agent models run by task, one row of the task table a run.

Steps follow one another in time, so a run is one task; runs are as parallel as the table is long.
Random numbers come of counters (seed, step, stream), so that runs of one seed meet the same chances
whatever their parameters.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def chance(seed: int, step: int, stream: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, step, stream]))


def task_matrix(parameters: dict[str, tuple[float, float, float]], seeds, doses: int = 4, disabled: bool = True) -> list[dict]:
    """Baseline, each parameter moved to 2 or 4 doses, and the disabled mechanism, for each seed.

    parameters: name -> (minus, base, plus).
    """
    from driftline.operators.secondary import dose_levels

    base = {k: v[1] for k, v in parameters.items()}
    out = [("baseline", "base", base)]
    for name, (minus, centre, plus) in parameters.items():
        levels = dose_levels(minus, centre, plus)
        for label in ("minus", "plus") if doses == 2 else ("minus", "mid_minus", "mid_plus", "plus"):
            out.append((f"{name}_{label}", label, base | {name: levels[label]}))
    if disabled:
        out.append(("mechanism_disabled", "base", base))
    return [
        {"condition": c, "dose_label": label, "seed": int(s), "mechanism": "disabled" if c == "mechanism_disabled" else "enabled", **p}
        for (c, label, p), s in itertools.product(out, seeds)
    ]


def neighbour_counts(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell of a torus, the occupied ones among its eight neighbours, and those of its own group."""
    total, same = np.zeros(grid.shape, int), np.zeros(grid.shape, int)
    for dy, dx in itertools.product((-1, 0, 1), repeat=2):
        if dy or dx:
            other = np.roll(grid, (dy, dx), (0, 1))
            total += other >= 0
            same += (other >= 0) & (other == grid)
    return total, same


def torus_distance(a, b, shape) -> int:
    """Steps between two cells, over the edges where shorter."""
    return int(sum(min(abs(int(p) - int(q)), n - abs(int(p) - int(q))) for p, q, n in zip(a, b, shape, strict=True)))


def district(y, x, height: int, width: int, rows: int, columns: int):
    """The number of the district of a cell, of a grid of rows by columns districts."""
    return np.minimum(y * rows // height, rows - 1) * columns + np.minimum(x * columns // width, columns - 1)


def segregation(seed: int, steps: int, side: int, agents: int, tolerance: float, move: float = 1.0) -> list[tuple]:
    """Agents of two groups who leave where too few neighbours are of their own.

    Rows (time, agent, pos_y, pos_x, group, similarity, neighbours, unhappy, moved, move_distance).
    """
    rng = chance(seed, 0, 1)
    cells = rng.permutation(side * side)[:agents]
    group = np.arange(agents) % 2
    grid = np.full(side * side, -1)
    grid[cells] = group
    moved, far, rows = np.zeros(agents, bool), np.zeros(agents, int), []
    for t in range(steps):
        total, same = neighbour_counts(grid.reshape(side, side))
        n, k = total.ravel()[cells], same.ravel()[cells]
        similar = np.where(n > 0, k / np.maximum(n, 1), 1.0)
        unhappy = similar < tolerance
        rows += [(t, i, int(cells[i] // side), int(cells[i] % side), int(group[i]), float(similar[i]), int(n[i]), bool(unhappy[i]), bool(moved[i]), int(far[i])) for i in range(agents)]
        moved, far = np.zeros(agents, bool), np.zeros(agents, int)
        order = chance(seed, t, 10).permutation(np.flatnonzero(unhappy))
        tries = chance(seed, t, 11).random(agents)
        for i in order:
            if tries[i] >= move:
                continue
            free = np.flatnonzero(grid < 0)
            to = free[chance(seed, t, 1000 + int(i)).integers(len(free))]
            far[i] = torus_distance(divmod(cells[i], side), divmod(to, side), (side, side))
            grid[to], grid[cells[i]], cells[i], moved[i] = group[i], -1, to, True
    return rows


def ring_lattice(nodes: int, degree: int, rewiring: float, rng: np.random.Generator) -> set[tuple[int, int]]:
    """Undirected edges of a ring whose ends are moved with a chance; their number stays, and no loop or repeat arises."""
    edges = {tuple(sorted((i, (i + k) % nodes))) for i in range(nodes) for k in range(1, degree // 2 + 1)}
    for e in sorted(edges):
        if rng.random() < rewiring:
            u = e[0]
            free = [w for w in range(nodes) if w != u and tuple(sorted((u, w))) not in edges]
            if free:
                edges.remove(e)
                edges.add(tuple(sorted((u, free[rng.integers(len(free))]))))
    return edges


def opinions(seed: int, steps: int, agents: int, degree: int, bound: float, rate: float, rewiring: float = 0.1) -> tuple[list[tuple], list[tuple]]:
    """Agents who come nearer to neighbours whose opinion is near, and leave others.

    Rows (time, agent, opinion, partner, distance, accepted, shift) and (time, edge, u, v).
    """
    x = chance(seed, 0, 40).uniform(-1, 1, agents)
    edges = ring_lattice(agents, degree, rewiring, chance(seed, 0, 41))
    rows, links = [], []
    for t in range(steps):
        near: dict[int, list[int]] = {i: [] for i in range(agents)}
        for u, v in sorted(edges):
            near[u].append(v)
            near[v].append(u)
        links += [(t, i, u, v) for i, (u, v) in enumerate(sorted(edges))]
        pick, leave = chance(seed, t, 42).random(agents), chance(seed, t, 43).random(agents)
        partner = np.array([near[i][int(pick[i] * len(near[i]))] if near[i] else i for i in range(agents)])
        gap = np.abs(x[partner] - x)
        accepted = gap <= bound
        shift = np.where(accepted, rate * (x[partner] - x), 0.0)
        rows += [(t, i, float(x[i]), int(partner[i]), float(gap[i]), bool(accepted[i]), float(shift[i])) for i in range(agents)]
        x = np.clip(x + shift, -1, 1)
        for i in np.flatnonzero(~accepted & (leave < rewiring)):
            old = tuple(sorted((int(i), int(partner[i]))))
            degree_of = sum(old[1] in e for e in edges), sum(old[0] in e for e in edges)
            free = [w for w in range(agents) if w != i and tuple(sorted((int(i), w))) not in edges]
            if old in edges and min(degree_of) > 1 and free:
                edges.remove(old)
                rank = chance(seed, t, 4000 + int(i)).random(len(free)) * (0.1 + np.abs(x[free] - x[i]))
                edges.add(tuple(sorted((int(i), free[int(np.argmin(rank))]))))
    return rows, links


def toy(seed: int, steps: int, agents: int) -> list[tuple]:
    """Rows (time, agent, x, group, y): a driven mean, and agents about it."""
    rng, y, rows = chance(seed, 0, 1), 0.0, []
    for t in range(steps):
        x = rng.standard_normal(agents) + 0.5 * y
        rows += [(t, i, float(x[i]), i % 3, float(y)) for i in range(agents)]
        y = 0.6 * y + 0.4 * float(x.mean())
    return rows


MODELS = {
    "segregation": (segregation, "time int, agent int, pos_y int, pos_x int, group int, similarity double, neighbours int, unhappy boolean, moved boolean, move_distance int"),
    "opinions": (lambda **k: opinions(**k)[0], "time int, agent int, opinion double, partner int, distance double, accepted boolean, shift double"),
    "opinion_edges": (lambda **k: opinions(**k)[1], "time int, edge int, u int, v int"),
    "toy": (toy, "time int, agent int, x double, group int, y double"),
}
_KINDS = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def simulate(spark: SparkSession, model: str, tasks: list[dict], settings: dict) -> DataFrame:
    """condition, seed and the model's rows for each task; settings and the task's parameters go to the model."""
    make, schema = MODELS[model]
    wanted = {"segregation": {"tolerance", "move"}, "opinions": {"bound", "rate", "rewiring"}, "opinion_edges": {"bound", "rate", "rewiring"}, "toy": set()}[model]
    columns = [c.split() for c in schema.split(", ")]
    rows = [(t["condition"], t["seed"], {k: float(v) for k, v in t.items() if k in wanted}) for t in tasks]
    table = spark.createDataFrame(rows, "condition string, seed long, parameters map<string, double>").repartition(len(rows) or 1)

    def run(batches):
        for batch in batches:
            for task in batch.to_pylist():
                found = make(seed=task["seed"], **settings, **dict(task["parameters"]))
                values = list(zip(*found, strict=True)) or [[] for _ in columns]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task["condition"]] * n, pa.string()), pa.array([task["seed"]] * n, pa.int64()), *[pa.array(v, _KINDS[k]) for v, (_, k) in zip(values, columns, strict=True)]],
                    ["condition", "seed", *[c for c, _ in columns]],
                )

    return table.mapInArrow(run, f"condition string, seed long, {schema}")
