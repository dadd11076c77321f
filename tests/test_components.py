"""Components of blocks and tiles against one union-find over everything; entropies from merged sums; unequal doses."""

from __future__ import annotations

import random

import numpy as np
import pytest

from driftline.operators import network, secondary
from driftline.operators.components import least_reachable, stars


def plain_roots(links):
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("block", [7, 40, 1 << 20])
def test_stars_equal_union_find(spark, block):
    r, rows = random.Random(block), []
    for run in range(4):
        rows += [(run, r.randrange(200), r.randrange(200)) for _ in range(r.choice([3, 60, 150]))]
        rows += [(run, 300 + i, 301 + i) for i in range(30)]  # a path
    got = {(x["run"], x["node"]): x["root"] for x in stars(spark.createDataFrame(rows + rows[:5], "run int, a long, b long"), ["run"], block).collect()}
    want = {}
    for run in range(4):
        want |= {(run, x): y for x, y in plain_roots([p[1:] for p in rows if p[0] == run]).items() if x != y}
    assert got == want


def test_no_links(spark):
    assert stars(spark.createDataFrame([(1, 2, 2)], "run int, a long, b long"), ["run"]).count() == 0


def test_graphs_in_blocks_equal_whole_graphs(spark):
    r = random.Random(0)
    edges = spark.createDataFrame([(k, t, r.randrange(50), r.randrange(50)) for k in "xy" for t in (0, 1) for _ in range(35)], "k string, time int, u int, v int")
    nodes = spark.createDataFrame([("x", 50), ("y", 70)], "k string, node_count int")
    some, whole = (sorted(map(tuple, network.graph_components(edges, nodes, ["k"], block=b).collect())) for b in (6, None))
    assert some == whole and len(whole) == 4 and all(1 < c < 70 for _, _, c, _ in whole)


def plain_grid(g):
    h, w = g.shape
    links = [(y * w + x, y * w + x) for y in range(h) for x in range(w) if g[y, x] >= 0]
    for y in range(h):
        for x in range(w):
            for a, b in (((y + 1) % h, x), (y, (x + 1) % w)):
                if g[y, x] >= 0 and g[a, b] == g[y, x]:
                    links.append((y * w + x, a * w + b))
    sizes = np.unique(list(plain_roots(links).values()), return_counts=True)[1]
    return (float(len(sizes)), sizes.max() / sizes.sum()) if len(sizes) else (0.0, 0.0)


@pytest.mark.parametrize("tile", [2, 3, 5, 1024])
def test_grids_in_tiles_equal_whole_grids(spark, tile):
    r = np.random.default_rng(tile)
    rows, want = [], {}
    for run, (h, w) in enumerate([(7, 11), (1, 6), (6, 1), (9, 3), (4, 4)]):
        g = r.integers(-1, 2, (h, w)).astype(float) if run < 4 else np.full((h, w), -1.0)
        want[run] = plain_grid(g)
        rows += [(run, 0, y, x, None if g[y, x] < 0 and (y + x) % 2 else float(g[y, x])) for y in range(h) for x in range(w)]
    grid = spark.createDataFrame(rows, "run int, time int, grid_y int, grid_x int, value double")
    got = {x["run"]: (x["components"], x["largest"]) for x in network.grid_components(grid, ["run"], tile=tile).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_labels_fall_to_the_least():
    assert least_reachable(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_doses_with_other_times_are_an_error(spark):
    rows = [("p", d, s, t, float(d * s + t)) for d in (-1.0, 0.0, 1.0) for s in (1, 2) for t in range(4)] + [("p", 1.0, 9, 0, 1.0)]
    schema = "parameter string, dose double, seed int, time int, value double"
    fine = secondary.dose_effects(spark.createDataFrame(rows, schema), ["parameter"], 0.0, 1).collect()
    assert {(r["dose"], r["seed"]): r["effect"] for r in fine} == {(float(d), s): float(d * s) for d in (-1, 0, 1) for s in (1, 2)}
    for gone in (("p", 1.0, 2, 3), ("p", 0.0, 1, 2)):
        cut = spark.createDataFrame([r for r in rows if r[:4] != gone], schema)
        with pytest.raises(Exception, match="times differ from the base dose"):
            secondary.dose_effects(cut, ["parameter"], 0.0, 1).collect()


def test_repetitions_are_the_shifts_of_each(spark):
    r = random.Random(2)
    series = spark.createDataFrame([(s, t, n, r.random()) for s in (1, 2) for n in "abc" for t in range(20)], "seed int, time long, node_id string, value double")
    rows = secondary.shifted_repetitions(series, {"a", "b"}, 3, 9, 5, 2).collect()
    names = ("seed", "node_id", "time", "value")
    as_is = sorted(tuple(x[c] for c in names) for x in series.collect())
    for cell in (-1, 0, 1):
        want = as_is if cell < 0 else sorted(tuple(x[c] for c in names) for x in secondary.shifted_parents(series, {"a", "b"}, 3, 9, 5, cell).collect())
        assert sorted(tuple(x[c] for c in names) for x in rows if x["cell"] == cell) == want
