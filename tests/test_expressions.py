"""The expression language on small arrays, with values worked out by hand or by NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from driftline.operators.tensor import Dataset
from driftline.plans import grammar as g
from driftline.plans.planner import evaluate

AT = ("time", "agent")


def f(name):
    return {"op": "field", "name": name}


def agents(op, x, **k):
    return {"op": op, "input": x, "axis": "agent", **k}


def dataset(spark, **fields):
    """Arrays [time, agent] as one table; NaN stays to be cleaned by the reader."""
    names = list(fields)
    arrays = [np.asarray(fields[n]) for n in names]
    rows = [
        (0, t, a, *[None if isinstance(v, float) and np.isnan(v) else v for v in (x[t, a].item() for x in arrays)])
        for t in range(arrays[0].shape[0])
        for a in range(arrays[0].shape[1])
    ]
    kinds = {"f": ("double", "numeric"), "i": ("long", "integer"), "b": ("boolean", "bool")}
    kind = [kinds[x.dtype.kind] for x in arrays]
    df = spark.createDataFrame(rows, "run int, time int, agent int, " + ", ".join(f"{n} {k[0]}" for n, k in zip(names, kind, strict=True)))
    return Dataset(("run",), {AT: df}, {n: g.TensorType(k[1], AT) for n, k in zip(names, kind, strict=True)})


def run(data, nodes, temporal=None):
    rows = evaluate(data, nodes, temporal).collect()
    out = {n: {} for n in nodes}
    for r in rows:
        out[r["node_id"]][r["time"]] = r["value"]
    return {n: [v[t] for t in sorted(v)] for n, v in out.items()}


def test_mean_over_agents(spark):
    assert run(dataset(spark, x=np.arange(12.0).reshape(4, 3)), {"m": agents("mean", f("x"))}) == {"m": [1, 4, 7, 10]}


def test_missing_values(spark):
    x = np.array([[1.0, np.nan, 3.0], [np.nan] * 3])
    got = run(dataset(spark, x=x), {op: agents(op, f("x")) for op in ("mean", "sum", "count", "variance", "fraction")})
    assert got == {"mean": [2, None], "sum": [4, 0], "count": [2, 0], "variance": [1, None], "fraction": [2, None]}


def test_comparisons_with_missing_are_false_but_not_equal(spark):
    x = np.array([[np.nan, 2.0]])
    one = {"op": "constant", "value": 1}
    got = run(dataset(spark, x=x), {op: agents("count", {"op": op, "left": f("x"), "right": one}) for op in ("greater", "equal", "not_equal")})
    assert got == {"greater": [1], "equal": [0], "not_equal": [2]}


def test_division_by_zero_is_zero(spark):
    d = dataset(spark, x=np.array([[4.0, 9.0]]), y=np.array([[0.0, 3.0]]))
    assert run(d, {"r": agents("sum", {"op": "safe_ratio", "left": f("x"), "right": f("y")})}) == {"r": [3]}


def test_scalar_guards(spark):
    d = dataset(spark, x=np.array([[-4.0, 9.0, np.nan]]))
    got = run(d, {"sqrt": agents("sum", {"op": "sqrt", "input": f("x")}), "log1p": agents("sum", {"op": "log1p", "input": f("x")}), "clip": agents("sum", {"op": "clip", "input": f("x"), "minimum": -1, "maximum": 5})})
    assert got["sqrt"] == [3] and got["clip"] == [4]
    assert got["log1p"][0] == pytest.approx(np.log1p(-0.999999) + np.log1p(9))


def test_entropies(spark):
    d = dataset(spark, k=np.array([[1, 1, 2, 3], [5, 5, 5, 5]]), x=np.array([[0.0, 0.1, 0.9, 1.0], [2.0] * 4]))
    got = run(d, {"e": agents("entropy", f("k")), "b": agents("binned_entropy", f("x"), bins=2)})
    p = np.array([0.5, 0.25, 0.25])
    assert got["e"] == pytest.approx([-(p * np.log(p + 1e-15)).sum(), 0], abs=1e-12)
    assert got["b"] == pytest.approx([np.log(2), 0])


def test_correlation_centres_each_side_and_is_zero_without_variation(spark):
    x = np.array([[1.0, 2.0, 4.0], [1.0, 1.0, 1.0]])
    y = np.array([[2.0, 1.0, 7.0], [1.0, 2.0, 3.0]])
    got = run(dataset(spark, x=x, y=y), {"r": {"op": "correlation", "left": f("x"), "right": f("y"), "axis": "agent"}})
    assert got["r"] == pytest.approx([np.corrcoef(x[0], y[0])[0, 1], 0])


def test_group_reduce_makes_absent_groups(spark):
    d = dataset(spark, x=np.array([[1.0, 2.0, 5.0], [1.0, 2.0, 6.0]]), k=np.array([[0, 0, 2], [0, 0, 0]]))
    node = lambda r: {"op": "group_reduce", "values": f("x"), "groups": f("k"), "axis": "agent", "reducer": r}
    got = run(d, {"n": {"op": "sum", "input": node("count"), "axis": "group"}, "groups": {"op": "count", "input": node("count"), "axis": "group"}, "means": {"op": "count", "input": node("mean"), "axis": "group"}})
    assert got == {"n": [3, 3], "groups": [3, 3], "means": [2, 1]}


def test_time_difference_starts_at_zero(spark):
    d = dataset(spark, x=np.array([[1.0, 1.0], [4.0, 2.0], [4.0, 4.0]]))
    assert run(d, {"d": {"op": "time_difference", "input": agents("mean", f("x"))}}) == {"d": [0, 2, 1]}
    assert run(d, {"d": agents("mean", {"op": "time_difference", "input": f("x")})}) == {"d": [0, 2, 1]}


def test_cumulative_mean_stays_missing(spark):
    d = dataset(spark, x=np.array([[1.0], [3.0], [np.nan], [5.0]]))
    assert run(d, {"c": agents("mean", f("x"))}, {"c": {"op": "cumulative_mean"}}) == {"c": [1, 2, None, None]}


def edges(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "run int, time int, link_0 int, link_1 int")


def network(spark, values, rows):
    d = dataset(spark, x=np.asarray(values, float))
    d.tables[("time", "edge")] = edges(spark, rows)
    d.fields["link"] = g.TensorType("integer", ("time", "edge", "endpoint"))
    return d


PATHS = [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 0, 2), (1, 0, 3)]


def test_neighbourhood_and_components(spark):
    d = network(spark, [[0, 1, 2, 3]] * 2, PATHS)
    n = {"op": "constant", "value": 4}
    near = {"op": "network_neighborhood_reduce", "values": f("x"), "edges": f("link"), "reducer": "mean"}
    got = run(
        d,
        {
            "first": agents("sum", near),
            "count": {"op": "network_component_count", "edges": f("link"), "node_count": n},
            "largest": {"op": "network_largest_component_fraction", "edges": f("link"), "node_count": n},
            "density": {"op": "network_density", "edges": f("link"), "node_count": n},
        },
    )
    assert got == {"first": [6, 2], "count": [1, 1], "largest": [1, 1], "density": [0.5, 0.5]}


def test_assortativity_is_zero_for_constants_and_ignores_labels(spark):
    node = {"op": "network_assortativity", "values": f("x"), "edges": f("link")}
    rows = [(0, 0, 1), (0, 0, 3), (0, 1, 2)]
    x = np.array([[0.1, 0.5, -0.4, 0.9]])
    order = [2, 0, 3, 1]
    moved = np.empty_like(x)
    moved[:, order] = x
    a = run(network(spark, x, rows), {"a": node})["a"]
    b = run(network(spark, moved, [(t, order[u], order[v]) for t, u, v in rows]), {"a": node})["a"]
    assert a == pytest.approx(b)
    assert run(network(spark, np.ones((1, 4)), rows), {"a": node})["a"] == [0]


def test_faulty_edges_are_named(spark):
    from driftline.operators.network import require_sound_edges

    e = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "time int, u int, v int")
    with pytest.raises(ValueError, match="duplicate undirected edge"):
        require_sound_edges(e, ["time"])


def test_grid_operators(spark):
    cells = np.array([[1, 1, -1], [0, 0, -1], [-1, -1, -1]])
    df = spark.createDataFrame([(0, 0, y, x, int(cells[y, x])) for y in range(3) for x in range(3)], "run int, time int, grid_y int, grid_x int, s int")
    d = Dataset(("run",), {g.GRID: df}, {"s": g.TensorType("integer", g.GRID)})
    got = run(d, {"n": {"op": "connected_component_count", "input": f("s")}, "big": {"op": "largest_component_fraction", "input": f("s")}, "same": {"op": "spatial_neighbor_similarity", "input": f("s")}})
    assert got == {"n": [2], "big": [0.5], "same": [0.5]}


@pytest.mark.parametrize(
    "node",
    [
        f("nope"),
        {"op": "exec", "input": f("x")},
        agents("entropy", f("x")),
        {"op": "rolling_mean", "input": f("x"), "window": 0},
        {"op": "add", "left": f("x"), "right": agents("mean", f("x"))},
        agents("quantile", f("x"), q=1.5),
        {"op": "select", "input": f("x"), "axis": "endpoint", "index": 0},
        agents("binned_entropy", f("x"), bins=True),
        {"op": "constant", "value": float("nan")},
        f("x"),
    ],
)
def test_rejects(node):
    with pytest.raises(g.ExpressionError):
        g.analyze_indicator(node, {"x": g.TensorType("numeric", AT)})


def test_temporal_specification_is_strict():
    with pytest.raises(g.ExpressionError):
        g.check_temporal({"op": "identity", "window": 3})
    g.check_temporal({"op": "rolling_std", "window": 3})


def test_reducers_of_one_table_share_a_shuffle(spark):
    d = dataset(spark, x=np.arange(12.0).reshape(4, 3))
    plan = evaluate(d, {op: agents(op, f("x")) for op in ("mean", "sum", "std", "count")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lineage_rules():
    from driftline.plans import lineage as l

    near = {"op": "network_neighborhood_reduce", "values": f("x"), "edges": f("e"), "reducer": "mean"}
    assert not l.is_meso(agents("mean", near)) and l.is_meso(agents("std", near))
    assert l.is_meso(agents("mean", {"op": "distance", "left": f("x"), "right": near}))
    assert not l.is_meso({"op": "network_density", "edges": f("e"), "node_count": f("n")})
    wrapped = {"op": "multiply", "left": {"op": "constant", "value": 2}, "right": {"op": "negate", "input": agents("mean", f("x"))}}
    assert l.core(wrapped) == agents("mean", f("x"))
    roles = {"unhappy": ("unhappy", "binary_state"), "unhappy_count": ("unhappy", "aggregate_count"), "agent_count": ("population_size", "primitive")}
    rate = {"op": "divide", "left": f("unhappy_count"), "right": f("agent_count")}
    assert l.families(agents("fraction", f("unhappy")), roles) == l.families(rate, roles)
