"""The expression language: JSON objects, typed by element type and named dimensions.

An operator is a row of OPERATORS: which of its keys are expressions, and a rule from their types
(and the other keys) to its own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


class ExpressionError(ValueError):
    """The expression is not in the language, or its types do not fit."""


@dataclass(frozen=True)
class TensorType:
    dtype: str  # bool, integer or numeric
    dims: tuple[str, ...] = ()

    @property
    def number(self) -> bool:
        return self.dtype in ("integer", "numeric")

    def without(self, axis: str, dtype: str = "numeric") -> TensorType:
        return TensorType(dtype, tuple(d for d in self.dims if d != axis))


#: Fixed sizes of axes that are columns, not rows.
FIXED_AXES = {"channel": 8, "coordinate": 2, "endpoint": 2}
EDGES = (("edge", "endpoint"), ("time", "edge", "endpoint"))
GRID = ("time", "grid_y", "grid_x")
NODES = ("time", "agent")


def need(holds: bool, message: str) -> None:
    if not holds:
        raise ExpressionError(message)


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _merged(a: TensorType, b: TensorType) -> tuple[str, ...]:
    need(not a.dims or not b.dims or a.dims == b.dims, f"dimensions {a.dims} and {b.dims} do not fit")
    return a.dims or b.dims


def _constant(node: dict) -> TensorType:
    v = node.get("value")
    need(isinstance(v, (bool, int, float)) and math.isfinite(v), "a constant is a finite number or a boolean")
    return TensorType("bool" if isinstance(v, bool) else "integer" if isinstance(v, int) else "numeric")


def _unary(node: dict, x: TensorType) -> TensorType:
    need(x.number, f"{node['op']} takes numbers")
    return x


def _binary(node: dict, a: TensorType, b: TensorType) -> TensorType:
    need(a.number and b.number, f"{node['op']} takes numbers")
    return TensorType("numeric", _merged(a, b))


def _comparison(node: dict, a: TensorType, b: TensorType) -> TensorType:
    return TensorType("bool", _merged(a, b))


def _reduced(node: dict, x: TensorType) -> TensorType:
    op, axis = node["op"], node.get("axis")
    need(axis in x.dims, f"axis {axis!r} is not among {x.dims}")
    if op == "entropy":
        need(x.dtype != "numeric", "entropy takes categories; use binned_entropy")
    elif op not in ("count", "fraction"):
        need(x.number, f"{op} takes numbers")
    if op == "quantile":
        q = node.get("q")
        need(isinstance(q, (int, float)) and 0 <= q <= 1, "q lies within [0, 1]")
    if op == "binned_entropy":
        need(_whole(node.get("bins")) and 2 <= node["bins"] <= 128, "bins is a whole number from 2 to 128")
    return x.without(axis)


def _correlation(node: dict, a: TensorType, b: TensorType) -> TensorType:
    need(a.number and b.number, "correlation takes numbers")
    need(a.dims == b.dims and node.get("axis") in a.dims, "correlation takes equal dimensions with its axis")
    return a.without(node["axis"])


def _clip(node: dict, x: TensorType) -> TensorType:
    low, high = node.get("minimum"), node.get("maximum")
    need(x.number, "clip takes numbers")
    need(all(isinstance(v, (int, float)) for v in (low, high)) and low <= high, "clip has bounds in order")
    return x


def _where(node: dict, condition: TensorType, x: TensorType) -> TensorType:
    need(condition.dtype == "bool", "where takes a boolean condition")
    _merged(condition, x)
    return x


def _temporal(node: dict, x: TensorType) -> TensorType:
    need(x.number and "time" in x.dims, f"{node['op']} takes numbers over time")
    if node["op"] != "time_difference":
        need(_whole(node.get("window")) and node["window"] >= 1, "window is a positive whole number")
    return x


def _select(node: dict, x: TensorType) -> TensorType:
    axis, index = node.get("axis"), node.get("index")
    need(axis in x.dims, f"axis {axis!r} is not among {x.dims}")
    need(_whole(index) and 0 <= index < FIXED_AXES.get(axis, index + 1), "index is out of its axis")
    return x.without(axis, x.dtype)


def _group_reduce(node: dict, values: TensorType, groups: TensorType) -> TensorType:
    axis, op = node.get("axis"), node.get("reducer")
    need(op in GROUP_REDUCERS, f"no group reducer {op!r}")
    need(groups.dtype == "integer", "groups are whole numbers")
    need(axis in values.dims and axis in groups.dims, "the axis is in values and groups")
    need(values.dims == groups.dims or (values.dims == (axis,) and groups.dims == ("time", axis)), "values and groups have equal dimensions")
    need(op in ("count", "fraction") or values.number and op != "entropy" or op == "entropy" and values.dtype != "numeric", f"{op} does not take {values.dtype}")
    return TensorType("numeric", (*groups.without(axis).dims, "group"))


def _grid(node: dict, x: TensorType) -> TensorType:
    need(x.dims == GRID, f"{node['op']} takes a grid over time")
    return TensorType("numeric", ("time",))


def _assortativity(node: dict, values: TensorType, edges: TensorType) -> TensorType:
    need(values.dims == NODES and edges.dims in EDGES, "network_assortativity takes values of nodes over time, and edges")
    return TensorType("numeric", ("time",))


def _density(node: dict, edges: TensorType, count: TensorType) -> TensorType:
    need(edges.dims in EDGES and not count.dims, "network_density takes edges and a scalar number of nodes")
    return TensorType("numeric", edges.dims[:-2])


def _neighbourhood(node: dict, values: TensorType, edges: TensorType) -> TensorType:
    op = node.get("reducer")
    need(op in NEIGHBOUR_REDUCERS, f"no neighbourhood reducer {op!r}")
    need(values.dims == NODES and edges.dims in EDGES, "network_neighborhood_reduce takes values of nodes over time, and edges")
    need(op in ("count", "fraction") or values.number, f"{op} takes numbers")
    return TensorType("numeric", NODES)


def _components(node: dict, edges: TensorType, count: TensorType) -> TensorType:
    need(edges.dims == EDGES[1], f"{node['op']} takes edges over time")
    need(not count.dims and count.number, f"{node['op']} takes a scalar number of nodes")
    return TensorType("numeric", ("time",))


GROUP_REDUCERS = ("mean", "sum", "count", "fraction", "variance", "std", "entropy")
NEIGHBOUR_REDUCERS = GROUP_REDUCERS[:-1]
AXIS_REDUCERS = ("mean", "sum", "count", "fraction", "variance", "std", "quantile")

Rule = Callable[..., TensorType]
#: operator -> (keys that are expressions, rule)
OPERATORS: dict[str, tuple[tuple[str, ...], Rule]] = {
    "constant": ((), _constant),
    **{op: (("input",), _unary) for op in ("abs", "negate", "sqrt", "log1p")},
    **{op: (("left", "right"), _binary) for op in ("add", "subtract", "multiply", "divide", "safe_ratio", "distance")},
    **{op: (("left", "right"), _comparison) for op in ("greater", "greater_equal", "less", "less_equal", "equal", "not_equal")},
    **{op: (("input",), _reduced) for op in (*AXIS_REDUCERS, "entropy", "binned_entropy")},
    "correlation": (("left", "right"), _correlation),
    "clip": (("input",), _clip),
    "where": (("condition", "input"), _where),
    **{op: (("input",), _temporal) for op in ("time_difference", "rolling_mean", "rolling_std")},
    "select": (("input",), _select),
    "group_reduce": (("values", "groups"), _group_reduce),
    **{op: (("input",), _grid) for op in ("connected_component_count", "largest_component_fraction", "spatial_neighbor_similarity")},
    "network_assortativity": (("values", "edges"), _assortativity),
    "network_density": (("edges", "node_count"), _density),
    "network_neighborhood_reduce": (("values", "edges"), _neighbourhood),
    **{op: (("edges", "node_count"), _components) for op in ("network_component_count", "network_largest_component_fraction")},
}
TEMPORAL = ("identity", "rolling_mean", "rolling_std", "difference", "cumulative_mean")


def children(node: dict) -> list[dict]:
    return [node[k] for k in OPERATORS.get(node.get("op"), ((), None))[0] if isinstance(node.get(k), dict)]


def walk(node: dict) -> Iterator[dict]:
    yield node
    for child in children(node):
        yield from walk(child)


def analyze(node: Any, fields: dict[str, TensorType]) -> TensorType:
    """The type of an expression over fields; ExpressionError if it has none."""
    need(isinstance(node, dict), "an expression is an object")
    op = node.get("op")
    if op == "field":
        need(node.get("name") in fields, f"unknown field {node.get('name')!r}")
        return fields[node["name"]]
    need(op in OPERATORS, f"no operator {op!r}")
    keys, rule = OPERATORS[op]
    return rule(node, *[analyze(node.get(k), fields) for k in keys])


def analyze_indicator(node: Any, fields: dict[str, TensorType]) -> TensorType:
    """The type of an indicator, which is a number over time."""
    found = analyze(node, fields)
    need(found.number and found.dims == ("time",), f"an indicator is a number over time, not {found}")
    return found


def check_temporal(spec: dict) -> None:
    """A temporal aggregation has an operator, and a window exactly where that needs one."""
    op = spec.get("op")
    need(op in TEMPORAL, f"no temporal aggregation {op!r}")
    rolling = op in ("rolling_mean", "rolling_std")
    need(set(spec) == ({"op", "window"} if rolling else {"op"}), f"{op} has other keys than it takes")
    need(not rolling or _whole(spec["window"]) and spec["window"] >= 1, "window is a positive whole number")


def canonical(node: Any) -> str:
    """One text for equal expressions."""
    return json.dumps(node, sort_keys=True, separators=(",", ":"))


def fields_of(node: dict) -> list[str]:
    return sorted({n["name"] for n in walk(node) if n.get("op") == "field"})


def operators_of(node: dict) -> list[str]:
    return sorted({n["op"] for n in walk(node)})


def height(node: dict) -> int:
    return 1 + max((height(c) for c in children(node)), default=0)


def describe() -> dict[str, dict]:
    """The grammar: expression keys of each operator, and the closed lists."""
    return {op: {"expressions": list(keys)} for op, (keys, _) in sorted(OPERATORS.items())} | {"field": {"expressions": []}}
