"""Whether a set of indicators, and a set of paths over it, may be frozen: rules over small JSON, no data.

A fault is (where, what); a set is sound without faults.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from driftline.plans import grammar, lineage

Fault = tuple[str, str]
SCALES = ("micro", "meso", "macro")
# What an indicator of a scale may be about, and the levels of fields that are elementary.
SCOPES = {
    "micro": {"individual", "interaction", "elementary_event", "local_process"},
    "meso": {"neighborhood", "district", "community", "cluster", "local_domain"},
    "macro": {"whole_system"},
}
ELEMENTARY = {"agent", "interaction", "cell", "edge"}


def _direct(item: dict) -> set[str]:
    return {a["parameter"] for a in item.get("parameter_associations", []) if a.get("relationship") == "direct"}


def _own_faults(item: dict, fields: dict[str, grammar.TensorType], levels: dict[str, str], parameters: set[str]) -> Iterator[str]:
    node, scale = item["computation"], item["scale"]
    try:
        grammar.analyze_indicator(node, fields)
        grammar.check_temporal(item["temporal_aggregation"])
    except grammar.ExpressionError as e:
        yield str(e)
        return
    used = grammar.fields_of(node)
    if sorted(item["source_fields"]) != used:
        yield f"source fields are {used}"
    if item["entity_scope"] not in SCOPES[scale]:
        yield f"no scope of {scale}: {item['entity_scope']}"
    if scale == "micro" and not any(levels.get(f) in ELEMENTARY for f in used):
        yield "micro without an elementary field"
    whole = lineage.GLOBAL_STRUCTURE & set(grammar.operators_of(node))
    if scale != "macro" and whole:
        yield f"{scale} measures the whole system: {sorted(whole)}"
    if scale == "meso" and not lineage.is_meso(node):
        yield "meso compares no intermediate units"
    for p in sorted({a["parameter"] for a in item.get("parameter_associations", [])} - parameters):
        yield f"unknown parameter {p}"


def indicator_faults(
    value: dict, scenario: str, fields: dict[str, grammar.TensorType], levels: dict[str, str], parameters: set[str], budget: dict[str, int], all_associated: bool = True
) -> list[Fault]:
    """levels: field -> entity level; budget: scale -> number of indicators."""
    items, out = value["indicators"], []
    if value["scenario"] != scenario:
        out.append(("set", f"scenario is not {scenario}"))
    counts = Counter(i["scale"] for i in items)
    out += [("set", f"{counts[s]} of {n} {s} indicators") for s, n in budget.items() if counts[s] != n]
    out += [(i["id"], fault) for i in items for fault in _own_faults(i, fields, levels, parameters)]
    out += [("set", f"repeated indicator {k}") for k, n in Counter(i["id"] for i in items).items() if n > 1]
    if len({grammar.canonical(i["computation"]) for i in items}) < len(items):
        out.append(("set", "equal computations"))
    moved = set().union(*[_direct(i) for i in items if i["scale"] == "micro"])
    if all_associated and parameters - moved:
        out.append(("set", f"parameters without a direct micro indicator: {sorted(parameters - moved)}"))
    boundary = value.get("interpretation_boundary", "").lower()
    if not all(word in boundary for word in ("temporal", "intervention")):
        out.append(("set", "the boundary does not defer temporal and intervention evidence"))
    return out


def _path_faults(path: dict, by: dict[str, dict], parameters: set[str], roles: dict[str, tuple[str, str]]) -> Iterator[str]:
    nodes = [path[f"{s}_indicator"] for s in SCALES]
    if unknown := sorted(set(nodes) - set(by)):
        yield f"unknown indicators {unknown}"
        return
    items = [by[n] for n in nodes]
    if tuple(i["scale"] for i in items) != SCALES:
        yield "nodes are not micro, meso and macro"
    if path["parameter"] not in parameters:
        yield "unknown parameter"
    elif path["parameter"] not in _direct(items[0]):
        yield "the micro indicator is not moved directly by the parameter"
    exprs = [i["computation"] for i in items]
    if any(lineage.trivial_step(a, b) for a, b in zip(exprs, exprs[1:], strict=False)):
        yield "trivial step between scales"
    if lineage.trivial_path(exprs[0], exprs[2], roles):
        yield "micro and macro are one measure"


def path_faults(
    paths: list[dict],
    predictions: list[str],
    frozen: dict,
    parameters: set[str],
    roles: dict[str, tuple[str, str]],
    total: tuple[int, int],
    per_parameter: int = 4,
    per_macro: int = 2,
    predicted: int = 6,
) -> list[Fault]:
    """predictions: path identifiers predicted ahead; total: fewest and most paths; frozen: the sound set of indicators."""
    by, out = {i["id"]: i for i in frozen["indicators"]}, []
    if not total[0] <= len(paths) <= total[1]:
        out.append(("paths", f"{len(paths)} paths, not {total[0]} to {total[1]}"))
    out += [(p["path_id"], fault) for p in paths for fault in _path_faults(p, by, parameters, roles)]
    known = [p for p in paths if all(p[f"{s}_indicator"] in by for s in SCALES)]
    for what, names, column, least in (
        ("parameter", parameters, "parameter", per_parameter),
        ("macro indicator", {i for i, item in by.items() if item["scale"] == "macro"}, "macro_indicator", per_macro),
    ):
        counts = Counter(p[column] for p in known)
        out += [("paths", f"{what} {n} has {counts[n]} paths, not {least}") for n in sorted(names) if counts[n] < least]
    if len(predictions) != predicted:
        out.append(("predictions", f"{len(predictions)} of {predicted}"))
    parameter_of = {p["path_id"]: p["parameter"] for p in paths}
    if {parameter_of[i] for i in predictions if i in parameter_of} != parameters:
        out.append(("predictions", "not every parameter is predicted"))
    return out
