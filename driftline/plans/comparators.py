"""Representations given in advance: 28 indicators a scenario, and the controlled truth behind simulated runs.

Both are tables of expressions. The comparator is evaluated beside learned representations in ablations;
the truth (processes, relations, contexts) drives the hidden channels of operators/channels.py.
"""

from __future__ import annotations

from itertools import chain

from driftline.plans.grammar import fields_of


def field(name: str) -> dict:
    return {"op": "field", "name": name}


def _x(x) -> dict:
    return field(x) if isinstance(x, str) else {"op": "constant", "value": x} if isinstance(x, int | float) else x


def agents(op: str, x, **more) -> dict:
    return {"op": op, "input": _x(x), "axis": "agent", **more}


def two(op: str, a, b) -> dict:
    return {"op": op, "left": _x(a), "right": _x(b)}


def one(op: str, x, **more) -> dict:
    return {"op": op, "input": _x(x), **more}


def share(op: str, x, bound) -> dict:
    """The share of agents for whom the comparison holds."""
    return agents("fraction", two(op, x, bound))


def districts(x, reducer: str) -> dict:
    return {"op": "group_reduce", "values": _x(x), "groups": field("district_id"), "axis": "agent", "reducer": reducer}


def between(x, reducer: str, op: str = "variance") -> dict:
    return {"op": op, "input": districts(x, reducer), "axis": "group"}


def near(x, reducer: str) -> dict:
    return {"op": "network_neighborhood_reduce", "values": _x(x), "edges": field("network_edges"), "reducer": reducer}


def quartiles(x, axis: str) -> dict:
    high, low = ({"op": "quantile", "input": x, "axis": axis, "q": q} for q in (0.75, 0.25))
    return two("subtract", high, low)


def unit(x) -> dict:
    """x within [0, 1]."""
    return one("clip", x, minimum=0.0, maximum=1.0)


_OPINION, _EXTREME = field("state_opinion"), two("greater_equal", one("abs", "state_opinion"), 0.75)

# The indicators of each scenario and scale in their order, as (entity scope, expression).
INDICATORS = {
    "schelling": {
        "micro": [
            ("elementary_event", agents("fraction", "unhappy")),
            ("elementary_event", agents("fraction", "moved")),
            ("local_process", agents("fraction", "boundary_agent")),
            ("local_process", agents("mean", "local_similarity")),
            ("local_process", agents("std", "local_similarity")),
            ("local_process", agents("quantile", "local_similarity", q=0.25)),
            ("local_process", agents("quantile", "local_similarity", q=0.75)),
            ("local_process", agents("mean", "neighbour_count")),
            ("local_process", share("less_equal", "neighbour_count", 2)),
            ("elementary_event", agents("mean", "move_distance")),
            ("elementary_event", agents("quantile", "move_distance", q=0.9)),
            ("elementary_event", agents("mean", "destination_similarity")),
            ("elementary_event", agents("std", "destination_similarity")),
            ("elementary_event", share("greater", "move_distance", 0.25)),
            ("elementary_event", share("greater_equal", "destination_similarity", 0.75)),
            ("local_process", share("equal", "neighbour_count", 0)),
        ],
        "meso": [
            ("district", between("agent_group", "mean")),
            ("district", between("agent_group", "entropy", "mean")),
            ("district", between("unhappy", "fraction")),
            ("district", between("moved", "fraction")),
            ("district", quartiles(districts("moved", "fraction"), "group")),
            ("district", between("boundary_agent", "fraction")),
            ("district", between("destination_similarity", "mean")),
            ("district", between("move_distance", "mean")),
        ],
        "macro": [
            ("whole_system", one("largest_component_fraction", "state_grid")),
            ("whole_system", one("rolling_mean", agents("fraction", "moved"), window=3)),
            ("whole_system", one("connected_component_count", "state_grid")),
            ("whole_system", one("spatial_neighbor_similarity", "state_grid")),
        ],
    },
    "deffuant": {
        "micro": [
            ("interaction", agents("fraction", "interaction_accepted")),
            ("interaction", agents("fraction", "interaction_backfire")),
            ("interaction", agents("fraction", "interaction_rejected")),
            ("elementary_event", agents("fraction", "edge_rewired")),
            ("interaction", agents("mean", "interaction_distance")),
            ("interaction", agents("quantile", "interaction_distance", q=0.9)),
            ("elementary_event", agents("mean", one("abs", "agent_shift"))),
            ("elementary_event", agents("std", "agent_shift")),
            ("elementary_event", agents("fraction", "sign_flip")),
            ("individual", agents("fraction", _EXTREME)),
            ("individual", agents("mean", one("abs", "state_opinion"))),
            ("individual", share("greater", "state_opinion", 0.0)),
            ("elementary_event", share("greater", one("abs", "agent_shift"), 0.05)),
            ("interaction", agents("mean", {"op": "where", "condition": field("interaction_accepted"), "input": field("interaction_distance")})),
            ("interaction", agents("mean", {"op": "where", "condition": field("interaction_backfire"), "input": field("interaction_distance")})),
            ("interaction", agents("quantile", "interaction_distance", q=0.25)),
        ],
        "meso": [
            ("neighborhood", agents("mean", two("distance", _OPINION, near(_OPINION, "mean")))),
            ("neighborhood", agents("variance", near(_OPINION, "mean"))),
            ("neighborhood", agents("mean", near(_OPINION, "std"))),
            ("neighborhood", quartiles(near(_OPINION, "mean"), "agent")),
            ("neighborhood", agents("variance", near(_EXTREME, "fraction"))),
            ("neighborhood", agents("std", near(two("greater", _OPINION, 0.0), "fraction"))),
            ("neighborhood", agents("variance", near("interaction_accepted", "fraction"))),
            ("neighborhood", agents("variance", near("edge_rewired", "fraction"))),
        ],
        "macro": [
            ("whole_system", agents("std", "state_opinion")),
            ("whole_system", agents("mean", "state_opinion")),
            ("whole_system", {"op": "network_assortativity", "values": _OPINION, "edges": field("network_edges")}),
            ("whole_system", agents("binned_entropy", "state_opinion", bins=10)),
        ],
    },
}
#: Prefix of identifiers, and the parameter that moves a micro indicator directly.
PREFIX = {"schelling": "sfix", "deffuant": "dfix"}
DIRECT = {
    "schelling": {0: "tolerance", 1: "move_probability", 11: "destination_preference"},
    "deffuant": {0: "confidence_bound", 1: "backfire_threshold", 6: "assimilation_strength"},
}


def indicators(scenario: str) -> dict[str, dict]:
    """identifier -> expression."""
    return {f"{PREFIX[scenario]}_{scale}_{i:02d}": node for scale, rows in INDICATORS[scenario].items() for i, (_, node) in enumerate(rows)}


def candidate_edges(scenario: str) -> list[tuple[str, str]]:
    """Each macro indicator has four micro and two meso ones: micro to meso in halves, the first micro to both, meso to macro."""
    name = lambda scale, i: f"{PREFIX[scenario]}_{scale}_{i:02d}"
    out = []
    for k in range(len(INDICATORS[scenario]["macro"])):
        meso = [name("meso", 2 * k), name("meso", 2 * k + 1)]
        out += [(name("micro", 4 * k + i), meso[i // 2]) for i in range(4)]
        out += [(m, name("macro", k)) for m in meso]
        out.append((name("micro", 4 * k), meso[1]))
    return out


def representation(scenario: str) -> dict:
    """The whole comparator, as the validators take it."""
    found = []
    for scale, rows in INDICATORS[scenario].items():
        for i, (scope, node) in enumerate(rows):
            moved = DIRECT[scenario].get(i) if scale == "micro" else None
            found.append(
                {
                    "id": f"{PREFIX[scenario]}_{scale}_{i:02d}",
                    "scale": scale,
                    "entity_scope": scope,
                    "source_fields": fields_of(node),
                    "computation": node,
                    "temporal_aggregation": {"op": "identity"},
                    "parameter_associations": [{"parameter": moved, "relationship": "direct"}] if moved else [],
                }
            )
    edges = [{"source": s, "target": t, "expected_direction": "unknown"} for s, t in candidate_edges(scenario)]
    return {"scenario": scenario, "indicators": found, "candidate_edges": edges, "interpretation_boundary": "Read with temporal and intervention evidence only."}


# ---- controlled truth --------------------------------------------------------------------------


def _four(x) -> dict:
    return unit(two("multiply", x, 4.0))


_AGREED = unit(two("subtract", 1.0, agents("std", "state_opinion")))
# For each of four chains its mechanism, micro process, lag and sign to meso, lag to macro,
# and the structural contexts of meso and macro.
CHAINS = {
    "schelling": [
        ("satisfaction", "s_micro_satisfaction", agents("fraction", "unhappy"), 1, 1, 2, _four(between("unhappy", "fraction")), agents("mean", "local_similarity")),
        ("relocation", "s_micro_relocation", agents("fraction", "moved"), 2, 1, 3, _four(between("moved", "fraction")), agents("fraction", "moved")),
        ("interface", "s_micro_boundary", agents("fraction", "boundary_agent"), 3, 1, 4, _four(between("boundary_agent", "fraction")), unit(two("subtract", 1.0, one("spatial_neighbor_similarity", "state_grid")))),
        ("homophilic_destination_selection", "s_micro_destination_similarity", agents("mean", "destination_similarity"), 5, -1, 5, _four(between("destination_similarity", "mean")), agents("mean", "destination_similarity")),
    ],
    "deffuant": [
        ("assimilation", "d_micro_assimilation", agents("fraction", "interaction_accepted"), 1, 1, 2, _four(agents("variance", near("interaction_accepted", "fraction"))), _AGREED),
        ("contraction", "d_micro_shift", agents("mean", one("abs", "agent_shift")), 2, 1, 3, _four(agents("variance", near(one("abs", "agent_shift"), "mean"))), _AGREED),
        ("repulsion", "d_micro_repulsion", agents("fraction", "interaction_backfire"), 3, 1, 4, unit(two("divide", agents("mean", two("distance", _OPINION, near(_OPINION, "mean"))), 2.0)), unit(agents("mean", one("abs", "state_opinion")))),
        ("adaptive_rewiring", "d_micro_rewiring", agents("fraction", "edge_rewired"), 5, 1, 5, _four(agents("variance", near("edge_rewired", "fraction"))), unit(two("divide", {"op": "network_component_count", "edges": field("network_edges"), "node_count": field("agent_count")}, "agent_count"))),
    ],
}
#: The variant of a simulator that disables a mechanism, and which.
DISABLED = {
    "schelling": ("disable_homophilic_relocation", "homophilic_destination_selection"),
    "deffuant": ("disable_backfire", "repulsion"),
}


def disabled_mechanism(scenario: str, variant: str) -> str | None:
    known, mechanism = DISABLED[scenario]
    if variant not in ("baseline", known):
        raise ValueError(f"{scenario} has no variant {variant!r}")
    return mechanism if variant == known else None


def processes(scenario: str) -> dict[str, dict]:
    """identifier -> expression of the twelve true processes; meso and macro ones read the hidden channels."""
    hidden = lambda i: {"op": "select", "input": field("mechanism_channel"), "axis": "channel", "index": i}
    rows = CHAINS[scenario]
    return {r[1]: r[2] for r in rows} | {f"{scenario[0]}_{scale}_{i}": hidden(i + k) for scale, k in (("meso", 0), ("macro", 4)) for i in range(4)}


def relations(scenario: str) -> list[tuple[str, str, int, int, str]]:
    """source, target, lag, sign, mechanism."""
    p = scenario[0]
    return list(
        chain.from_iterable(
            [(source, f"{p}_meso_{i}", lag, sign, mechanism), (f"{p}_meso_{i}", f"{p}_macro_{i}", late, 1, mechanism)]
            for i, (mechanism, source, _, lag, sign, late, _, _) in enumerate(CHAINS[scenario])
        )
    )


def drivers(scenario: str) -> dict[str, dict]:
    """What the hidden channels are made of: driver_i, meso_i and macro_i (contexts)."""
    return {f"{n}_{i}": r[k] for i, r in enumerate(CHAINS[scenario]) for n, k in (("driver", 2), ("meso", 6), ("macro", 7))}
