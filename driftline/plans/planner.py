"""From expressions to one DataFrame plan.

All expressions of a data set are planned together. Equal subexpressions are planned once, and all
reductions of one table to the same dimensions become one aggregation, so that twenty indicators of
a table cost one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import nulls
from driftline.operators import network, windows
from driftline.operators.tensor import Dataset, Tensor, align, column_of, fresh, settle
from driftline.plans import grammar as g


def _entropy_of(tiny: float) -> Column:
    """Entropy of counts _c from sums that partial aggregates merge: -sum c/n ln(c/n + tiny) is ln n - (sum c ln c) / n, less tiny for each value."""
    n = F.sum("_c")
    return F.log(n) - F.sum(F.col("_c") * F.log("_c")) / n - tiny * F.count(F.lit(1))


class Planner:
    def __init__(self, data: Dataset):
        self.data, self.keys = data, data.keys
        self.done: dict[str, Tensor] = {}
        #: reducers asked of each pair of values and groups, or values and edges
        self.asked: dict[str, set[str]] = {}

    def plan(self, nodes: list[dict]) -> list[Tensor]:
        for node in nodes:
            g.analyze(node, self.data.fields)
        for n in (n for node in nodes for n in g.walk(node) if n["op"] in ("group_reduce", "network_neighborhood_reduce")):
            self.asked.setdefault(self._shared(n), set()).add(n["reducer"])
        waiting = {g.canonical(n): n for node in nodes for n in g.walk(node) if n["op"] in (*g.AXIS_REDUCERS, "correlation")}
        for level in sorted({g.height(n) for n in waiting.values()}):
            self._reduce_together([n for n in waiting.values() if g.height(n) == level])
        return [self.tensor(n) for n in nodes]

    def tensor(self, node: dict) -> Tensor:
        key = g.canonical(node)
        if key not in self.done:
            self.done[key] = self._build(node)
        return self.done[key]

    @staticmethod
    def _shared(node: dict) -> str:
        return g.canonical({k: v for k, v in node.items() if k != "reducer"})

    def _together(self, node: dict, make) -> Tensor:
        """The column of node's reducer, of one table made for all reducers asked of the same inputs."""
        key = self._shared(node)
        if key not in self.done:
            self.done[key] = make(sorted(self.asked.get(key, {node["reducer"]})))
        t = self.done[key]
        return Tensor(t.df, t.dims, F.col(node["reducer"]), "numeric")

    def _reduce_together(self, nodes: list[dict]) -> None:
        """Plan reductions of one height, those of one table and one result shape in one aggregation."""
        by: dict[tuple, list] = {}
        for node in nodes:
            if node["op"] == "correlation":
                left, right = self.tensor(node["left"]), self.tensor(node["right"])
                df, x, y = align(left, right, self.keys)
                child, make = Tensor(df, left.dims, x, "numeric", left.windowed or right.windowed), (lambda x, y=y: nulls.correlation(x.cast("double"), y.cast("double")))
                if child.windowed:
                    name = fresh()
                    child = settle(Tensor(df.withColumn(name, y), left.dims, x, "numeric"))
                    make = lambda x, name=name: nulls.correlation(x, F.col(name))
            else:
                child = self.tensor(node["input"])
                make = lambda x, n=node, d=child.dtype: nulls.reducer(n["op"], x, d, n.get("q"))
            if child.df is None or child.parts:
                raise g.ExpressionError(f"{node['op']} over a fixed axis or a constant")
            if child.windowed:
                child = settle(child)
            dims = tuple(d for d in child.dims if d != node["axis"])
            by.setdefault((id(child.df), dims), []).append((node, child, make(child.value)))
        for (_, dims), group in by.items():
            names = [fresh("r") for _ in group]
            df = group[0][1].df.groupBy(*self.keys, *dims).agg(*[agg.alias(n) for (_, _, agg), n in zip(group, names, strict=True)])
            for (node, _, _), name in zip(group, names, strict=True):
                self.done[g.canonical(node)] = Tensor(df, dims, F.col(name), "numeric")

    def _build(self, node: dict) -> Tensor:
        op = node["op"]
        if op == "field":
            return self.data.tensor(node["name"])
        if op == "constant":
            v = node["value"]
            dtype = "bool" if isinstance(v, bool) else "integer" if isinstance(v, int) else "numeric"
            return Tensor(None, (), F.lit(v if dtype == "bool" else float(v)), dtype)
        if op in nulls.UNARY or op == "clip":
            t = self.tensor(node["input"])
            x = t.value.cast("double")
            value = nulls.clip(x, node["minimum"], node["maximum"]) if op == "clip" else nulls.UNARY[op](x)
            return Tensor(t.df, t.dims, value, t.dtype, t.windowed)
        if op in nulls.BINARY or op in nulls.COMPARISONS:
            a, b = self.tensor(node["left"]), self.tensor(node["right"])
            df, x, y = align(a, b, self.keys)
            value = nulls.BINARY[op](x.cast("double"), y.cast("double")) if op in nulls.BINARY else nulls.COMPARISONS[op](x.cast("double"), y.cast("double"))
            return Tensor(df, a.dims or b.dims, value, "numeric" if op in nulls.BINARY else "bool", a.windowed or b.windowed)
        if op == "where":
            c, t = self.tensor(node["condition"]), self.tensor(node["input"])
            df, condition, value = align(c, t, self.keys)
            return Tensor(df, t.dims or c.dims, F.when(condition, value), t.dtype, c.windowed or t.windowed)
        if op == "select":
            t = self.tensor(node["input"])
            axis, index = node["axis"], node["index"]
            dims = tuple(d for d in t.dims if d != axis)
            if axis in g.FIXED_AXES:
                return Tensor(t.df, dims, t.parts[index], t.dtype)
            name = fresh()
            return Tensor(column_of(t, self.keys, name).filter(F.col(axis) == index).drop(axis), dims, F.col(name), t.dtype)
        if op in ("time_difference", "rolling_mean", "rolling_std"):
            t = self.tensor(node["input"])
            t = settle(t) if t.windowed else t
            w = windows.series([*self.keys, *[d for d in t.dims if d != "time"]])
            x = t.value.cast("double")
            value = windows.difference(x, w) if op == "time_difference" else windows.temporal(x, w, {"op": op, "window": node["window"]})
            return Tensor(t.df, t.dims, value, "numeric", True)
        if op in ("entropy", "binned_entropy"):
            return self._entropy(node)
        if op == "group_reduce":
            return self._together(node, lambda ops: self._group_reduce(node, ops))
        return self._structure(node)

    def _entropy(self, node: dict) -> Tensor:
        t = self.tensor(node["input"])
        at = [*self.keys, *[d for d in t.dims if d != node["axis"]]]
        rows = column_of(t, self.keys, "_x")
        if node["op"] == "entropy":
            counts = rows.filter(F.col("_x").isNotNull()).groupBy(*at, "_x").agg(F.count("*").alias("_c"))
            tiny = 1e-15
        else:
            low, high = F.min("_x").alias("_low"), F.max("_x").alias("_high")
            bounds = rows.groupBy(*at).agg(low, high)
            bins = node["bins"]
            width = F.col("_high") - F.col("_low")
            place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_low")) / width * bins))).otherwise(0)
            counts = rows.filter(F.col("_x").isNotNull()).join(bounds, at).groupBy(*at, place.alias("_x")).agg(F.count("*").alias("_c"))
            tiny = 0.0
        found = counts.groupBy(*at).agg(_entropy_of(tiny).alias("_h"))
        name = fresh()
        dims = tuple(d for d in t.dims if d != node["axis"])
        all_ = rows.select(*at).distinct()
        return Tensor(all_.join(found, at, "left").select(*at, F.coalesce("_h", F.lit(0.0)).alias(name)), dims, F.col(name), "numeric")

    def _group_reduce(self, node: dict, ops: list[str]) -> Tensor:
        values, groups, axis = self.tensor(node["values"]), self.tensor(node["groups"]), node["axis"]
        if values.df is groups.df:
            rows = values.df.select(*self.keys, *groups.dims, values.value.alias("_x"), groups.value.cast("long").alias("group"))
        else:
            own = column_of(groups, self.keys, "group").withColumn("group", F.col("group").cast("long"))
            rows = own.join(column_of(values, self.keys, "_x"), [*self.keys, *values.dims])
        at = [*self.keys, *[d for d in groups.dims if d != axis]]
        live = rows.filter(F.col("group") >= 0)
        # every label from 0 to the run's largest has a row, at every place
        places = rows.select(*at).distinct()
        most = live.groupBy(*self.keys).agg(F.max("group").alias("_most"))
        dense = places.join(most, list(self.keys), "left") if self.keys else places.crossJoin(F.broadcast(most))
        found = dense.select(*at, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_most", F.lit(0).cast("long")))).alias("group"))
        plain = [op for op in ops if op != "entropy"]
        if plain:
            reduced = live.groupBy(*at, "group").agg(*[nulls.group_reducer(op, F.col("_x")).alias(f"_{op}") for op in plain])
            found = found.join(reduced, [*at, "group"], "left")
        if "entropy" in ops:
            counts = live.filter(F.col("_x").isNotNull()).groupBy(*at, "group", "_x").agg(F.count("*").alias("_c"))
            found = found.join(counts.groupBy(*at, "group").agg(_entropy_of(1e-15).alias("_entropy")), [*at, "group"], "left")
        out = [(F.coalesce("_count", F.lit(0.0)) if op == "count" else F.col(f"_{op}")).alias(op) for op in ops]
        dims = (*[d for d in groups.dims if d != axis], "group")
        return Tensor(found.select(*at, "group", *out), dims, F.lit(None), "numeric")

    def _edges(self, node: dict) -> tuple[DataFrame, bool]:
        t = self.tensor(node)
        dims = [d for d in t.dims if d not in ("edge", "endpoint")]
        return t.df.select(*self.keys, *dims, t.parts[0].alias("u"), t.parts[1].alias("v")), bool(dims)

    def _nodes(self, node: dict, like: DataFrame) -> DataFrame:
        t = self.tensor(node)
        if t.df is None:
            return like.select(*self.keys).distinct().withColumn("node_count", t.value.cast("double"))
        return t.df.select(*self.keys, t.value.cast("double").alias("node_count")).distinct()

    def _structure(self, node: dict) -> Tensor:
        op, name = node["op"], fresh()

        def out(df: DataFrame, dims: tuple[str, ...], value: str = "value") -> Tensor:
            return Tensor(df.withColumnRenamed(value, name), dims, F.col(name), "numeric")

        if op in ("connected_component_count", "largest_component_fraction", "spatial_neighbor_similarity"):
            grid = column_of(self.tensor(node["input"]), self.keys, "value")
            if op == "spatial_neighbor_similarity":
                return out(network.grid_similarity(grid, self.keys), ("time",))
            # both numbers come of one pass
            return self._pair(f"grid:{g.canonical(node['input'])}", op, lambda: network.grid_components(grid, self.keys), "connected_component_count")
        edges, dynamic = self._edges(node["edges"])
        if op == "network_density":
            at = [*self.keys, *(["time"] if dynamic else [])]
            return out(network.density(edges, self._nodes(node["node_count"], edges), self.keys, at), ("time",) if dynamic else ())
        if op in ("network_component_count", "network_largest_component_fraction"):
            nodes = self._nodes(node["node_count"], edges)
            key = f"graph:{g.canonical([node['edges'], node['node_count']])}"
            return self._pair(key, op, lambda: network.graph_components(edges, nodes, self.keys), "network_component_count")
        values = column_of(self.tensor(node["values"]), self.keys, "value")
        if op == "network_assortativity":
            return out(network.assortativity(values, edges, self.keys, dynamic=dynamic), ("time",))
        near = lambda ops: Tensor(network.neighbourhood(values, edges, self.keys, ops, dynamic=dynamic), g.NODES, F.lit(None), "numeric")
        return self._together(node, near)

    def _pair(self, key: str, op: str, make, first: str) -> Tensor:
        if key not in self.done:
            self.done[key] = Tensor(make(), ("time",), F.lit(None), "numeric")
        df = self.done[key].df
        return Tensor(df, ("time",), F.col("components" if op == first else "largest"), "numeric")


def evaluate(data: Dataset, indicators: dict[str, dict], temporal: dict[str, dict] | None = None) -> DataFrame:
    """keys, time, node_id, value of each indicator; temporal: a temporal aggregation by indicator.

    Indicators of one planned table leave it in one pass.
    """
    for node in indicators.values():
        g.analyze_indicator(node, data.fields)
    for spec in (temporal or {}).values():
        g.check_temporal(spec)
    planned = Planner(data).plan(list(indicators.values()))
    by: dict[int, list[tuple[str, Tensor]]] = {}
    for name, t in zip(indicators, planned, strict=True):
        by.setdefault(id(t.df), []).append((name, t))
    parts = []
    for group in by.values():
        cells = [F.struct(F.lit(name).alias("node_id"), nulls.clean(t.value).alias("value")) for name, t in group]
        # window functions must be columns before the rows are multiplied
        rows = group[0][1].df.select(*data.keys, "time", F.array(*cells).alias("_cells")).select(*data.keys, "time", F.explode("_cells").alias("_c"))
        parts.append(rows.select(*data.keys, "time", "_c.node_id", "_c.value"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if temporal:
        w = windows.series([*data.keys, "node_id"])
        value: Column = F.col("value")
        for name, spec in temporal.items():
            if spec["op"] != "identity":
                value = F.when(F.col("node_id") == name, windows.temporal(F.col("value"), w, spec)).otherwise(value)
        found = found.withColumn("value", value)
    return found
