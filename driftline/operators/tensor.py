"""Named-dimension data as DataFrames: a row for each place, a column for each value."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.plans.grammar import FIXED_AXES, TensorType

_numbers = count()


def fresh(hint: str = "v") -> str:
    return f"_{hint}{next(_numbers)}"


@dataclass
class Tensor:
    """A value: an expression over the rows of df, which has a row for each run and place of dims.

    df is None for constants. windowed: the expression holds a window function and must be made a
    column before it is aggregated or windowed again.
    """

    df: DataFrame | None
    dims: tuple[str, ...]
    value: Column
    dtype: str
    windowed: bool = False
    parts: list[Column] | None = None  # values along a fixed last axis


@dataclass
class Dataset:
    """Tables of a data set: for each tuple of row dimensions one table with keys, dimensions and fields.

    Fields along a fixed axis (endpoint, coordinate, channel) are columns name_0, name_1 and so on.
    """

    keys: tuple[str, ...]
    tables: dict[tuple[str, ...], DataFrame]
    fields: dict[str, TensorType] = field(default_factory=dict)

    def tensor(self, name: str) -> Tensor:
        kind = self.fields[name]
        fixed = [d for d in kind.dims if d in FIXED_AXES]
        rows = tuple(d for d in kind.dims if d not in FIXED_AXES)
        df = self.tables[rows]
        if not fixed:
            return Tensor(df, rows, F.col(name), kind.dtype)
        parts = [F.col(f"{name}_{i}") for i in range(FIXED_AXES[fixed[0]])]
        return Tensor(df, kind.dims, parts[0], kind.dtype, parts=parts)


def settle(t: Tensor) -> Tensor:
    """t with its value as a column of its own."""
    name = fresh()
    return Tensor(t.df.withColumn(name, t.value), t.dims, F.col(name), t.dtype)


def column_of(t: Tensor, keys: tuple[str, ...], name: str, *more: str) -> DataFrame:
    """keys, dims and the value under a name."""
    return t.df.select(*keys, *t.dims, *more, t.value.alias(name))


def align(a: Tensor, b: Tensor, keys: tuple[str, ...]) -> tuple[DataFrame | None, Column, Column]:
    """One table with both values. A constant needs none, values of one table no join."""
    if a.df is None or b.df is None or a.df is b.df:
        return (a.df if a.df is not None else b.df), a.value, b.value
    wide, thin = (a, b) if len(a.dims) >= len(b.dims) else (b, a)
    name = fresh()
    on = [*keys, *thin.dims]
    right = column_of(thin, keys, name)
    df = settle(wide) if wide.windowed else wide
    joined = df.df.join(right, on, "left") if on else df.df.crossJoin(F.broadcast(right))
    mine, other = df.value, F.col(name)
    return (joined, mine, other) if wide is a else (joined, other, mine)
