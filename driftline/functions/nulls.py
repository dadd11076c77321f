"""Missing values: NULL inside the engine, whatever the input used.

NaN and infinities become NULL once, at ingest. Arithmetic then follows SQL; the few rules that
differ (division by zero, comparisons with a missing side, roots of negatives) are here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def clean(c: Column) -> Column:
    """c as double, NULL where it is not finite."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(left: Column, right: Column) -> Column:
    """left / right; 0 where right is 0, whatever left is; NULL where right is missing."""
    return F.when(right == 0, 0.0).otherwise(left / right)


def root(c: Column) -> Column:
    """Square root; of negatives 0."""
    return F.when(c.isNotNull(), F.sqrt(F.greatest(c, F.lit(0.0))))


def log_one_plus(c: Column) -> Column:
    """log(1 + c), c not under -0.999999."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(-0.999999))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


COMPARISONS = {
    "greater": lambda a, b: F.coalesce(a > b, F.lit(False)),
    "greater_equal": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    "less": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "less_equal": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    "equal": lambda a, b: F.coalesce(a == b, F.lit(False)),
    "not_equal": lambda a, b: F.coalesce(a != b, F.lit(True)),
}

UNARY = {"abs": F.abs, "negate": lambda c: -c, "sqrt": root, "log1p": log_one_plus}

BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": ratio,
    "safe_ratio": ratio,
    "distance": lambda a, b: F.abs(a - b),
}


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r with each side centred on its own mean; 0 where a side does not vary.

    Sums of products run over rows with both, each mean and spread over the rows with that side. In
    two-row form sum((x - mx)(y - my)) = sxy - mx * sy' - my * sx' + n' mx my, with primes over rows
    that have both.
    """
    both = x.isNotNull() & y.isNotNull()
    mx, my = F.avg(x), F.avg(y)
    n = F.count_if(both).cast("double")
    top = (
        F.sum(F.when(both, x * y))
        - mx * F.sum(F.when(both, y))
        - my * F.sum(F.when(both, x))
        + n * mx * my
    )
    # var_pop is numerically stable where the sum of squares is not
    bottom = F.sqrt(F.var_pop(x) * F.count(x) * F.var_pop(y) * F.count(y))
    return F.when(F.coalesce(bottom, F.lit(0.0)) > 0, F.coalesce(top, F.lit(0.0)) / bottom).otherwise(0.0)


def reducer(op: str, x: Column, dtype: str, q: float | None = None) -> Column:
    """Aggregate of a whole axis."""
    number = x.cast("double")
    if op == "mean":
        return F.avg(number)
    if op == "sum":
        return F.coalesce(F.sum(number), F.lit(0.0))
    if op == "count":
        return (F.count_if(x) if dtype == "bool" else F.count(x)).cast("double")
    if op == "fraction":
        return F.avg(number)
    if op == "variance":
        return F.var_pop(number)
    if op == "std":
        return F.stddev_pop(number)
    if op == "quantile":
        return F.percentile(number, F.lit(float(q)))
    raise ValueError(op)


def group_reducer(op: str, x: Column) -> Column:
    """Aggregate within a group or neighbourhood: empty ones are missing, but counted as 0; false counts."""
    number = x.cast("double")
    if op == "count":
        return F.count(number).cast("double")
    if op == "sum":
        return F.sum(number)
    if op == "fraction":
        return F.avg(F.when(number.isNotNull(), (number != 0).cast("double")))
    return reducer(op, x, "numeric")
