"""Temporal operators over one ordered series for each key: all window functions share one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(keys, time: str = "time"):
    return Window.partitionBy(*keys).orderBy(time)


def rolling_mean(c: Column, w, window: int) -> Column:
    return F.avg(c).over(w.rowsBetween(1 - window, 0))


def rolling_std(c: Column, w, window: int) -> Column:
    return F.stddev_pop(c).over(w.rowsBetween(1 - window, 0))


def difference(c: Column, w) -> Column:
    """Change from the row before; 0 at the first."""
    return c - F.when(F.row_number().over(w) == 1, c).otherwise(F.lag(c).over(w))


def cumulative_mean(c: Column, w) -> Column:
    """Mean of all rows so far; missing from the first missing value on."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.max(c.isNull()).over(so_far), None).otherwise(F.sum(c).over(so_far) / F.row_number().over(w))


def temporal(c: Column, w, spec: dict) -> Column:
    """A temporal aggregation by its specification."""
    op = spec["op"]
    if op == "identity":
        return c
    if op == "difference":
        return difference(c, w)
    if op == "cumulative_mean":
        return cumulative_mean(c, w)
    return {"rolling_mean": rolling_mean, "rolling_std": rolling_std}[op](c, w, spec["window"])


def lags(df: DataFrame, keys, value: str, most: int, time: str = "time") -> DataFrame:
    """df with lag_1 .. lag_most of value."""
    w = series(keys, time)
    return df.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(1, most + 1)])


def onset(df: DataFrame, keys, flag: str, value: str, start: int, run: int, time: str = "time") -> DataFrame:
    """keys, onset: the first time from start on at which flag holds for run rows and value keeps one sign; else -1."""
    ahead = series(keys, time).rowsBetween(0, run - 1)
    sign = F.signum(value)
    marked = df.select(
        *keys,
        F.col(time).alias("_t"),
        F.coalesce(
            F.min(F.coalesce(F.col(flag), F.lit(False))).over(ahead)
            & (F.count(sign).over(ahead) == run)
            & (F.min(sign).over(ahead) == F.max(sign).over(ahead))
            & (F.min(F.abs(sign)).over(ahead) > 0),
            F.lit(False),
        ).alias("_begins"),
    )
    first = F.min(F.when(F.col("_begins") & (F.col("_t") >= start), F.col("_t")))
    return marked.groupBy(*keys).agg(F.coalesce(first, F.lit(-1)).alias("onset"))


def circular_shift(df: DataFrame, keys, value: str, shifts: DataFrame, time: str = "time") -> DataFrame:
    """df with value moved shift rows later, the end coming round to the beginning.

    shifts has a row (keys, shift) for each series; times are 0 .. n - 1. An equi-join on the moved
    time, not a range join.
    """
    n = Window.partitionBy(*keys)
    moved = (
        df.join(shifts, list(keys))
        .withColumn("_n", F.count("*").over(n))
        .select(*keys, F.pmod(F.col(time) + F.col("shift"), F.col("_n")).cast(df.schema[time].dataType).alias(time), F.col(value).alias("_moved"))
    )
    return df.drop(value).join(moved.withColumnRenamed("_moved", value), [*keys, time])


def interpolate(df: DataFrame, keys, value: str, time: str = "time") -> DataFrame:
    """df with gaps of value filled: linearly inside, the nearest value at the ends, the mean, then 0."""
    back = series(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    ahead = series(keys, time).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    at = F.when(F.col(value).isNotNull(), F.col(time))
    v0, t0 = F.last(value, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(back)
    v1, t1 = F.first(value, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
    df = df.withColumns({"_v0": v0, "_t0": t0, "_v1": v1, "_t1": t1, "_mean": F.avg(value).over(whole)})
    inside = F.when(
        F.col("_t1") > F.col("_t0"),
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(time) - F.col("_t0")) / (F.col("_t1") - F.col("_t0")),
    )
    filled = F.coalesce(value, inside, "_v0", "_v1", "_mean", F.lit(0.0))
    return df.withColumn(value, filled).drop("_v0", "_t0", "_v1", "_t1", "_mean")


def peak(df: DataFrame, keys, value: str, start: int, time: str = "time") -> DataFrame:
    """keys, peak_time: where |value| is largest from start on, the first of equals."""
    best = F.min_by(time, F.struct(-F.abs(value), F.col(time)))
    return df.filter((F.col(time) >= start) & F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("peak_time"))


def false_discovery(df: DataFrame, keys, p: str = "p", q: str = "q") -> DataFrame:
    """df with Benjamini-Hochberg q values of p within keys."""
    part = Window.partitionBy(*keys)
    up = part.orderBy(F.col(p).asc())
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    df = df.withColumns({"_n": F.count(p).over(part), "_rank": F.rank().over(up) + F.count("*").over(part.orderBy(p).rangeBetween(0, 0)) - 1})
    lowest = F.min(raw).over(up.rangeBetween(0, Window.unboundedFollowing))
    return df.withColumn(q, F.greatest(F.lit(0.0), F.least(F.lit(1.0), lowest))).drop("_n", "_rank")


def average_rank(c: Column, w_partition) -> Column:
    """Ranks with ties at their mean; w_partition: a window without order."""
    ordered = w_partition.orderBy(c)
    return F.rank().over(ordered) + (F.count("*").over(ordered.rangeBetween(0, 0)) - 1) / 2
