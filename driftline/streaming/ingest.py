"""Streaming ingest of event cells: the reducers of the batch engine over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.nulls import clean


def windowed_reducers(stream: DataFrame, time: str, keys, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """keys, start, mean, sum, count, variance, std of each window; rows later than `late` are dropped with a mark.

    Works on streams and on tables alike; state is one row for each key and open window.
    """
    x = F.col("_x")
    rows = stream.withColumn("_x", clean(F.col(value)))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    found = rows.groupBy(*keys, F.window(time, window).alias("_w")).agg(
        F.avg(x).alias("mean"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.count(x).alias("count"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std")
    )
    return found.select(*keys, F.col("_w.start").alias("start"), "mean", "sum", "count", "variance", "std")
