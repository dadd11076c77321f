"""Edge lists as JSON lines, run logs as arrays, result tables with fixed columns."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = "source string, target string, lag int, beta double, p_value double, q_value double, effect_direction string, support double, lag_support double, lag_std double, hypothesis_group_id string"
RECORD = f"scenario string, method string, edges array<struct<{EDGE.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>"


def write_graphs(edges: DataFrame, path: str) -> None:
    """A JSON line for each (scenario, method), with its edges in order."""
    names = [x.split()[0] for x in EDGE.split(", ")]
    rows = edges.groupBy("scenario", "method").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("edges"))
    rows.write.mode("errorifexists").json(path)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """scenario, method and a row for each edge."""
    return spark.read.schema(RECORD).json(path).select("scenario", "method", F.explode("edges").alias("e")).select("scenario", "method", "e.*")


def read_arrays(spark: SparkSession, path: str, field: str, dims: tuple[str, ...], dtype: str = "double") -> DataFrame:
    """path, dims, value of one named array of each compressed array file (NPZ) under path.

    Whole files go to a task each; a file that holds no such field, or with another number of
    dimensions, is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x = z[field]
                if x.ndim != len(dims):
                    raise ValueError(f"{field} in {where} has {x.ndim} dimensions, not {len(dims)}")
                flat = x.ravel()
                value = [None if isinstance(v, float) and not np.isfinite(v) else v for v in flat.tolist()]
                at = [pa.array(i.ravel(), pa.int32()) for i in np.indices(x.shape)]
                kind = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}[dtype]
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(value)), *at, pa.array(value, kind)], ["path", *dims, "value"])

    return files.mapInArrow(run, ", ".join(["path string", *[f"{d} int" for d in dims], f"value {dtype}"]))


def require_columns(df: DataFrame, columns, what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}")
    return df


def write_once(df: DataFrame, path: str, columns=None) -> dict:
    """Write df as Parquet, refusing an existing path; its manifest: columns, rows and a hash of its rows in any order."""
    if columns is not None:
        df = require_columns(df, columns, path).select(*columns)
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    row = back.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"columns": back.columns, "row_count": row["n"], "sha256": hashlib.sha256(json.dumps([back.columns, row["n"], str(row["h"])]).encode()).hexdigest()}
