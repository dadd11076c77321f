"""Shared plumbing of the training-data operators: tables, scratch space, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a small side may be broadcast; beyond either joins shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Rows with texts that a worker turns into Python objects at once.
ROWS = 500

_scratch: list[tuple[SparkSession, str, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in one process a temporary one where unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as tell it and what begins with it from df's columns."""
    taken = [c.lower() for c in df.columns]
    out = []
    for name in names:
        while any(c.startswith(name.lower()) for c in taken):
            name = f"_{name}"
        out.append(name)
    return out


def scratch_path(spark: SparkSession, name: str, tag: str = "") -> str:
    """A new path in the shared folder; removed by release(tag) or when the process ends."""
    path = f"{shared_folder(spark)}/driftline/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, tag, path))
    return path


def materialize(df: DataFrame, name: str, tag: str = "") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage at a copy that outlives any executor, and fixes rows whose ids were made up
    on the way (monotonically_increasing_id) once and for all.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(tag: str) -> None:
    """Delete the scratch tables of a tag; only once nothing lazy reads them any more."""
    for item in [x for x in _scratch if x[1] == tag]:
        _scratch.remove(item)
        delete_path(item[0], item[2])


@atexit.register
def _release_all() -> None:
    for spark, _, path in _scratch:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def small_side(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows and, as text, `most_bytes` bytes, else df as it is (the join then shuffles)."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= most_bytes else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that what a worker makes of their texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bucket(column, modulus: int):
    """crc32(column as text) mod modulus: how rows are dealt to held-out and training folds."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
