"""CSV tables, scans by manifest, scratch paths, and configuration that must stay as it is frozen."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHASES = ("baseline", "intervention")
_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, removed when the process ends."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _scratch:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def write_csv(df: DataFrame, path: str) -> None:
    """A new CSV table with a header; an existing path is an error."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, of a schema that its header must have; nothing is inferred, and rows that do not fit are an error."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def scan_phase(series: DataFrame, manifest: DataFrame, phase: str, partition: str = "primary") -> DataFrame:
    """Rows of the runs that the manifest lists for a phase of a partition; runs it lists there twice are an error.

    manifest: condition, seed, partition. The baseline phase has the condition baseline, the other all others.
    """
    if phase not in PHASES:
        raise ValueError(phase)
    is_base = F.col("condition") == "baseline"
    runs = manifest.filter((F.col("partition") == partition) & (is_base if phase == "baseline" else ~is_base)).select("condition", "seed")
    twice = runs.groupBy("condition", "seed").count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"the manifest lists a run twice: {twice[0].asDict()}")
    return series.join(runs, ["condition", "seed"], "left_semi")


def split(series: DataFrame, condition: str, scenario: str | None = None) -> DataFrame:
    """seed, time, node_id, value of a condition (and scenario), with the place of each row in its trajectory's node from 1."""
    own = series.filter(F.col("condition") == condition)
    own = own if scenario is None else own.filter(F.col("scenario") == scenario)
    order = Window.partitionBy("seed", "node_id").orderBy("time")
    return own.select("seed", "time", "node_id", "value").withColumn("step", F.row_number().over(order))


def check_rows(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """df, after its required columns (name -> type) are there and it has rows; an error otherwise."""
    kinds = dict(df.dtypes)
    wrong = {n: kinds.get(n) for n, t in required.items() if kinds.get(n) != t}
    if wrong:
        raise ValueError(f"columns missing or of another type: {wrong}")
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def canonical_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load_config(path: str, frozen: dict[str, object]) -> dict:
    """A JSON configuration; ValueError where a value under a dotted name is not the frozen one, with all that differ."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    differ = {}
    for name, wanted in frozen.items():
        at: object = config
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at != wanted:
            differ[name] = at
    if differ:
        raise ValueError(f"frozen values differ: {differ}")
    return config


def write_immutable(path: str, value) -> str:
    """Write JSON once, by way of another name; the same content again changes nothing, other content is an error. Its hash."""
    content = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() != content:
                raise ValueError(f"{path} is frozen with other content")
        return canonical_hash(value)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(part, path)
    return canonical_hash(value)
