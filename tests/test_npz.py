"""Archives written from tables and read back, in parts, with hidden columns, and broken."""

from __future__ import annotations

import json
import os

import pytest

from driftline.sources import npz

SCHEMA = "name string, time long, value double, secret double"


@pytest.fixture
def rows():
    return [(f"run{k}", t, None if t == 3 else k + t / 2, float(k * t)) for k in range(4) for t in range(25)]


def test_round_trip_in_parts(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    npz.write_archives(df, f"file://{tmp_path}/a")
    for verify in (False, True):
        back = npz.read_archives(spark, f"{tmp_path}/a", SCHEMA, rows=10, verify=verify)
        assert back.rdd.getNumPartitions() == 12
        assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sorted(r[0] for r in npz.read_archives(spark, f"{tmp_path}/a", "time long").collect()) == sorted(r[1] for r in rows)
    with pytest.raises(Exception, match="written already"):
        npz.write_archives(df, f"{tmp_path}/a")
    assert npz.read_archives(spark, f"{tmp_path}/a", SCHEMA).count() == 100


def test_hidden_columns_lie_in_the_other_root(spark, rows, tmp_path):
    a, b = f"{tmp_path}/public", f"{tmp_path}/hidden"
    npz.write_archives(spark.createDataFrame(rows, SCHEMA), a, ("secret",), b)
    assert {r["secret"] for r in npz.read_archives(spark, a, SCHEMA).collect()} == {None}
    assert sorted(map(tuple, npz.read_archives(spark, a, SCHEMA, b, verify=True).collect()), key=str) == sorted(rows, key=str)
    told = json.load(open(f"{a}/manifest.json"))["archives"]
    assert len(told) == 4 and all(e["columns"] == ["time", "value"] and e["hidden_columns"] == ["secret"] for e in told)


def test_a_cut_archive_is_named(spark, rows, tmp_path):
    npz.write_archives(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a")
    one = sorted(x for x in os.listdir(f"{tmp_path}/a") if x.endswith(".npz"))[0]
    data = open(f"{tmp_path}/a/{one}", "rb").read()
    open(f"{tmp_path}/a/{one}", "wb").write(data[: len(data) // 2])
    for verify in (False, True):
        with pytest.raises(Exception, match=one):
            npz.read_archives(spark, f"{tmp_path}/a", SCHEMA, verify=verify).collect()


def test_a_failed_job_leaves_no_table(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    bad = df.withColumn("value", F.when(F.col("name") == "run3", F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        npz.write_archives(bad, f"{tmp_path}/a", ("secret",), f"{tmp_path}/b")
    assert not os.path.exists(f"{tmp_path}/a/manifest.json")
    npz.write_archives(df, f"{tmp_path}/a", ("secret",), f"{tmp_path}/b")
    assert npz.read_archives(spark, f"{tmp_path}/a", SCHEMA, f"{tmp_path}/b", verify=True).count() == 100


def test_empty_table(spark, tmp_path):
    npz.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert npz.read_archives(spark, f"{tmp_path}/a", SCHEMA).count() == 0
