"""Sources, sinks, simulators, sweeps and streaming."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import robustness
from driftline.sources import graphs, simulators
from driftline.streaming.ingest import windowed_reducers


def test_graphs_round_trip(spark, tmp_path):
    row = ("s", "m", "a", "b", 1, 0.5, 0.01, 0.02, "increase", None, 1.0, 0.0, "g")
    df = spark.createDataFrame([row, (*row[:2], "b", "c", *row[4:])], f"scenario string, method string, {graphs.EDGE}")
    graphs.write_graphs(df, f"{tmp_path}/g")
    assert sorted(map(tuple, graphs.read_graphs(spark, f"{tmp_path}/g").collect())) == sorted(map(tuple, df.collect()))


def test_arrays_become_rows(spark, tmp_path):
    np.savez_compressed(tmp_path / "run.npz", x=np.array([[1.0, np.nan], [3.0, 4.0]]))
    rows = graphs.read_arrays(spark, str(tmp_path / "*.npz"), "x", ("time", "agent")).orderBy("time", "agent").collect()
    assert [(r["time"], r["agent"], r["value"]) for r in rows] == [(0, 0, 1), (0, 1, None), (1, 0, 3), (1, 1, 4)]


def test_write_once_refuses_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    a = graphs.write_once(df, f"{tmp_path}/t", ["k", "v"])
    assert a["row_count"] == 1 and a["sha256"] == graphs.write_once(df, f"{tmp_path}/u")["sha256"]
    with pytest.raises(Exception, match="already exists"):
        graphs.write_once(df, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="lacks"):
        graphs.write_once(df, f"{tmp_path}/w", ["zz"])


def test_task_matrix():
    three = {k: (0.2, 0.5, 0.9) for k in "abc"}
    assert len(simulators.task_matrix(three, range(24))) == 24 * 14
    assert len(simulators.task_matrix(three, range(12), doses=2)) == 12 * 8


def test_neighbourhood_on_a_torus():
    grid = np.full((3, 3), -1)
    grid[0, 0] = grid[2, 2] = 1
    total, same = simulators.neighbour_counts(grid)
    assert total[0, 0] == same[0, 0] == 1
    assert simulators.torus_distance((0, 0), (2, 2), (3, 3)) == 2


def test_simulations_are_matched_and_whole(spark):
    tasks = [{"condition": c, "seed": s, "tolerance": t} for c, t in (("low", 0.2), ("high", 0.7)) for s in (1, 2)]
    df = simulators.simulate(spark, "segregation", tasks, {"steps": 5, "side": 7, "agents": 30}).cache()
    assert df.count() == 4 * 5 * 30
    assert df.groupBy("condition", "seed", "time", "pos_y", "pos_x").count().filter("count > 1").count() == 0
    first = df.filter("time = 0").groupBy("seed", "agent").agg(F.countDistinct("pos_y", "pos_x").alias("n"))
    assert first.filter("n > 1").count() == 0  # the same start for one seed


def test_opinion_network_keeps_its_edges():
    rows, links = simulators.opinions(seed=3, steps=8, agents=20, degree=4, bound=0.3, rate=0.3, rewiring=0.5)
    assert all(-1 <= r[2] <= 1 for r in rows)
    for t in range(8):
        own = [(u, v) for s, _, u, v in links if s == t]
        assert len(own) == len(set(own)) == 40 and all(u < v for u, v in own)
        assert {n for e in own for n in e} == set(range(20))


def series(spark):
    rows = [(s, t, n, float(np.sin(t + s + len(n)))) for s in range(4) for t in range(30) for n in ("a", "bb")]
    return spark.createDataFrame(rows, "seed int, time int, node_id string, value double")


def test_perturbations_do_not_depend_on_partitions(spark):
    s = series(spark)
    key = lambda d: sorted((r["seed"], r["time"], r["node_id"], round(r["value"], 9)) for r in d.collect())
    for f in (lambda d: robustness.add_noise(d, 0.3, 1), lambda d: robustness.drop_values(d, 0.2, 1), lambda d: robustness.subset(d, 2, 1)):
        assert key(f(s)) == key(f(s.repartition(5)))
    assert key(robustness.drop_values(s, 0.2, 1)) != key(s)
    assert robustness.subset(s, 2, 1).select("seed").distinct().count() == 2


@pytest.mark.parametrize("kind", robustness.CORRUPTIONS)
def test_corruptions(spark, kind):
    pairs = [("a", "b", "g1"), ("b", "c", "g1"), ("a", "d", "g2"), ("d", "c", "g2")]
    out, added = robustness.corrupt(pairs, kind, 0.25, 1)
    assert out != sorted(pairs) and len(out) == len(set(out))
    s = robustness.add_series(series(spark), {k: v and "a" for k, v in added.items()}, 1)
    assert s.count() == 240 + 120 * len(added)


def test_stream_equals_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = windowed_reducers(stream, "ts", ["event_type"], "value", late="60 days").writeStream.outputMode("complete").format("memory").queryName("driftline_stream").start()
    try:
        q.processAllAvailable()
        key = lambda d: sorted((r["event_type"], str(r["start"]), r["count"], round(r["mean"], 6), round(r["std"], 6)) for r in d.collect())
        assert key(spark.table("driftline_stream")) == key(windowed_reducers(table, "ts", ["event_type"], "value"))
    finally:
        q.stop()
