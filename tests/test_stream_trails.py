"""Trails and clutter maps of a stream are those of the batch jobs."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysweep.operators.cluttermap import clutter_map
from skysweep.operators.filters import learn_clutter
from skysweep.operators.trails import trails_last_n
from skysweep.streaming.trails import TRAILS, hit_rows, hits_of, newest, stream_clutter, stream_trails

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def tables(spark, n=11):
    """Two runs with missing scan numbers, scans without hits, and slots that are hit again and again."""
    rng, samples, scans = np.random.default_rng(8), [], []
    for run in (1, 2):
        for i in range(n):
            if i % 5 == 3 and run == 2:
                continue
            scans.append(("r", run, i, 1000.0 + 2.5 * i, i % 2, 12, 16))
            if i % 4 != 1:
                slots = {(int(p), int(c)) for p, c in rng.integers(0, 5, (6, 2))}
                samples += [("r", run, i, p, c, int(rng.integers(100, 4000)), 700) for p, c in slots]
    return spark.createDataFrame(samples, "source_id string, run_id long, scan_id long, pulse int, col int, value int, score int"), spark.createDataFrame(scans, "source_id string, run_id long, scan_id long, ts double, angle_class int, pulses int, samples_per_pulse int")


def run(spark, folder, rows, make):
    """Feeds rows as the next batch of a stream that goes on from its checkpoint."""
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def test_newest_hit_of_each_slot():
    hits, of = newest([(4, np.array([[1, 2, 50], [0, 0, 7]])), (6, np.zeros((0, 3), np.int64)), (5, np.array([[1, 2, 60]]))])
    assert hits.tolist() == [[0, 0, 7], [1, 2, 60]] and of.tolist() == [4, 5]
    assert [len(x) for x in newest([])] == [0, 0]


def test_trails_of_a_stream(spark):
    samples, scans = tables(spark)
    rows, folder = hit_rows(samples, scans), tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def make(stream):
        return stream_trails(stream, 4, delay="1 hour").writeStream.format("parquet").option("path", f"{folder}/out")

    for part in ("scan_id < 3", "scan_id between 3 and 7", "scan_id > 7 or scan_id = 2 and run_id = 1"):
        run(spark, folder, rows.where(part), make)
    got = spark.read.schema(TRAILS).parquet(f"{folder}/out").collect()
    late = [(r.run_id, r.scan_id) for r in got if r.pulse is None]
    assert late == [(1, 2)]
    columns = ("run_id", "scan_id", "pulse", "col", "value", "age")
    want = trails_last_n(samples, scans, 4).collect()
    assert sorted((*(r[c] for c in columns), round(r.faded, 6)) for r in got if r.pulse is not None) == sorted((*(r[c] for c in columns), round(r.faded, 6)) for r in want)
    state = spark.read.format("statestore").option("stateVarName", "ring").load(f"{folder}/state").select("key.run_id", F.size("user_map_value.flat").alias("n")).collect()
    assert len(state) <= 2 * 4 and max(r.n for r in state) <= 3 * 25, "the last scans' hits and no more"


def test_a_silent_run_is_forgotten(spark):
    samples, scans = tables(spark)
    rows, folder = hit_rows(samples, scans), tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def make(stream):
        return stream_trails(stream, 4, idle_s=60.0).writeStream.format("parquet").option("path", f"{folder}/out")

    run(spark, folder, rows.where("run_id = 1"), make)
    later = rows.where("run_id = 2").withColumn("ts", F.col("ts") + 3600)
    run(spark, folder, later.where("scan_id < 5"), make)
    run(spark, folder, later.where("scan_id >= 5"), make)
    state = spark.read.format("statestore").option("stateVarName", "ring").load(f"{folder}/state").select("key.run_id").distinct().collect()
    assert [r.run_id for r in state] == [2]


def test_a_clutter_map_of_a_stream(spark):
    samples, scans = tables(spark)
    rows, folder = hit_rows(samples, scans), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert sorted(map(tuple, hits_of(rows).collect())) == sorted(map(tuple, samples.drop("score").collect()))
    for part in ("scan_id < 4", "scan_id >= 4"):
        run(spark, folder, rows.where(part), lambda stream: stream_clutter(stream, f"{folder}/map"))
    columns = ["source_id", "angle_class", "pulse", "col", "hits", "n_scans"]
    want = learn_clutter(samples, scans)
    assert sorted(map(tuple, clutter_map(spark, f"{folder}/map").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
