"""A stream of scans gives the tracks that the batch job gives, with a state that stays small."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysweep.plans.detect import Params, detect_and_track
from skysweep.streaming.live import POINTS, Tracker, live_rows, stream_detect_and_track
from skysweep.operators.tracking import MultiFrame, Nearest

SCANS = "source_id string, run_id long, scan_id long, pulses int, samples_per_pulse int, bits_per_sample int, sample_dist double, first_sample_dist double, bearing double, bearing_offset double, orientation int, axis_azimuth double, axis_elevation double, tilt double, elevation double, ts double, duration_ms double"
GROUPS = {"find": {"learn_scans": 3}, "blip": {"samples": (4, -1), "area": (0.0, -1.0), "expression": "max > 0.1 and perim * perim / (area * 4 * pi()) < 20"}, "track": {"max_speed_kmh": 400.0, "min_blips": 3, "max_dist": 800.0}, "mfc": {"min_gain": 0.0, "frames": 3}}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def tables(spark, n=12, sources=("a", "b"), pulses=24, samples=20):
    """Two targets a source, one of which isn't there in some scans; radars with tilt, elevation, bearing and an offset."""
    rng, rows, scans = np.random.default_rng(5), [], []
    for k, source in enumerate(sources):
        for i in range(n):
            values = rng.integers(99, 103, (pulses, samples))
            if i >= 3:
                values[(3 + i) % pulses : (3 + i) % pulses + 2, 6:9] = 900
                if i % 5 != 2:
                    values[15 - i % 3 : 17 - i % 3, 12 + i % 4 : 15 + i % 4] = 700 + 10 * i
                values[20, 2:5] = 300 if i % 2 else 100  # too weak for the expression
            rows += [(source, 1, i, p, r.tolist()) for p, r in enumerate(values)]
            scans.append((source, 1, i, pulses, samples, 12, 5.0, 10.0, 30.0 + k, 15.0, 1, 0.0, 90.0, 5.0, 12.0, 1000 + 2.5 * i, 2500.0))
    return spark.createDataFrame(rows, "source_id string, run_id long, scan_id long, pulse int, samples array<int>"), spark.createDataFrame(scans, SCANS)


class Feed:
    """A folder that a stream reads batch by batch; every call goes on from the state of the one before."""

    def __init__(self, spark, params, **more):
        self.spark, self.params, self.more, self.folder = spark, params, more, tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def __call__(self, rows):
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = stream_detect_and_track(self.spark.readStream.schema(rows.schema).parquet(f"{self.folder}/in"), self.params, **self.more)
        query = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.schema(POINTS).parquet(f"{self.folder}/out").collect()


def ends(rows):
    """The end of each run."""
    last = rows.groupBy("source_id", "run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("source_id", "run_id")]), "scan_id").alias("r")).select("source_id", "run_id", "r.*")
    return last.withColumns({"scan_id": F.col("scan_id") + 1, "ts": F.col("ts") + 2.5, "values": F.lit(None).cast("array<int>")}).select(*rows.columns)


def points_of_batch(spark, params, pulses, scans):
    points = detect_and_track(pulses, scans, params)[1].collect()
    first = {(r.source_id, r.run_id, r.track_id): (r.scan_id, r.blip_id) for r in points if r.seq == 0}
    return sorted((r.source_id, r.run_id, *first[r.source_id, r.run_id, r.track_id], r.seq, r.scan_id, r.blip_id, *(None if x is None else round(x, 6) for x in (r.gain, r.vx, r.vy, r.vz))) for r in points)


def points_of_stream(rows):
    return sorted((r.source_id, r.run_id, r.first_scan_id, r.first_blip_id, r.seq, r.scan_id, r.blip_id, *(None if x is None else round(x, 6) for x in (r.gain, r.vx, r.vy, r.vz))) for r in rows if r.track_id is not None)


@pytest.mark.parametrize("model", ["mfc", "nn"])
def test_the_stream_gives_what_the_batch_gives(spark, model):
    params = Params.of(GROUPS | {"track": GROUPS["track"] | {"model": model, "max_change_percent": 900.0, "max_turn_rate": 90.0, "stale_s": 6.0}})
    pulses, scans = tables(spark)
    rows = live_rows(pulses, scans)
    feed = Feed(spark, params)
    for a, b in ((0, 5), (5, 6), (6, 12)):
        feed(rows.where(f"scan_id >= {a} and scan_id < {b}"))
    got = points_of_stream(feed(ends(rows)))
    want = points_of_batch(spark, params, pulses, scans)
    assert got == want and len({r[2:4] for r in want}) >= 2 and max(r[4] for r in want) >= 4


def test_late_scans_and_a_new_beginning(spark):
    """A late scan is reported and takes no part; a run that has ended begins anew."""
    params = Params.of(GROUPS)
    rows = live_rows(*tables(spark, 9, ("a",)))
    feed = Feed(spark, params, delay="1 hour")
    feed(rows.where("scan_id < 6"))
    seen = feed(rows.where("scan_id = 4 or scan_id >= 6"))
    assert [r.scan_id for r in seen if r.track_id is None] == [4]
    done = points_of_stream(feed(ends(rows)))
    assert {r[5] for r in done} == set(range(3, 9))
    again = feed(rows.where("scan_id between 3 and 4"))
    assert [r.scan_id for r in again if r.track_id is None] == [4]  # nothing is late any more


def test_another_run_s_scans_move_the_time_that_ends_a_track(spark):
    """No scan of run a comes any more: its tracks end when b's scans have moved the watermark past their last blips."""
    params = Params.of(GROUPS | {"track": GROUPS["track"] | {"model": "nn", "max_change_percent": 900.0, "max_turn_rate": 90.0, "stale_s": 6.0}})
    rows = live_rows(*tables(spark, 12))
    feed = Feed(spark, params)
    before = feed(rows.where("source_id = 'a' and scan_id < 7"))
    ended = points_of_stream(before)
    feed(rows.where("source_id = 'b' and scan_id < 11").withColumn("ts", F.expr("ts + 30")))
    after = feed(rows.where("source_id = 'b' and scan_id = 11").withColumn("ts", F.expr("ts + 30")))
    points = [r for r in points_of_stream(after) if r[0] == "a"]
    assert {r[5] for r in points} == set(range(3, 7)) and len(points) > len(ended)


def test_a_run_that_is_idle_is_over(spark):
    feed = Feed(spark, Params.of(GROUPS), idle_s=5.0)
    rows = live_rows(*tables(spark, 12))
    feed(rows.where("source_id = 'a' and scan_id < 7"))
    for low, high in ((0, 11), (11, 12)):
        out = feed(rows.where(f"source_id = 'b' and scan_id >= {low} and scan_id < {high}").withColumn("ts", F.expr("ts + 30")))
    assert {r.scan_id for r in out if r.source_id == "a" and r.track_id} == set(range(3, 7))


@pytest.mark.parametrize("model", [MultiFrame(3, min_gain=0.0, max_dist=500.0), Nearest(stale_s=6.0, max_change_percent=900.0)])
def test_the_state_of_a_long_track_is_small(model):
    """A track of a thousand points: nothing but the last ones is held, and all of them come out in order."""
    tracker, out, held = Tracker(model, 3), [], 0
    for i in range(1000):
        out += tracker.step([{"scan_id": i, "blip_id": 0, "t": 2.5 * i, "x": 10.0 * i, "y": 5.0, "z": 0.0, "area": 10.0, "int": 0.5}])
        held = max(held, sum(len(t) for t in model.tracks.values()) + sum(len(x) for x in tracker.pending.values()) + len(tracker.settled))
    out += tracker.end()
    assert held <= 6 and [(r[0], r[3], r[4]) for r in out] == [(1, i, i) for i in range(1000)]
