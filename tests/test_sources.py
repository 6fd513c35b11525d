"""Sources and sinks end to end, and cases at the edges."""

import tempfile

import pytest

from skysweep.operators import patches as E
from skysweep.operators import tracking as G
from skysweep.operators.filters import for_each_blip
from skysweep.sources import scans as A
from skysweep.sources import sinks as K


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def blips(spark, scan_ids, run=0):
    rows = [("r", run, s, p, 2.5 * s, 1.4, -2.6, 0.0, 5, 12.0, 0.25, 0.5, 2, 3, 9.6, 10.0, True) for s in scan_ids for p in (4, 7)]
    return spark.createDataFrame(rows, "source_id string, run_id long, scan_id long, patch_id int, t double, x double, y double, z double, ns int, area double, int double, max double, aspan int, rspan int, perim double, range double, is_blip boolean")


def test_scans_are_written_and_read_by_run(spark, folder):
    rows = [(s, r, i, p, [i, p]) for s in ("007", "b") for r in (0, 1) for i in range(3) for p in range(2)]
    pulses = spark.createDataFrame(rows, "source_id string, run_id long, scan_id long, pulse int, samples array<int>")
    K.write_scans(pulses, f"{folder}/scans")
    got = A.read_scans(spark, f"{folder}/scans", "007", 1, ["source_id", "scan_id", "pulse", "samples"], pulses.schema)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan
    assert sorted((r.source_id, r.scan_id, r.pulse, r.samples) for r in got.collect()) == [("007", i, p, [i, p]) for i in range(3) for p in range(2)]


def test_blip_numbers_go_on_over_appends(spark, folder):
    for scan_ids, run in (([0, 1], 0), ([2], 0), ([5], 1)):
        K.write_blips_csv(blips(spark, scan_ids, run), f"{folder}/blips")
    got = spark.read.csv(f"{folder}/blips", header=True).collect()
    assert sorted((r.run_id, int(r["blip.no"])) for r in got) == [(0, i) for i in range(1, 7)] + [(1, 1), (1, 2)]
    assert {(r.timestamp, r.x, r.y, r.int) for r in got if r["blip.no"] == "1" and r.run_id == 0} == {("0.000", "1", "-3", "0.250")}


def test_tracks_and_blip_samples_are_written(spark, folder):
    found = blips(spark, [0, 1])
    points = spark.createDataFrame([("r", 0, 1, i, i, 4, None, None, None, None) for i in range(2)], G.POINTS)
    K.write_tracks_csv(points, found, f"{folder}/tracks")
    got = spark.read.csv(f"{folder}/tracks", header=True).collect()
    assert sorted((r["scan.no"], r["track.no"], r["blip.no"], r.date) for r in got) == [("0", "1", "1", "1970/01/01"), ("1", "1", "3", "1970/01/01")]
    samples = spark.createDataFrame([("r", 0, 0, p, 0, c, 9) for p in (4, 5) for c in range(2)], "source_id string, run_id long, scan_id long, patch_id int, pulse int, col int, value int")
    K.write_blip_samples(samples, found, f"{folder}/samples")
    assert sorted(r.patch_id for r in spark.read.parquet(f"{folder}/samples").collect()) == [4, 4]


def test_an_action_sees_each_blip(spark, folder):
    def action(rows):
        with open(f"{folder}/{id(rows)}", "a") as out:
            out.writelines(f"{r.scan_id} {r.patch_id}\n" for r in rows)

    import os

    for_each_blip(blips(spark, [0, 3]), action)
    lines = [x for f in os.listdir(folder) for x in open(f"{folder}/{f}").read().splitlines()]
    assert sorted(lines) == ["0 4", "0 7", "3 4", "3 7"]


def test_samples_of_32_bits(spark):
    packed = spark.createDataFrame([(1, bytes.fromhex("ffffffff80000000"), 2, 32, True, False), (2, None, 2, 32, True, False), (3, b"\x01", 2, 32, True, False), (4, bytes.fromhex("12f0"), 4, 4, True, False)], "k int, blob binary, n int, bits int, big_endian boolean, deflated boolean")
    got = {r.k: r.samples for r in A.unpack_samples(packed, ["k"]).collect()}
    assert got == {1: [2**32 - 1, 2**31], 2: None, 3: None, 4: [1, 2, 15, 0]}


def test_a_simplified_series_stays_within_the_error(spark):
    import math

    points = [(k, float(t), math.sin(t / 7) * 20 + (t * 37 % 11) / 4) for k in (1, 2) for t in range(60)]
    odd = [(3, 0.0, 1.0), (3, 0.0, 1.2), (3, 0.0, 9.0), (3, 1.0, None), (3, 2.0, 9.0), (4, 5.0, 1.0)]
    frame = spark.createDataFrame(points + odd, "k int, t double, s double")
    kept = A.simplify_series(frame, ["k"], 1.5)
    got = {(r.k, r.t, r.s) for r in kept.collect()}
    assert got < set(points + odd) and (3, 1.0, None) not in got and (4, 5.0, 1.0) in got and {(3, 0.0, 1.0), (3, 0.0, 9.0)} <= got
    smooth = frame.where("k < 3")
    errors = {r.k: r.max_error for r in A.approx_error(smooth, kept.where("k < 3"), ["k"]).collect()}
    # by hand: interpolate between the kept points around each point
    for k in (1, 2):
        own = sorted((t, s) for x, t, s in got if x == k)
        worst = 0.0
        for _, t, s in (p for p in points if p[0] == k):
            t1, s1 = max(x for x in own if x[0] <= t)
            t2, s2 = min(x for x in own if x[0] >= t)
            worst = max(worst, abs(s - (s1 if t1 == t2 else s1 + (s2 - s1) * (t - t1) / (t2 - t1))))
        assert errors[k] == pytest.approx(worst) and worst <= 1.5 + 1e-9 and len(own) < 60


def test_patches_by_labels_equal_those_by_scan(spark):
    import random

    rng = random.Random(2)
    rows = sorted({("r", 0, s, p, 3 * c, 2, 0) for s in range(2) for p in range(12) for c in range(8) if rng.random() < 0.5})
    runs = spark.createDataFrame(rows, "source_id string, run_id long, scan_id long, pulse int, col int, length int, run_no int")
    runs = E.hot_runs(E.patch_samples(runs.withColumnRenamed("run_no", "patch_id")).selectExpr("source_id", "run_id", "scan_id", "pulse", "col", "1 as class"))
    scans = spark.createDataFrame([("r", 0, s, 12) for s in range(2)], "source_id string, run_id long, scan_id long, pulses int")
    near = E.run_adjacency(runs, scans, diagonal=True)
    a, b = (sorted((r.scan_id, r.run_no, r.patch_id) for r in E.find_patches(runs, near, m).collect()) for m in ("grouped", "dataframe"))
    assert a == b and len({x[2] for x in a}) > 1


@pytest.mark.parametrize("slope", [3.0, 8.0, 40.0])
def test_a_simplified_series_bounds_the_curve_between_the_points(spark, slope):
    """With a bound on the slope: at every corner that a curve can reach the line stays within the error, but in pieces of a single step; a piece is as long as that allows."""
    import math

    error, points = 2.0, [(float(t), math.sin(t / 9) * 12 + (t * 29 % 7) / 5) for t in range(80)]
    frame = spark.createDataFrame([(1, *p) for p in points], "k int, t double, s double")
    kept = A.simplify_series(frame, ["k"], error, slope)
    at = sorted(points.index((r.t, r.s)) for r in kept.collect())
    assert at[0] == 0 and at[-1] == 79 and len(at) < 70

    def worst(a, b):
        """The largest distance of points and corners from the line from point a to point b."""
        line = lambda t: points[a][1] + (points[b][1] - points[a][1]) * (t - points[a][0]) / (points[b][0] - points[a][0])
        out = [abs(s - line(t)) for t, s in points[a : b + 1]]
        for (t, s), (u, r) in zip(points[a:b], points[a + 1 : b + 1]):
            w = min(abs(r - s) / slope, u - t)
            out += [abs(r - line(t + w)), abs(s - line(u - w))]
        return max(out)

    pieces = list(zip(at, at[1:]))
    assert all(worst(a, b) <= error + 1e-9 for a, b in pieces if b - a > 1)
    assert all(b == 79 or worst(a, b + 1) > error or b - a == 1 for a, b in pieces)
    got = A.approx_error(frame, kept, ["k"], slope).first().max_error
    assert got == pytest.approx(max(worst(a, b) for a, b in pieces))
