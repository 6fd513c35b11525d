"""The whole job with every group of parameters: what must hold of its blips and tracks, worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F
from test_coupled import LEARN, SHAPE, made, tables, zone_table

from skysweep.plans.detect import Params, detect_and_track

GROUPS = {
    "find": {"learn_scans": LEARN},
    "blip": {"samples": (3, 40), "area": (0.0, -1.0), "angular": (0, -1), "radial": (0, -1), "expression": "max > 0.1"},
    "track": {"model": "mfc", "max_speed_kmh": 200.0, "min_blips": 3, "max_dist": 200.0},
    "mfc": {"frames": 3, "min_gain": 0.0},
    "antenna": {"settings": {"elevation": 25.0}, "override": ("elevation",)},
    "declutter": {"cutoff": 0.5},
    "zones": {"expressions": {1: "ns < 16"}},
}


def test_every_group(spark):
    pulses, scans = tables(spark, made(11))
    cluttered = {(r, c) for r in range(9, 17) for c in range(8, 12)}  # where one target passes
    clutter = spark.createDataFrame([("r", 0, *SHAPE, r, c, 9, 10) for r, c in cluttered], "source_id string, angle_class int, pulses int, samples_per_pulse int, pulse int, col int, hits long, n_scans long")
    patches, points = detect_and_track(pulses, scans.withColumn("angle_class", F.lit(0)), Params.of(GROUPS), zone_table(spark), clutter)
    rows, points = patches.collect(), points.collect()
    blips = {(r.scan_id, r.patch_id): r for r in rows if r.is_blip}
    assert blips and len(blips) < len(rows)
    for r in rows:
        assert r.z == pytest.approx(25), "a level beam from the antenna's height, not the scans'"
    for r in blips.values():
        radius, angle = math.hypot(r.x, r.y), math.degrees(math.atan2(r.x, r.y)) % 360
        assert not (60 <= angle <= 140 and radius <= 200), "nothing in the exclusion zone"
        if radius <= 60 and (angle >= 140 or angle <= 40):
            assert 6 <= r.ns < 16 and r.rspan <= 4
        else:
            assert 3 <= r.ns <= 40 and r.max > 0.1
    passing = [r for r in rows if r.ns == 8]
    assert passing and not any(r.is_blip for r in passing), "clutter: else the zone's limits would keep it"
    assert points and len({(p.scan_id, p.blip_id) for p in points}) == len(points), "a blip is on one track"
    tracks = {}
    for p in sorted(points, key=lambda p: p.seq):
        tracks.setdefault(p.track_id, []).append(p)
    for track in tracks.values():
        assert len(track) >= 3 and [p.seq for p in track] == list(range(len(track)))
        for p, q in zip(track, track[1:]):
            a, b = (blips[x.scan_id, x.blip_id] for x in (p, q))
            assert 1 <= q.scan_id - p.scan_id < 3 and math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) <= 200 / 3.6 * (b.t - a.t) + 1e-6
            assert (q.vx, q.vy) == pytest.approx(((b.x - a.x) / (b.t - a.t), (b.y - a.y) / (b.t - a.t)))


@pytest.mark.parametrize("wrong", [{"finds": {}}, {"find": {"learn": 3}}, {"blip": {"sample": (1, 2)}}, {"track": {"speed": 1.0}}, {"mfc": {"frame": 2}}, {"antenna": {"angle": 1}}, {"declutter": {"cut": 0.1}}, {"zones": {"expression": {}}}])
def test_unknown_names(wrong):
    with pytest.raises(ValueError, match="unknown"):
        Params.of(wrong)


def test_an_unknown_tracker(spark):
    pulses, scans = tables(spark, made()[:1])
    with pytest.raises(ValueError, match="unknown tracker"):
        detect_and_track(pulses, scans, Params.of({"track": {"model": "best"}}))
