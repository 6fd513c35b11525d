"""Tracking in slices gives the points of the fold over whole runs."""

import numpy as np
import pytest

from skysweep.operators.slices import packed, track_in_slices, unpacked
from skysweep.operators.tracking import MultiFrame, Nearest, _track

SCHEMA = "source_id string, run_id long, scan_id long, blip_id long, t double, x double, y double, z double, area double, int double"


def made(n=90, seed=1):
    """Several targets that turn, cross, come and go, and stray blips; one run has a gap, the other scans without blips."""
    rng, rows = np.random.default_rng(seed), []
    for run in range(2):
        for i in range(n):
            if run and 40 <= i < 45:
                continue
            at = [(120 * np.cos(i / 15 + k) + 30 * k, 120 * np.sin(i / 15 + 2 * k), 5.0 * k) for k in range(4) if (i + 11 * k) % 37 > 4]
            at += [tuple(rng.uniform(-200, 200, 3)) for _ in range(rng.integers(0, 3))]
            rows += [("r", run, i, b, 2.5 * i + 0.1 * b, *map(float, p), 20.0 + b, 0.5) for b, p in enumerate(at)]
    return rows


def tracks_of(points):
    out = {}
    for r in points:
        out.setdefault((r.run_id, r.track_id), []).append((r.seq, r.scan_id, r.blip_id, *(None if x is None else round(x, 9) for x in (r.gain, r.vx, r.vy, r.vz))))
    return sorted((run, sorted(points)) for (run, _), points in out.items())


MODELS = {
    "mfc": lambda: MultiFrame(2, min_gain=0.3, max_speed_kmh=200.0, max_dist=500.0),
    "mfc3": lambda: MultiFrame(3, min_gain=0.2, max_speed_kmh=200.0, max_dist=500.0),
    "nn": lambda: Nearest(max_speed_kmh=200.0, max_change_percent=900.0, max_turn_rate=60.0, stale_s=8.0),
}


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("slices", [(20, 8), (16, 1)])
def test_slices_agree_with_the_whole_fold(spark, model, slices):
    blips = spark.createDataFrame(made(), SCHEMA)
    scans = blips.select("source_id", "run_id", "scan_id").distinct()
    points, rounds = track_in_slices(blips, scans, MODELS[model], *slices)
    got, want = tracks_of(points.collect()), tracks_of(_track(blips, scans, MODELS[model]).collect())
    assert got == want and max(len(p) for _, p in want) > slices[0]
    assert rounds[0] == 2 * -(-90 // slices[0]) and sum(rounds[1:]) < 4 * rounds[0]
    if slices[1] == 8:
        assert sum(rounds[1:]) < rounds[0]  # most guesses are right


@pytest.mark.parametrize("model", MODELS)
def test_a_state_comes_back_whole(model):
    rows = [dict(zip([x.split()[0] for x in SCHEMA.split(", ")], r)) for r in made(30)]
    one, other = MODELS[model](), None
    for i in range(30):
        points = [r for r in rows if r["run_id"] == 0 and r["scan_id"] == i]
        list(one.step(points))
        for track in one.tracks.values():
            del track[: one.settled(track)]
        if other is not None:
            list(other.step(points))
            for track in other.tracks.values():
                del track[: other.settled(track)]
            assert packed(one) == packed(other)
        other = MODELS[model]()
        unpacked(other, packed(one))
        assert packed(other) == packed(one)


def test_a_state_goes_to_its_slice_once(spark, monkeypatch):
    """Rows that are folded again don't carry the text of the state that they begin with."""
    from skysweep.operators import slices

    given, folded = [], slices._folded

    def seen(rows, make):
        given.append(rows.where("given is not null").groupBy("run_id", "slice").count().collect())
        return folded(rows, make)

    monkeypatch.setattr(slices, "_folded", seen)
    blips = spark.createDataFrame(made(), SCHEMA)
    points, rounds = track_in_slices(blips, None, MODELS["nn"], 16, 1)
    assert [len(rows) for rows in given] == [0, *rounds[1:]] and len(rounds) > 1
    assert all(r["count"] == 1 for rows in given for r in rows)
    assert tracks_of(points.collect()) == tracks_of(_track(blips, None, MODELS["nn"]).collect())
