"""Golden rows of interpolation and pulse geometry."""

import pytest

from skysweep.functions.geometry import beam, interp_state


def test_interpolation(spark):
    points = spark.createDataFrame([(1, 1.0, 10.0, 20.0), (1, 2.5, 15.0, 17.5), (1, 3.0, 22.5, 16.0), (1, 5.0, 27.0, 23.0)], "k int, t double, x double, y double")
    times = spark.createDataFrame([(1, float(t)) for t in range(7)], "k int, at double")
    got = {r["at"]: (r["x"], r["y"]) for r in interp_state(points, times, ["k"], ["x", "y"]).collect()}
    want = {0: (None, None), 1: (10, 20), 2: (13.3333, 18.3333), 3: (22.5, 16), 4: (24.75, 19.5), 5: (27, 23), 6: (None, None)}
    for t, (x, y) in want.items():
        assert got[t] == ((None, None) if x is None else (pytest.approx(x, abs=1e-4), pytest.approx(y, abs=1e-4)))


def test_beam(spark):
    rows = [(i, 200, 1, 0.0, 90.0, 0.0, 30.0) for i in (1, 5, 50, 99, 101, 150)]
    frame = spark.createDataFrame(rows, "pulse int, pulses int, orientation int, bearing_offset double, axis_azimuth double, axis_elevation double, tilt double")
    got = {r.pulse: r for r in beam(frame).collect()}
    want = {50: (90.0, -60.0), 150: (90.0, 60.0), 1: (30.012, -1.559), 99: (149.988, -1.559)}
    for pulse, (azi, elev) in want.items():
        assert got[pulse].azi == pytest.approx(azi, abs=2e-3) and got[pulse].elev == pytest.approx(elev, abs=2e-3)
