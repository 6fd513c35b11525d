"""Detection with feedback, against a plain loop over cells and samples, and against the lazy plan where there is no feedback."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysweep.operators import background as B
from skysweep.operators.background import cell_row_stats, cells_of, ewma_cell_stats
from skysweep.operators.onescan import Filters
from skysweep.operators.patches import hot_runs, scored_runs
from skysweep.plans.coupled import Detector
from skysweep.plans.detect import Params, detect, detected

SHAPE, SCANS, SIZE, LEARN = (24, 20), 9, 4, 3


def made(seed=3):
    rng = np.random.default_rng(seed)
    out = rng.integers(90, 130, (SCANS, *SHAPE))
    for i in range(SCANS):
        out[i, (5 + i) % 24 : (5 + i) % 24 + 3, 8:12] += 700
        out[i, 15, 3 + i : 6 + i] += 500
        out[i, [0, 23], 14:17] += 600  # across the seam
    return np.minimum(out, 4095)


def tables(spark, data):
    pulses = spark.createDataFrame([("r", 0, i, p, row.tolist()) for i, scan in enumerate(data) for p, row in enumerate(scan)], "source_id string, run_id long, scan_id long, pulse int, samples array<int>")
    meta = [("r", 0, i, SHAPE[0], SHAPE[1], 12, 5.0, 0.0, 0.0, 0.0, 1, 0.0, 90.0, 0.0, 0.0, 2.5 * i, 2500.0) for i in range(len(data))]
    scans = spark.createDataFrame(meta, "source_id string, run_id long, scan_id long, pulses int, samples_per_pulse int, bits_per_sample int, sample_dist double, first_sample_dist double, bearing double, bearing_offset double, orientation int, axis_azimuth double, axis_elevation double, tilt double, elevation double, ts double, duration_ms double")
    return pulses, scans


def by_hand(data, good, k1=3891):
    """Scan by scan: (scan, samples of each patch), and the blips among them: patches whose samples, with their scan, are good."""
    cells = [(r, c) for r in range(0, SHAPE[0], SIZE) for c in range(0, SHAPE[1], SIZE)]
    mean, dev, sums, out = {}, {}, {x: [0, 0, 0, 0] for x in cells}, []
    for i, scan in enumerate(data):
        blip = np.zeros(SHAPE, bool)
        if i >= LEARN:
            hot = set()
            for r in range(SHAPE[0]):
                for c in range(SHAPE[1]):
                    m, d, v = mean[r - r % SIZE, c - c % SIZE], dev[r - r % SIZE, c - c % SIZE], int(scan[r, c])
                    score = (32767 if v > m else -32768 if v < m else 0) if d == 0 else max(-32768, min(32767, int((v - m) * 256 / d)))
                    if score >= 640 or score <= -32768:
                        hot.add((r, c))
            while hot:
                todo, patch = [hot.pop()], set()
                while todo:
                    r, c = todo.pop()
                    patch.add((r, c))
                    for x in (((r + 1) % SHAPE[0], c), ((r - 1) % SHAPE[0], c), (r, c + 1), (r, c - 1)):
                        if x in hot:
                            hot.remove(x)
                            todo.append(x)
                if len(patch) > 1:
                    is_blip = good(patch, scan)
                    out.append((i, len(patch), sum(int(scan[x]) for x in patch), is_blip))
                    for x in patch if is_blip else ():
                        blip[x] = True
        for r, c in cells:
            use = [int(v) for v, b in zip(scan[r : r + SIZE, c : c + SIZE].ravel(), blip[r : r + SIZE, c : c + SIZE].ravel()) if not b]
            if not use:
                continue
            m = (sum(use) + len(use) // 2) // len(use)
            d = sum(abs(v - m) for v in use)
            if i < LEARN:
                sums[r, c] = [a + b for a, b in zip(sums[r, c], (sum(use), len(use), d, len(use) - 1))]
                a, n, b, less = sums[r, c]
                mean[r, c], dev[r, c] = (a + n // 2) // n, (b + less // 2) // less
            else:
                mean[r, c] = (k1 * mean[r, c] + (4096 - k1) * m + 2048) >> 12
                if len(use) > 1:
                    dev[r, c] = (k1 * dev[r, c] + (4096 - k1) * ((d + (len(use) - 1) // 2) // (len(use) - 1)) + 2048) >> 12
    return sorted(out)


def found(spark, data, exclude, least, zones=None, clutter=None, groups=None):
    groups = dict(groups or {})
    params = Params.of({"find": {"learn_scans": LEARN, "exclude_blips": exclude}, "blip": {"samples": (least, -1), "area": (0.0, -1.0), "angular": (0, -1), "radial": (0, -1)} | groups.pop("blip", {})} | groups)
    pulses, scans = tables(spark, data)
    rows = detect(pulses, scans.withColumn("angle_class", F.lit(0)) if clutter is not None else scans, params, zones, clutter).collect()
    return sorted((r.scan_id, r.ns, round(r.int * r.ns * 4095), r.is_blip) for r in rows), {(r.scan_id, r.patch_id): r for r in rows}


@pytest.mark.parametrize("least", [2, 6, 10**6])
def test_feedback_against_a_plain_loop(spark, least):
    data = made()
    assert found(spark, data, True, least)[0] == by_hand(data, lambda patch, scan: len(patch) >= least)


@pytest.mark.parametrize("least", [2, 6])
def test_feedback_by_rounds_against_a_plain_loop(spark, least):
    data = made()
    assert found(spark, data, True, least, groups={"find": {"learn_scans": LEARN, "in_rounds": True}})[0] == by_hand(data, lambda patch, scan: len(patch) >= least)


def test_without_blips_the_fold_is_the_plan(spark):
    """If no patch is a blip, nothing is left out, and both modes give the same patches."""
    data = made(7)
    fold, plan = (found(spark, data, x, 10**6)[1] for x in (True, False))
    assert fold.keys() == plan.keys() and len(fold) > 10
    for k, r in fold.items():
        assert all(r[c] == pytest.approx(plan[k][c]) for c in ("x", "y", "z", "t", "ns", "area", "int", "max", "aspan", "rspan", "perim"))


def test_statistics_of_scans_of_changing_width(spark):
    """A cell that comes late learns from its own first scans; one that is absent keeps its statistics."""
    rows = [("r", 0, i, p, [100 + i + p] * (4 if i in (0, 4) else 8)) for i in range(7) for p in range(4)]
    pulses = spark.createDataFrame(rows, "source_id string, run_id long, scan_id long, pulse int, samples array<int>")
    got = {(r.scan_id, r.cell_col): (r["mean"], r.dev) for r in cells_of(ewma_cell_stats(cell_row_stats(pulses), 2), "mean", "dev").collect()}
    assert set(got) == {(i, 0) for i in range(2, 7)} | {(i, 1) for i in (3, 5, 6)} and got[2, 0] == (102, 1)


def centre(patch, scan):
    """Radius and angle of a patch's centroid: 5 m a sample, 15 degrees a pulse, clockwise from north."""
    weight = sum(int(scan[p]) for p in patch)
    x, y = (sum(5 * (c + 0.5) * f(np.radians(15 * r)) * int(scan[r, c]) for r, c in patch) / weight for f in (np.sin, np.cos))
    return np.hypot(x, y), np.degrees(np.arctan2(x, y)) % 360


def zone_table(spark):
    limits = "samples_min double, samples_max double, area_min double, area_max double, angular_min double, angular_max double, radial_min double, radial_max double"
    rows = [(0, "exclusion", True, 0, 0.0, 200.0, 60.0, 80.0, *[0.0, -1.0] * 4), (1, "field", True, 0, 0.0, 60.0, 140.0, 360.0 - 100, *[6.0, -1.0, 0.0, -1.0, 0.0, -1.0, 0.0, 4.0])]
    return spark.createDataFrame(rows, f"zone_ord int, zone_id string, enabled boolean, segment int, r1 double, r2 double, a_start double, a_extent double, {limits}")


@pytest.mark.parametrize("chain", [("expression",), ("zones",), ("clutter",), ("expression", "zones", "clutter")])
def test_the_whole_chain_of_filters_decides_what_the_statistics_leave_out(spark, chain):
    data = made(11)
    hits = {(r, c): 7 for r in range(24) for c in range(8, 11)}
    clutter = spark.createDataFrame([("r", 0, *SHAPE, r, c, h, 10) for (r, c), h in hits.items()], "source_id string, angle_class int, pulses int, samples_per_pulse int, pulse int, col int, hits long, n_scans long")

    def good(patch, scan):
        out = len(patch) >= 3
        if "expression" in chain:
            out = out and (max(scan[p] for p in patch) / 4095 > 0.17 or len(patch) % 2 == 0)
        if "zones" in chain:
            radius, angle = centre(patch, scan)
            if 60 <= angle <= 140 and radius <= 200:
                out = False
            elif radius <= 60 and (angle >= 140 or angle <= 40):
                out = len(patch) >= 6 and len({c for _, c in patch}) and max(c for _, c in patch) - min(c for _, c in patch) < 4 and len(patch) < 12
        if "clutter" in chain:
            out = out and sum(hits.get(p, 0) for p in patch) / len(patch) < 0.5 * 10
        return bool(out)

    groups = {"blip": {"expression": "max > 0.17 or ns % 2 = 0"}} if "expression" in chain else {}
    if "zones" in chain:
        groups["zones"] = {"expressions": {1: "ns < 12"}}
    groups["declutter"] = {"cutoff": 0.5}
    got = found(spark, data, True, 3, zone_table(spark) if "zones" in chain else None, clutter if "clutter" in chain else None, groups)[0]
    want = by_hand(data, good)
    assert got == want
    assert want != by_hand(data, lambda patch, scan: len(patch) >= 3) and {r[3] for r in want} == {True, False}


def reshaped(spark, restart):
    """A run of 22 scans that gets wider at scan 5, narrower at 11, shorter in pulses at 17, and may restart at scan 14; two angle classes in turn."""
    rng, pulses, scans = np.random.default_rng(4), [], []
    for i in range(22):
        width, height = (16 if 5 <= i < 11 else 8), (8 if i < 17 else 6)
        scan = rng.integers(90, 130, (height, width))
        scan[(i % 4) : (i % 4) + 2, 3:6] += 900
        pulses += [("r", 0, i, p, row.tolist()) for p, row in enumerate(scan)]
        scans.append(("r", 0, i, height, width, 12, 5.0, 0.0, 0.0, 0.0, 1, 0.0, 90.0, 0.0, 0.0, 2.5 * i, 2500.0, i % 2, i == 14))
    p, s = spark.createDataFrame(pulses, "source_id string, run_id long, scan_id long, pulse int, samples array<int>"), spark.createDataFrame(scans, "source_id string, run_id long, scan_id long, pulses int, samples_per_pulse int, bits_per_sample int, sample_dist double, first_sample_dist double, bearing double, bearing_offset double, orientation int, axis_azimuth double, axis_elevation double, tilt double, elevation double, ts double, duration_ms double, angle_class int, restart boolean")
    if restart == "shape":
        return p, B.restart_at_new_shapes(s.drop("restart", "angle_class"))
    return p, s if restart else s.drop("restart", "angle_class")


@pytest.mark.parametrize("restart", [False, True, "shape"])
def test_runs_that_change_shape_and_restart(spark, restart):
    """Both modes cut a run into the same sequences: each learns for itself, so the first scans of each have no patches. Another shape alone cuts nothing."""
    learn = 2
    groups = {"blip": {"samples": (10**6, -1)}}
    pulses, scans = reshaped(spark, restart)
    fold, plan = ({(r.scan_id, r.patch_id, r.ns, round(r.x, 6)) for r in detect(pulses, scans, Params.of({"find": {"learn_scans": learn, "exclude_blips": x}, **groups})).collect()} for x in (True, False))
    assert fold == plan
    begins = {False: [0], True: [0, 14], "shape": [0, 5, 11, 17]}[restart]
    quiet = {i + k for i in begins for k in range(learn * (2 if restart is True else 1))}
    assert {r[0] for r in plan} == set(range(22)) - quiet


def test_a_wider_scan_of_one_sequence(spark):
    """The cells keep their statistics when the grid gets wider, and samples without statistics have no score."""
    params = Params.of({"find": {"learn_scans": 3}})
    detector = Detector(params.find, params.blip, Filters())
    meta = {"pulses": 8, "ts": 0.0, "duration_ms": 1.0, "bits_per_sample": 12, "sample_dist": 5.0, "first_sample_dist": 0.0, "bearing": 0.0, "bearing_offset": 0.0, "elevation": 0.0, "is_rectangular": False}
    scan = np.tile(np.arange(100, 104), (8, 2))
    for width in (8, 8, 8, 16, 16, 16, 16):
        values = np.tile(scan[:, :4], (1, width // 4))
        runs, _, good = detector.step(values, np.ones(values.shape, bool), np.zeros(8), np.zeros(8), meta)
        assert not len(runs) and not len(good)
    values[2, 9:12] = 900
    runs, _, good = detector.step(values, np.ones(values.shape, bool), np.zeros(8), np.zeros(8), meta)
    assert runs[:, :3].tolist() == [[2, 9, 3]] and good.tolist() == [True]


def test_only_hot_runs_become_rows(spark):
    """Without feedback, nothing explodes the samples of a scan: the plan's generators sit on runs."""
    pulses, scans = tables(spark, made())
    stats = B.ewma_cell_stats(cell_row_stats(pulses), LEARN)
    runs = scored_runs(B.with_cell_stats(pulses, stats), scans, 4, 2.5, -128.0)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    one = B.classify_samples(B.explode_scored(B.score_samples(pulses, stats)))
    assert {tuple(r) for r in runs.drop("values").collect()} == {tuple(r) for r in hot_runs(one, scans).select(*runs.drop("values").columns).collect()}


def test_functions_between_the_stages(spark):
    """Scores and classes changed by functions of the user; columns must stay; with feedback pulses and patches can be changed."""
    pulses, scans = tables(spark, made())
    params = Params.of({"find": {"learn_scans": LEARN, "exclude_blips": False}, "blip": {"samples": (3, -1), "area": (0.0, -1.0), "angular": (0, -1), "radial": (0, -1)}})
    plain = {(r.scan_id, r.patch_id): r.ns for r in detect(pulses, scans, params).collect()}
    same = {"scores": [lambda p: p], "classes": [lambda p: p]}
    assert {(r.scan_id, r.patch_id): r.ns for r in detect(pulses, scans, params, stages=same).collect()} == plain
    quiet = {"scores": [lambda p: p.withColumn("scores", F.expr("transform(scores, (x, i) -> if(i < 10, 0, x))"))], "classes": [lambda p: p.withColumn("classes", F.expr("transform(classes, x -> if(scan_id = 5, 0, x))"))]}
    runs = detected(pulses, scans, params, stages=quiet)[1].collect()
    assert runs and all(r.col >= 10 and r.scan_id != 5 for r in runs)
    big = {"patches": [lambda p: p.withColumn("is_blip", F.expr("is_blip and ns > 5")), lambda p: p.where("scan_id > 4")]}
    for exclude in (False, True):
        both = Params.of({"find": {"learn_scans": LEARN, "exclude_blips": exclude}})
        assert all(r.scan_id > 4 and (r.ns > 5 or not r.is_blip) for r in detect(pulses, scans, both, stages=big).collect())
    halved = {"pulses": [lambda p: p.withColumn("samples", F.transform("samples", lambda x: (x / 2).cast("int")))]}
    most = [max(r.max for r in detect(pulses, scans, both, stages=x).collect()) for x in (None, halved)]
    assert most[1] == pytest.approx(most[0] / 2, abs=1e-3)
    for wrong, text in (({"scores": [lambda p: p.drop("pulse")]}, "pulse"), ({"score": []}, "unknown")):
        with pytest.raises(ValueError, match=text):
            detect(pulses, scans, params, stages=wrong)
    with pytest.raises(ValueError, match="feedback"):
        detect(pulses, scans, both, stages=same)
