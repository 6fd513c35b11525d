"""Feedback by rounds gives what the fold gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_coupled import LEARN, SHAPE, made, reshaped, tables, zone_table

from skysweep.functions.stored import stored
from skysweep.operators import background as B
from skysweep.plans import rounds as rounds_module
from skysweep.plans.detect import Params, detect, detected
from skysweep.plans.rounds import detected_in_rounds


def both(spark, pulses, scans, groups, **more):
    """The same patches by the fold and by rounds; the rounds, and the scans with blips."""
    patches, _, rounds = detected_in_rounds(pulses, scans, Params.of(groups), **more)
    out = []
    for rows in (detect(pulses, scans, Params.of(groups), **more), patches):
        out.append(sorted((r.source_id, r.run_id, r.scan_id, r.patch_id, r.ns, round(r.x, 6), round(r.area, 6), round(r.perim, 6), r.is_blip) for r in rows.collect()))
    assert out[0] == out[1] and out[0]
    return rounds, {r[2] for r in out[0] if r[-1]}


WIDE = {"samples": (3, -1), "area": (0.0, -1.0), "angular": (0, -1), "radial": (0, -1)}


def test_the_whole_chain_of_filters(spark):
    pulses, scans = tables(spark, made(11))
    clutter = spark.createDataFrame([("r", 0, *SHAPE, r, c, 7, 10) for r in range(24) for c in range(8, 11)], "source_id string, angle_class int, pulses int, samples_per_pulse int, pulse int, col int, hits long, n_scans long")
    groups = {"find": {"learn_scans": LEARN}, "blip": WIDE | {"expression": "max > 0.17 or ns % 2 = 0"}, "zones": {"expressions": {1: "ns < 12"}}, "declutter": {"cutoff": 0.5}}
    rounds, blips = both(spark, pulses, scans.withColumn("angle_class", F.lit(0)), groups, zones=zone_table(spark), clutter=clutter)
    assert rounds[0] == 9 - LEARN and blips


def test_several_runs_noise_and_a_target_that_fills_cells(spark):
    """A target that stays hides all samples of some cells, which keep their statistics; each round has fewer scans than are left, and two runs don't wait for each other."""
    rng = np.random.default_rng(2)
    parts = []
    for run in (0, 1):
        data = rng.integers(90, 130, (14, *SHAPE))
        data[5:12, 4:12, 4:12] += 300 + 100 * run
        data[:, 20, 10] = 5
        pulses, scans = tables(spark, data)
        parts.append((pulses.withColumn("run_id", F.lit(run).cast("long")), scans.withColumn("run_id", F.lit(run).cast("long"))))
    pulses, scans = (a.unionByName(b) for a, b in zip(*parts, strict=True))
    rounds, blips = both(spark, pulses, scans, {"find": {"learn_scans": LEARN, "noise_cutoff": 95}, "blip": WIDE})
    assert rounds[0] == 2 * (14 - LEARN) and len(rounds) < 14 and rounds == sorted(rounds, reverse=True) and blips >= set(range(5, 12))


@pytest.mark.parametrize("restart", [False, True])
def test_runs_that_change_shape_and_restart(spark, restart):
    pulses, scans = reshaped(spark, restart)
    both(spark, pulses, scans, {"find": {"learn_scans": 2}, "blip": WIDE})


def test_nulls_and_nothing_at_all(spark):
    """Null samples are left out in both modes; an empty table gives an empty one."""
    pulses, scans = tables(spark, made())
    some = pulses.withColumn("samples", F.expr("transform(samples, (x, i) -> if((i + pulse + scan_id) % 7 = 0, null, x))"))
    groups = {"find": {"learn_scans": LEARN}, "blip": WIDE}
    both(spark, some, scans, groups)
    assert not detect(pulses.limit(0), scans.limit(0), Params.of({"find": {"in_rounds": True}})).count()


def test_functions_between_the_stages(spark):
    """With rounds, scores and classes are tables also with feedback."""
    pulses, scans = tables(spark, made())
    params = Params.of({"find": {"learn_scans": LEARN, "in_rounds": True}, "blip": WIDE})
    quiet = {"scores": [lambda p: p.withColumn("scores", F.expr("transform(scores, (x, i) -> if(i < 10, 0, x))"))], "classes": [lambda p: p.withColumn("classes", F.expr("transform(classes, x -> if(scan_id = 5, 0, x))"))]}
    runs = detected(pulses, scans, params, stages=quiet)[1].collect()
    assert runs and all(r.col >= 10 and r.scan_id != 5 for r in runs)


def test_statistics_of_rows_that_come_from_a_join_on_the_keys(spark):
    """AQE may make a broadcast join of one by shuffles: the rows of a sequence must still meet in one fold."""
    pulses, _ = tables(spark, np.concatenate([made(3), made(4)]))
    sequence = [*B.RUN, "cell_row"]
    cells = stored(B.cell_row_stats(pulses.unionByName(pulses.withColumn("run_id", F.col("run_id") + 1))).repartition(6, "scan_id"))
    want = sorted(map(tuple, B.ewma_cell_stats(cells, LEARN, absent=True).collect()))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.openCostInBytes": "128m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # each file is a map task
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        got = B.ewma_cell_stats(cells.join(cells.select(*sequence).distinct(), sequence, "left_semi"), LEARN, absent=True)
        assert sorted(map(tuple, got.collect())) == want and want
    finally:
        for k in names:
            spark.conf.unset(k)


def test_a_round_does_only_what_has_changed(spark, monkeypatch):
    """Scans whose runs of hot samples stay are not measured again, and only rows of cells whose statistics are others are scored again."""
    rng = np.random.default_rng(5)
    data = np.where(rng.random((10, *SHAPE)) < 0.5, 95, 105)
    for i in range(4, 10):
        data[i, 4:8, 8:12] += 700
    scored, measured = [], []
    hot, filters = rounds_module.D.hot_runs_of, rounds_module.D.filtered
    monkeypatch.setattr(rounds_module.D, "hot_runs_of", lambda pulses, scans, find, stages, stats, **k: scored.append(stats.count()) or hot(pulses, scans, find, stages, stats, **k))
    monkeypatch.setattr(rounds_module.D, "filtered", lambda runs, scans, *a: measured.append(scans.count()) or filters(runs, scans, *a))
    rounds, blips = both(spark, *tables(spark, data), {"find": {"learn_scans": LEARN}, "blip": WIDE})
    rows = SHAPE[0] // 4
    assert blips == set(range(4, 10)) and rounds[0] == 7 and len(rounds) > 1
    assert scored == [7 * rows, *rounds[1:]]  # of the rows of cells, one has other statistics
    assert measured == [10] and len(measured) < len(scored)
