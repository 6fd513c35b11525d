"""A clutter map that is learned in batches."""

import tempfile

import numpy as np

from skysweep.operators.cluttermap import clutter_map, compact, update_clutter
from skysweep.operators.filters import learn_clutter

COLUMNS = ["source_id", "angle_class", "pulses", "samples_per_pulse", "pulse", "col", "hits", "n_scans"]


def made(spark, wider_at=None):
    rng = np.random.default_rng(3)
    scans = [(s, 0, i, a, 2.5 * i, 8, 16 if wider_at is None or i < wider_at else 32) for s in ("a", "b") for i in range(12) for a in (i % 2,)]
    samples = [(s, 0, i, int(p), int(c)) for s, _, i, *_ in scans for p, c in zip(rng.integers(0, 8, 6), rng.integers(0, 16, 6))]
    return spark.createDataFrame(scans, "source_id string, run_id long, scan_id long, angle_class int, ts double, pulses int, samples_per_pulse int"), spark.createDataFrame(samples, "source_id string, run_id long, scan_id long, pulse int, col int")


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_three_batches_one_of_them_twice(spark):
    scans, samples = made(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for batch, cut in ((0, "scan_id < 5"), (1, "scan_id between 5 and 6"), (1, "scan_id between 5 and 6"), (2, "scan_id > 6")):
        update_clutter(path, batch, samples.where(cut), scans.where(cut))
    assert rows_of(clutter_map(spark, path)) == rows_of(learn_clutter(samples, scans))
    compact(spark, path, f"{path}-one", 2)
    assert rows_of(clutter_map(spark, f"{path}-one")) == rows_of(clutter_map(spark, path))
    update_clutter(f"{path}-one", 3, samples.where("scan_id = 3"), scans.where("scan_id = 3"))
    update_clutter(path, 3, samples.where("scan_id = 3"), scans.where("scan_id = 3"))
    assert rows_of(clutter_map(spark, f"{path}-one")) == rows_of(clutter_map(spark, path))


def test_other_dimensions_begin_anew(spark):
    scans, samples = made(spark, wider_at=7)
    want = rows_of(learn_clutter(samples.where("scan_id >= 7"), scans.where("scan_id >= 7")))
    for cuts in (("scan_id < 7", "scan_id between 7 and 8", "scan_id > 8"), ("scan_id < 4", "scan_id between 4 and 8", "scan_id > 8"), ("true",)):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for batch, cut in enumerate(cuts):
            update_clutter(path, batch, samples.where(cut), scans.where(cut))
        assert rows_of(clutter_map(spark, path)) == want


def test_a_batch_without_blips_counts_its_scans(spark):
    scans, samples = made(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    update_clutter(path, 0, samples.where("scan_id < 6"), scans.where("scan_id < 6"))
    update_clutter(path, 1, samples.limit(0), scans.where("scan_id >= 6"))
    assert {r.n_scans for r in clutter_map(spark, path).collect()} == {6}
