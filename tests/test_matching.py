"""The solver against brute force on small tables."""

import itertools

import numpy as np

from skysweep.operators.matching import best_pairs
from skysweep.operators.tracking import match_adjacent


def brute(gain):
    n, m = gain.shape
    columns = [*range(m), *[-1] * n]
    return max(sum(gain[i, c] for i, c in enumerate(p) if c >= 0) for p in itertools.permutations(columns, n))


def test_total_gain_is_best():
    rng = np.random.default_rng(0)
    for _ in range(120):
        n, m = (int(x) for x in rng.integers(1, 5, 2))
        gain = rng.integers(0, 10, (n, m)) * (rng.random((n, m)) < 0.6)
        pairs = best_pairs(gain)
        assert sum(gain[i, j] for i, j in pairs) == brute(gain)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


def test_zero_is_no_edge():
    assert best_pairs(np.zeros((3, 2))) == []


def test_scans_are_matched_from_blips_not_from_shuffled_pairs(spark):
    """Small Arrow batches cut scans in pieces; the only shuffle is that of the blips, and as many partitions are folded as there are shuffle partitions."""
    rng = np.random.default_rng(4)
    rows = [(s, run, i, b, 2.5 * i + 0.1 * b, *map(float, rng.uniform(-300, 300, 3))) for s in ("a", "b") for run in range(2) for i in (0, 1, 2, 4, 5) for b in range(9)]
    rows += [("a", 0, 1, 9, 2.5, None, 0.0, 0.0), (None, 0, 1, 1, 2.5, 0.0, 0.0, 0.0), ("a", 0, None, 1, 2.5, 0.0, 0.0, 0.0)]
    blips = spark.createDataFrame(rows, "source_id string, run_id long, scan_id long, blip_id long, t double, x double, y double, z double")
    want = []
    for s, run, i in {r[:3] for r in rows if None not in r[:3]}:
        u, v = (sorted((r for r in rows if r[:3] == (s, run, k) and None not in r), key=lambda r: r[3]) for k in (i, i + 1))
        if v:
            dist = [[sum((a - b) ** 2 for a, b in zip(p[5:], q[5:])) ** 0.5 for q in v] for p in u]
            gain = np.array([[int(max(0, 0.5 * (1 - d / 400)) * (2**30 - 1)) if d / (q[4] - p[4]) <= 150 else 0 for q, d in zip(v, row)] for p, row in zip(u, dist)])
            want += [(s, run, i, u[a][3], v[b][3], gain[a, b] / (2**30 - 1)) for a, b in best_pairs(gain)]
    found = match_adjacent(blips, max_dist=400.0, max_speed_kmh=540.0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and found.rdd.getNumPartitions() == 4
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted(tuple(r) for r in found.collect())
            assert [r[:5] for r in got] == [r[:5] for r in sorted(want)] and np.allclose([r[5] for r in got], [r[5] for r in sorted(want)], atol=1e-8)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 60
