"""Queries and their SQL on rows that the driver's small tables don't have."""

import duckdb

from skysweep.plans.tracking_queries import ORACLES, QUERIES


def test_gains_that_are_null_or_out_of_range_have_the_same_log_units_in_sql(spark, tmp_path):
    users = [None, -1, -50, 0, 49, 98, 99, 100, None]
    spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(users)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["g15_gain_log_units"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.execute(ORACLES["g15_gain_log_units"]).fetchall())
    assert got == want
    assert [r[2:] for r in got if r[1] in (0, 2, 8)] == [(None, None)] * 3 and got[1][2:] == (float("-inf"), 0.0) and got[6][2:] == (float("inf"), 1.0)


def test_clutter_is_filtered_with_one_detection(spark, monkeypatch):
    from skysweep.plans import detect, detection_queries

    calls, runs_of = [], detect.runs_of
    monkeypatch.setattr(detect, "runs_of", lambda *a, **k: calls.append(1) or runs_of(*a, **k))
    rows = detection_queries.QUERIES["f17_filter_clutter"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and rows.columns == ["source_id", "run_id", "scan_id", "patch_id", "is_blip"]
