"""Trails and clutter maps of a stream of scans.

Input: one row per scan: source_id, run_id, scan_id, ts, and hits, an array of (pulse, col, value): the samples of its blips; null or empty for none. Clutter maps also need angle_class, pulses and samples_per_pulse.

Trails keep a ring buffer per (source, run): the hits of the last n scans, one entry a scan at the place scan_id mod n, so that the state doesn't grow with the run and a batch writes only the entries
of its own scans. Clutter maps are folders that operators.cluttermap adds to: a micro-batch that is repeated after a failure replaces what it gave before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from skysweep.operators.cluttermap import update_clutter

SCAN = ["source_id", "run_id", "scan_id"]
TRAILS = "source_id string, run_id long, scan_id long, pulse int, col int, value long, age int, faded double"


def hit_rows(blip_samples: DataFrame, scans: DataFrame) -> DataFrame:
    """Rows of the stream from tables: scans with hits, in (pulse, col) order."""
    hits = blip_samples.groupBy(*SCAN).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("pulse", "int"), ("col", "int"), ("value", "bigint"))]))).alias("hits"))  # one scan
    return scans.join(hits, SCAN, "left")


def hits_of(rows: DataFrame) -> DataFrame:
    """The samples of blips again, from rows of the stream."""
    return rows.select(*SCAN, F.explode("hits").alias("x")).select(*SCAN, "x.pulse", "x.col", "x.value")


def newest(entries: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The newest hit of each slot, from (scan, hits as rows of pulse, col, value): the hits in slot order and their scans. Of hits of a slot in one scan the last counts."""
    entries = sorted(((scan, hits) for scan, hits in entries if len(hits)), key=lambda x: x[0], reverse=True)
    if not entries:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    hits = np.concatenate([x[::-1] for _, x in entries])
    scans = np.repeat([scan for scan, _ in entries], [len(x) for _, x in entries])
    first = np.unique(hits[:, :2], axis=0, return_index=True)[1]
    return hits[first], scans[first]


class Trails(StatefulProcessor):
    """The ring buffer of a run: see the module."""

    def __init__(self, n: int, fadeout: float, idle_s: float | None):
        self.n, self.fadeout, self.idle_s = n, fadeout, idle_s

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, ts double")
        self.ring = handle.getMapState("ring", "place int", "scan_id long, flat array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, ts = self.run.get() if self.run.exists() else (None, 0.0)
        ring = {k[0]: (v[0], np.asarray(v[1], np.int64).reshape(-1, 3)) for k, v in self.ring.iterator()} if self.ring.exists() else {}
        out, changed = [], set()
        for row in pd.concat(list(rows)).sort_values("scan_id").itertuples(index=False):
            scan = int(row.scan_id)
            if last is not None and scan <= last:
                out.append(pd.DataFrame({"scan_id": [scan], "pulse": [None], "col": [None], "value": [None], "age": [None], "faded": [np.nan]}))
                continue
            flat = [] if row.flat is None else row.flat
            ring[scan % self.n] = scan, np.asarray(flat, np.int64).reshape(-1, 3)
            changed.add(scan % self.n)
            last, ts = scan, max(ts, row.ts)
            hits, of = newest([x for x in ring.values() if x[0] > scan - self.n])
            age = scan - of + 1
            out.append(pd.DataFrame({"scan_id": scan, "pulse": hits[:, 0], "col": hits[:, 1], "value": hits[:, 2], "age": age, "faded": hits[:, 2] * np.power(self.fadeout, age)}))
        for place in changed:
            self.ring.updateValue((place,), (ring[place][0], ring[place][1].ravel().tolist()))
        self.run.update((last, float(ts)))
        self._timed(ts)
        for frame in out:
            frame.insert(0, "source_id", key[0])
            frame.insert(1, "run_id", int(key[1]))
            yield frame.astype({"run_id": "int64", "scan_id": "int64", "pulse": "Int32", "col": "Int32", "value": "Int64", "age": "Int32", "faded": "float64"})

    def _timed(self, ts: float) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if self.idle_s:
            self.handle.registerTimer(int((ts + self.idle_s) * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.run.clear()
        self.ring.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_trails(rows: DataFrame, n: int = 20, fadeout: float = 0.85, idle_s: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """What operators.trails.trails_last_n gives, scan by scan. Columns: TRAILS. A scan at or behind the last one of its run is late: it takes no part and shows as a row without a slot. With idle_s, a run's
    state is removed when the watermark, `delay` behind the largest scan time, has passed its last scan by so much. The session needs the RocksDB state store."""
    flat = "flatten(transform(hits, x -> array(cast(x.pulse as bigint), cast(x.col as bigint), cast(x.value as bigint))))"
    own = rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    own = own.selectExpr("source_id", "cast(run_id as bigint) as run_id", "cast(scan_id as bigint) as scan_id", "cast(ts as double) as ts", "event_time", f"{flat} as flat")
    return own.groupBy("source_id", "run_id").transformWithStateInPandas(Trails(n, fadeout, idle_s), TRAILS, "append", "EventTime")


def stream_clutter(rows: DataFrame, path: str) -> DataStreamWriter:
    """A writer that adds each micro-batch to the clutter map at path; the caller sets its checkpoint and trigger and starts it."""

    def add(batch: DataFrame, number: int) -> None:
        update_clutter(path, number, hits_of(batch), batch)

    return rows.writeStream.foreachBatch(add)
