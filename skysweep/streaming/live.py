"""Detection and tracking on a live stream of scans, with typed state per (source, run).

Input: one row per scan: source_id, run_id, scan_id, the scan's metadata (as in the table of scans), and values, the pulses' samples one after another. A micro-batch's
scans are taken in order; a scan at or behind the last one of its run is late: it takes no part and is reported. The end of a run is a row with null values: it ends all
tracks and removes the run's state.

State: the run's progress (a value), the statistics by angle class and row of cells (a map), the points that the tracker still looks at (a list; those of the last scans only), the points of
tracks that are still too short to be shown (a list), and the number of points that each open track has settled (a map). A point that the tracker can no longer change is given out at once when its
track is long enough, so that the state doesn't grow with the length of tracks. Detection, filters and trackers are those of the batch jobs, one scan at a time.

Timers run by event time. With the nearest-neighbour tracker a track ends when the watermark, which all runs move on, has passed its last blip by stale_s; with idle_s, a run is over when the watermark has passed its last scan
by so much.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from skysweep.functions.geometry import beam_arrays
from skysweep.operators.background import Learner
from skysweep.operators.onescan import Filters
from skysweep.operators.tracking import MultiFrame, Nearest, max_pair_distance
from skysweep.plans.coupled import META, Detector, meta_columns

#: Rows of the result: the points of tracks that are long enough, and late scans, which have no track. A track is known by its number in its run and by its first point.
POINTS = "source_id string, run_id long, track_id long, first_scan_id long, first_blip_id long, seq long, scan_id long, blip_id long, gain double, vx double, vy double, vz double"
_NAMES = [x.split()[0] for x in POINTS.split(", ")]
_POINT = "frame int, scan_id long, blip_id long, t double, x double, y double, z double, area double, int double, track long, gain double, vx double, vy double, vz double, has_prev boolean, next int"
_POINT_NAMES = [x.split()[0] for x in _POINT.split(", ")]
_PENDING = "track long, first_scan_id long, first_blip_id long, seq long, scan_id long, blip_id long, gain double, vx double, vy double, vz double"
_CELLS = ", ".join(f"{c} array<bigint>" for c in ("seen", "mean", "dev", "s0", "s1", "s2", "s3"))


def _or_none(x: Any, kind: type = float) -> Any:
    return None if x is None or x != x else kind(x)


class Tracker:
    """A tracker whose settled points are given out or held back until their track is long enough."""

    def __init__(self, model: Any, least: int):
        self.model, self.least = model, least
        self.settled: dict[int, tuple[int, int, int]] = {}  # points given out or pending, and the first one's scan and blip
        self.pending: dict[int, list[tuple]] = {}

    def _out(self, track: int, points: list[dict], ended: bool) -> list[tuple]:
        start, *first = self.settled.get(track, (0, points[0]["scan_id"], points[0]["blip_id"]))
        rows = self.pending.pop(track, [])
        for seq, p in enumerate(points, start):
            v = p["v"] if seq and p["v"] is not None else (None,) * 3
            rows.append((track, *first, seq, p["scan_id"], p["blip_id"], p["gain"] if seq else None, *(_or_none(x) for x in v)))
        total = start + len(points)
        if ended:
            self.settled.pop(track, None)
            return rows if total >= self.least else []
        self.settled[track] = (total, *first)
        if total >= self.least:
            return rows
        self.pending[track] = rows
        return []

    def _ends(self, tracks: Iterator[list[dict]]) -> list[tuple]:
        return [row for t in tracks if t for row in self._out(t[0]["track"], t, True)]

    def step(self, points: list[dict]) -> list[tuple]:
        out = self._ends(self.model.step(points))
        return out + self._settle()

    def _settle(self) -> list[tuple]:
        out = []
        for track, points in list(self.model.tracks.items()):
            n = self.model.settled(points)
            if n:
                out += self._out(track, points[:n], False)
                del points[:n]
        return out

    def expire(self, now: float) -> list[tuple]:
        return self._ends(self.model.expire(now)) if hasattr(self.model, "expire") else []

    def end(self) -> list[tuple]:
        return self._ends(self.model.end())


class Live(StatefulProcessor):
    """The stateful operator: see the module."""

    def __init__(self, params: Any, filters: Filters, idle_s: float | None):
        self.params, self.filters, self.idle_s = params, filters, idle_s

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, started long, reach double, ts double, frames array<bigint>")
        self.cells = handle.getMapState("cells", "angle_class int, cell_row int", _CELLS)
        self.window = handle.getListState("window", _POINT)
        self.pending = handle.getListState("pending", _PENDING)
        self.open = handle.getMapState("open", "track long", "settled long, first_scan_id long, first_blip_id long")

    def _model(self, reach: float) -> Any:
        track, mfc = self.params.track, self.params.mfc
        if track.model == "nn":
            return Nearest(track.max_speed_kmh, track.max_change_percent, track.max_turn_rate, track.stale_s)
        return MultiFrame(mfc.frames, mfc.alpha, mfc.epsilon, mfc.min_gain, track.max_speed_kmh, track.max_dist or reach)

    def _loaded(self) -> tuple[Tracker, int | None, float, float]:
        last, started, reach, ts, frames = self.run.get() if self.run.exists() else (None, 0, 0.0, 0.0, [])
        model = self._model(reach or 1.0)
        model.started = started
        tracker = Tracker(model, self.params.track.min_blips)
        points = []
        for row in self.window.get() if self.window.exists() else []:
            r = dict(zip(_POINT_NAMES, row, strict=True))
            p = {c: r[c] for c in ("scan_id", "blip_id", "t", "x", "y", "z", "area", "int", "track", "gain")}
            p |= {"v": None if r["vx"] is None else np.array([r["vx"], r["vy"], r["vz"]]), "next": None, "prev": {} if r["has_prev"] else None, "state": None}
            points.append((r["frame"], p, r["next"]))
        for _, p, following in points:
            if following is not None:
                p["next"] = points[following][1]
        for _, p, _ in points:
            if p["track"] is not None:
                model.tracks.setdefault(p["track"], []).append(p)
        model.restore([[p for f, p, _ in points if f == i] for i in range(len(frames))])
        tracker.settled = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        for row in self.pending.get() if self.pending.exists() else []:
            tracker.pending.setdefault(row[0], []).append(tuple(row))
        return tracker, last, reach, ts

    def _saved(self, tracker: Tracker, last: int, reach: float, ts: float) -> None:
        frames = tracker.model.remembered()
        flat = [p for frame in frames for p in frame]
        index = {id(p): i for i, p in enumerate(flat)}
        rows = []
        for f, frame in enumerate(frames):
            for p in frame:
                v = [None] * 3 if p["v"] is None else [float(x) for x in p["v"]]
                following = p.get("next")
                rows.append((f, int(p["scan_id"]), int(p["blip_id"]), *(float(p[c]) for c in ("t", "x", "y", "z", "area", "int")), p["track"], _or_none(p["gain"]), *v, p.get("prev") is not None, None if following is None else index[id(following)]))
        self.window.put(rows) if rows else self.window.clear()
        held = [row for rows in tracker.pending.values() for row in rows]
        self.pending.put(held) if held else self.pending.clear()
        self.open.clear()
        for track, n in tracker.settled.items():
            self.open.updateValue((track,), n)
        self.run.update((int(last), int(tracker.model.started), float(reach), float(ts), [0] * len(frames)))

    def _detector(self, row: Any, known: dict[int, Detector]) -> Detector:
        """The detector of the scan's angle class; a restart begins anew in all classes."""
        own = int(row.angle_class)
        if row.restart:
            self.cells.clear()
            known.clear()
        if own not in known:
            known[own] = detector = Detector(self.params.find, self.params.blip, self.filters)
            rows = {k[1]: v for k, v in self.cells.iterator() if k[0] == own} if self.cells.exists() else {}
            if rows:
                detector.learner.state = np.array([[list(rows[i][j]) for i in range(len(rows))] for j in range(7)], np.int64)
        return known[own]

    def _scan(self, row: Any, known: dict[int, Detector]) -> list[dict]:
        values = np.asarray(row.values_, np.int64).reshape(int(row.pulses), -1)
        hits = np.asarray(row.hits, np.int64).reshape(values.shape) if row.n_scans == row.n_scans and row.n_scans else None
        meta = {c: getattr(row, c) for c in META}
        _, table, good = self._detector(row, known).step(values, np.ones(values.shape, bool), np.asarray(row.azi), np.asarray(row.elev), meta, hits, int(row.n_scans) if hits is not None else 0)
        at = np.flatnonzero(good)
        return [{"scan_id": int(row.scan_id), "blip_id": int(table["patch_id"][i]), **{c: float(table[c][i]) for c in ("t", "x", "y", "z", "area", "int")}} for i in at]

    def _rows(self, key: tuple, rows: list[tuple], late: list[int] = ()) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *r) for r in rows] + [(*key, None, None, None, None, scan, *[None] * 5) for scan in late], columns=_NAMES)
        return out.astype({c: "Int64" for c in _NAMES[1:8]} | {c: "float64" for c in _NAMES[8:]})

    def _timed(self, tracker: Tracker, ts: float) -> None:
        """One timer a run: the first time at which something of it may end."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        at = [ts + self.idle_s] if self.idle_s else []
        at += [t[-1]["t"] + tracker.model.stale for t in tracker.model.tracks.values() if t] if isinstance(tracker.model, Nearest) else []
        if at:
            self.handle.registerTimer(int(min(at) * 1000) + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        key = (key[0], int(key[1]))
        tracker, last, reach, ts = self._loaded()
        known: dict[int, Detector] = {}
        out, late = [], []
        for row in pd.concat(list(rows)).sort_values("scan_id").itertuples(index=False):
            if row.values_ is None:  # the run's end: nothing of it stays
                out += tracker.end()
                self._forget()
                known.clear()
                tracker, last, reach, ts = self._loaded()
            elif last is not None and row.scan_id <= last:
                late.append(int(row.scan_id))
            else:
                if not reach:
                    reach = tracker.model.max_dist = float(self.params.track.max_dist or row.reach or 1.0)
                out += tracker.step(self._scan(row, known))
                last, ts = row.scan_id, max(ts, row.ts)
        if last is not None:
            for own, detector in known.items():
                state = detector.learner.state
                for i in range(state.shape[1]):
                    self.cells.updateValue((own, i), tuple(state[j, i].tolist() for j in range(7)))
            self._saved(tracker, last, reach, ts)
            self._timed(tracker, ts)
        yield self._rows(key, out, late)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        key, now = (key[0], int(key[1])), timerValues.getCurrentWatermarkInMs() / 1000
        tracker, last, reach, ts = self._loaded()
        if last is None:
            return
        if self.idle_s and ts + self.idle_s <= now:
            out = tracker.end()
            self._forget()
        else:
            out = tracker.expire(now)
            self._saved(tracker, last, reach, ts)
            self._timed(tracker, ts)
        yield self._rows(key, out)

    def _forget(self) -> None:
        for state in (self.run, self.cells, self.window, self.pending, self.open):
            state.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])

    def close(self) -> None:
        pass


def live_rows(pulses: DataFrame, scans: DataFrame) -> DataFrame:
    """Rows of the stream from tables of pulses and scans: a scan's samples one after another."""
    scan = ["source_id", "run_id", "scan_id"]
    values = pulses.groupBy(*scan).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pulse", "samples"))), lambda x: x["samples"])).alias("values"))  # one scan
    return scans.join(values, scan)


def stream_detect_and_track(scans: DataFrame, params: Any, zones: DataFrame | None = None, clutter: DataFrame | None = None, idle_s: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """Points of tracks of a stream of scans, as they settle: those that detect_and_track gives for the same scans. Columns: POINTS. Tracks of fewer than min_blips are left out. A late scan shows as a row of its
    scan_id without a track. The watermark is `delay` behind the largest scan time; a row at or behind it is dropped unseen, so the end of a run is dated after its last scan. zones and clutter are tables. The session needs the RocksDB state store."""
    rows = scans.withColumnRenamed("values", "values_")
    for name, default in (("angle_class", "0"), ("restart", "false")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.expr(default))
    if clutter is not None and params.declutter.enabled:
        shape = ["source_id", "angle_class", "pulses", "samples_per_pulse"]
        maps = clutter.groupBy(*shape).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("pulse * samples_per_pulse + col"), F.col("hits").cast("bigint")))).alias("_m"), F.max("n_scans").alias("n_scans"))
        rows = rows.join(maps.withColumn("hits", F.expr("transform(sequence(0, pulses * samples_per_pulse - 1), c -> coalesce(_m[c], 0L))")).drop("_m"), shape, "left")
    else:
        rows = rows.withColumns({"hits": F.lit(None).cast("array<bigint>"), "n_scans": F.lit(None).cast("bigint")})
    filters = Filters.of(params, scans, zones, clutter is not None)
    rows = beam_arrays(rows).withColumns({"event_time": F.timestamp_seconds("ts"), "reach": max_pair_distance()}).withWatermark("event_time", delay)
    rows = rows.selectExpr("source_id", "cast(run_id as bigint) as run_id", "cast(scan_id as bigint) as scan_id", "values_", "angle_class", "coalesce(restart, false) as restart", "samples_per_pulse", "hits", "n_scans", "azi", "elev", "event_time", *meta_columns(scans), "reach")
    schema = T._parse_datatype_string(POINTS)
    return rows.groupBy("source_id", "run_id").transformWithStateInPandas(Live(params, filters, idle_s), schema, "append", "EventTime")

