"""Tracking of long runs in slices of scans, side by side.

Every slice is first folded from a guess: the state that the scans just before it lead to from nothing. Where the state that the slice before hands over is another, the slice is
folded again from that one; rounds go on until all slices agree, so the points are those of the fold over the whole run. Each round settles at least one more slice of a run; as trackers forget
what lies behind their window, most guesses are right. A slice names a track by its oldest point that it knows; the names are then tied together from slice to slice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysweep.functions.stored import dropped, stored
from skysweep.operators.tracking import RUN, spread

_COORDINATES = ("t", "x", "y", "z", "area", "int")
_OUT = "source_id string, run_id long, slice long, kind string, label_scan long, label_blip long, scan_id long, blip_id long, gain double, vx double, vy double, vz double, before string, after string"
_SLICE = [*RUN, "slice"]


def packed(model: Any) -> str:
    """All that the next steps of a tracker depend on, the same text for the same state."""
    frames = model.remembered()
    flat = [p for frame in frames for p in frame]
    at = {id(p): i for i, p in enumerate(flat)}
    points = [(p["scan_id"], p["blip_id"], *(p[c] for c in _COORDINATES), None if p["v"] is None else [float(x) for x in p["v"]], p["gain"], p.get("prev") is not None, p["state"]) for p in flat]
    following = [None if p.get("next") is None else at[id(p["next"])] for p in flat]
    return json.dumps(([len(frame) for frame in frames], points, following, sorted([at[id(p)] for p in track] for track in model.tracks.values())))


def unpacked(model: Any, text: str) -> None:
    """Puts the state into a new tracker."""
    sizes, rows, following, chains = json.loads(text)
    points = [{"scan_id": r[0], "blip_id": r[1], **dict(zip(_COORDINATES, r[2:8], strict=True)), "v": None if r[8] is None else np.array(r[8]), "gain": r[9], "prev": {} if r[10] else None, "state": r[11], "next": None, "track": None} for r in rows]
    for p, i in zip(points, following, strict=True):
        p["next"] = None if i is None else points[i]
    for number, chain in enumerate(chains, 1):
        model.tracks[number] = [points[i] for i in chain]
        for p in model.tracks[number]:
            p["track"] = number
    model.started = len(chains)
    ends = np.cumsum([0, *sizes]).tolist()
    model.restore([points[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])


def _name(p: dict) -> tuple[int, int]:
    return p["scan_id"], p["blip_id"]


def _folded(rows: DataFrame, make: Callable[[], Any]) -> DataFrame:
    """Each slice's points that no later scan can change (point), those that would be left if the run ended with it (rest), the names of its open tracks with the oldest point
    that the next slice knows of each (link), and the states before and after it (state). rows: those of the slice (own) and of the warm-up before it, or a first row with the state given and
    nothing else: states are long texts, so they must not stand in every row."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in _OUT.split(", ")]
    columns = [*_SLICE, "own", "given", "scan_id", "blip_id", *_COORDINATES]

    class Slice:
        def __init__(self, key: tuple, given: str | None):
            self.key, self.model, self.out, self.labels, self.before = key, make(), [], {}, None
            if given is not None:
                unpacked(self.model, given)

        def emit(self, kind: str, track: int, points: list[dict]) -> None:
            label = self.labels.setdefault(track, _name(points[0]))
            for p in points:
                v = (None,) * 3 if p["v"] is None else tuple(float(x) for x in p["v"])
                self.out.append((*self.key, kind, *label, *_name(p), p["gain"], *v, None, None))

        def step(self, own: bool, points: list[dict]) -> None:
            if own and self.before is None:
                self.begin()
            for track in self.model.step(points):
                if own and track:
                    self.emit("point", track[0]["track"], track)
            for number, track in self.model.tracks.items():
                n = self.model.settled(track)
                if own and n:
                    self.emit("point", number, track[:n])
                del track[:n]

        def begin(self) -> None:
            self.before = packed(self.model)
            self.labels = {number: _name(track[0]) for number, track in self.model.tracks.items()}

        def end(self) -> list[tuple]:
            for number, track in self.model.tracks.items():
                label = self.labels.setdefault(number, _name(track[0]))
                self.out.append((*self.key, "link", *label, *_name(track[0]), *[None] * 6))
                self.emit("rest", number, track)
            self.out.append((*self.key, "state", *[None] * 8, self.before, packed(self.model)))
            return self.out

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = scan = own = begun = None
        points: list[dict] = []
        for batch in batches:
            done: list[tuple] = []
            for r in batch.select(columns).to_pylist():
                key = (r["source_id"], r["run_id"], r["slice"])
                if now is None or key != now.key or r["scan_id"] != scan:
                    if now is not None and begun:
                        now.step(own, points)
                    points = []
                if now is None or key != now.key:
                    done += now.end() if now is not None else []
                    now = Slice(key, r["given"])
                scan, own, begun = r["scan_id"], r["own"], r["given"] is None
                if r["blip_id"] is not None:
                    points.append({c: r[c] for c in ("scan_id", "blip_id", *_COORDINATES)})
            yield _batch(done)
        if now is not None:
            now.step(own, points)
            yield _batch(now.end())

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=names)

    return spread(rows.select(*columns), *_SLICE).sortWithinPartitions(*_SLICE, "scan_id", "blip_id").mapInArrow(fold, _OUT)


def track_in_slices(blips: DataFrame, scans: DataFrame | None, make: Callable[[], Any], scans_a_slice: int, warm_up: int) -> tuple[DataFrame, list[int]]:
    """The points of the tracks of a fold over whole runs (columns as those of tracking.POINTS; tracks are numbered by their first points), and how many slices each round has folded.

    Slices begin at scan numbers that scans_a_slice divides; warm_up, the scans that a guess is made from, is less."""
    if not 0 < warm_up < scans_a_slice:
        raise ValueError("the warm-up must be shorter than a slice")
    rows = blips.selectExpr("source_id", *[f"cast({c} as long) as {c}" for c in ("run_id", "scan_id", "blip_id")], *[f"cast({c} as double) as {c}" for c in _COORDINATES])
    if scans is not None:
        rows = rows.unionByName(scans.selectExpr("source_id", "cast(run_id as long) as run_id", "cast(scan_id as long) as scan_id"), allowMissingColumns=True)
    rows = stored(rows.withColumn("slice", F.expr(f"cast(floor(scan_id / {scans_a_slice}) as long)")))
    warm = rows.where(f"scan_id >= (slice + 1) * {scans_a_slice} - {warm_up}").withColumn("slice", F.expr("slice + 1")).join(rows.select(*_SLICE).distinct(), _SLICE, "left_semi")
    none = F.lit(None).cast("string")
    found = stored(_folded(rows.withColumns({"own": F.lit(True), "given": none}).unionByName(warm.withColumns({"own": F.lit(False), "given": none})), make))
    rounds = [found.where("kind = 'state'").count()]
    while True:
        states = found.where("kind = 'state'")
        nth = Window.partitionBy(*RUN).orderBy("slice")
        handed = states.select(*_SLICE, "before", F.coalesce(F.lag("after").over(nth), F.lit(packed(make()))).alias("given"))  # a row a slice
        wrong = stored(handed.where("before <> given").select(*_SLICE, "given"))
        n = wrong.count()
        if not n:
            break
        own = rows.join(wrong.select(*_SLICE), _SLICE, "left_semi").withColumn("given", none).unionByName(wrong, allowMissingColumns=True)
        again = _folded(own.withColumn("own", F.lit(True)), make)
        old, found = found, stored(found.join(wrong.select(*_SLICE), _SLICE, "left_anti").unionByName(again))
        dropped(old, wrong)
        rounds.append(n)
    # the names of one track are tied from slice to slice: every name learns of its first one by doubling steps
    last = found.where("kind = 'state'").groupBy(*RUN).agg(F.max("slice").alias("last"))
    nth = Window.partitionBy(*RUN).orderBy("slice")
    later = found.where("kind = 'state'").select(*_SLICE, F.lead("slice").over(nth).alias("to"))
    links = found.where("kind = 'link'").join(later, _SLICE).where("to is not null")
    first = stored(links.select(*RUN, F.col("to").alias("slice"), F.col("scan_id").alias("label_scan"), F.col("blip_id").alias("label_blip"), F.struct("slice", "label_scan", "label_blip").alias("up")))
    name = [*_SLICE, "label_scan", "label_blip"]
    while True:
        above = first.select(*RUN, F.struct("slice", "label_scan", "label_blip").alias("up"), F.col("up").alias("higher"))
        new = stored(first.join(above, [*RUN, "up"], "left").select(*name, F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")))
        over = new.where("moved").isEmpty()
        dropped(first)
        first = new.drop("moved")
        first._stored_at = new._stored_at
        if over:
            break
    points = found.where("kind = 'point'").unionByName(found.where("kind = 'rest'").join(last, RUN).where("slice = last").drop("last"))
    own = F.struct(F.col("label_scan").alias("scan"), F.col("label_blip").alias("blip"))
    points = points.join(first, name, "left").withColumn("head", F.when(F.col("up").isNull(), own).otherwise(F.struct(F.col("up.label_scan").alias("scan"), F.col("up.label_blip").alias("blip"))))
    tracks = points.select(*RUN, "head").distinct().withColumn("track_id", F.row_number().over(Window.partitionBy(*RUN).orderBy("head")).cast("long"))
    seq = F.row_number().over(Window.partitionBy(*RUN, "head").orderBy("scan_id")) - 1
    numbered = points.withColumn("seq", seq.cast("long")).join(tracks, [*RUN, "head"])
    shown = [F.when(F.col("seq") > 0, F.col(c)).alias(c) for c in ("gain", "vx", "vy", "vz")]
    return numbered.select(*RUN, "track_id", "seq", "scan_id", "blip_id", *shown), rounds
