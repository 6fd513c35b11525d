"""Patches of a single scan on arrays, for folds and stream states that need one scan's blips before the next is read.

The formulas are those of operators.stats and operators.filters; what is computed here for one scan equals what they give for all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from skysweep.functions.predicates import compiled, holds
from skysweep.operators.filters import RANGES

#: Columns of patches, in order.
COLUMNS = ["x", "y", "z", "t", "ns", "area", "int", "max", "aspan", "rspan", "range", "perim"]


def labelled_runs(hot: np.ndarray, skip: int, diagonal: bool, wrap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs of hot samples from the column skip on, as rows (pulse, col, length, patch), patch the first run of those connected; and the touching pairs as rows (a, b, overlap).
    With wrap, the last and the first pulse are neighbours."""
    n_pulses = len(hot)
    edge = np.diff(np.pad(hot[:, skip:].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    pulse, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    start, end = start + skip, end + skip
    first = np.searchsorted(pulse, np.arange(n_pulses + 1))
    root, pairs = list(range(len(pulse))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(pulse)):
        p = int(pulse[i])
        following = p + 1 if p + 1 < n_pulses else 0 if wrap and n_pulses > 2 else None
        if following is None:
            continue
        for j in range(first[following], first[following + 1]):
            overlap = int(min(end[i], end[j]) - max(start[i], start[j]))
            if overlap >= (0 if diagonal else 1):
                pairs.append((i, j, overlap))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    patch = np.array([find(i) for i in range(len(root))], np.int64)
    return np.stack((pulse, start, end - start, patch), 1).astype(np.int64), np.array(pairs, np.int64).reshape(-1, 3)


def patch_table(values: np.ndarray, runs: np.ndarray, pairs: np.ndarray, azi: np.ndarray, elev: np.ndarray, meta: dict, area_weighting: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics of the patches of runs, by their numbers in order (patch_id and COLUMNS), and the samples of the patches as rows (place of the patch, pulse, col)."""
    ids, of = np.unique(runs[:, 3], return_inverse=True)
    n, n_pulses, dist = len(ids), meta["pulses"], meta["sample_dist"]
    sizes = runs[:, 2]
    run = np.repeat(np.arange(len(runs)), sizes)
    col = runs[run, 1] + np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pulse, patch = runs[run, 0], of[run]
    off = meta["first_sample_dist"] / dist
    r, c, v = col + off + 0.5, np.cos(np.radians(elev[pulse])), values[pulse, col]
    w = 2.0 * col + 1 if area_weighting else v.astype(float)
    add = lambda x: np.bincount(patch, x, n)
    weight = add(w)
    with np.errstate(invalid="ignore", divide="ignore"):
        x, y, flat_z = (np.where(weight != 0, dist * add(w * r * s) / weight, np.nan) for s in (np.sin(np.radians(azi[pulse])) * c, np.cos(np.radians(azi[pulse])) * c, np.sin(np.radians(elev[pulse]))))
    turn = (2 * np.pi + np.pi / 2 - np.arctan2(y, x) - np.radians(meta["bearing"] + meta["bearing_offset"])) % (2 * np.pi)
    ns = np.bincount(patch, minlength=n)
    low = lambda a: _least(a, patch, n)
    high = lambda a: -_least(-a, patch, n)
    top = 2.0 ** meta["bits_per_sample"] - 1
    span = high(pulse) - low(pulse) + 1
    used = np.bincount(np.unique(patch * n_pulses + pulse) // n_pulses, minlength=n)
    cr = np.cos(np.radians(elev))
    edges = np.bincount(of, dist * 2 * sizes * cr[runs[:, 0]] + dist * (2 * np.pi / n_pulses) * (2 * (runs[:, 1] + off) + sizes) * cr[runs[:, 0]], n)
    touching = pairs[pairs[:, 2] > 0]
    edges -= np.bincount(of[touching[:, 0]], 2 * dist * touching[:, 2] * cr[runs[touching[:, 1], 0]], n)
    out = {
        "patch_id": ids, "x": x, "y": y, "z": flat_z + meta["elevation"], "t": meta["ts"] + meta["duration_ms"] / 1000 * turn / (2 * np.pi), "ns": ns, "area": np.pi * dist * dist / n_pulses * add(2 * r * c * c),
        "int": add(v) / np.maximum(ns * top, 1e-300), "max": high(v) / top, "aspan": np.where(span == n_pulses, used, span), "rspan": high(col) - low(col) + 1, "range": np.sqrt(x * x + y * y + flat_z * flat_z), "perim": edges,
    }
    return out, np.stack((patch, pulse, col), 1)


def _least(values: np.ndarray, patch: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, patch, values)
    return out


def _inside(value: np.ndarray, low: float, high: float) -> np.ndarray:
    return (value >= low) & ((high < 0) | (value <= high))


@dataclass
class Filters:
    """The whole chain of blip filters, in its order: ranges, expression, zones (which replace the flag of what lies in them), clutter. zones: the enabled segments as dictionaries in order of
    zone_ord; expression and those of zones compiled."""

    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    expression: tuple | None = None
    zones: list[dict] = field(default_factory=list)
    zone_expressions: dict[int, tuple] = field(default_factory=dict)
    clutter_cutoff: float | None = None

    @classmethod
    def of(cls, params: Any, frame: DataFrame, zones: DataFrame | None = None, clutter: bool = False) -> Filters:
        """From the parameters of a job. The zones, drawn by hand, are few; a clutter map comes with the pulses."""
        blip, spark = params.blip, frame.sparkSession
        out = cls()
        if blip.filtering:
            out.ranges = {RANGES[k]: getattr(blip, k) for k in RANGES}
            out.expression = compiled(spark, blip.expression) if blip.expression else None
        if zones is not None and params.zones.enabled:
            out.zones = sorted((r.asDict() for r in zones.collect()), key=lambda z: (z["zone_ord"], z["r1"], z["r2"], z["a_start"]))
            out.zone_expressions = {k: compiled(spark, v) for k, v in params.zones.expressions.items()}
        if clutter and params.declutter.enabled:
            out.clutter_cutoff = params.declutter.cutoff
        return out

    def keep(self, table: dict[str, np.ndarray], samples: np.ndarray, hits: np.ndarray | None = None, n_scans: int = 0) -> np.ndarray:
        """Which patches are blips. hits: the clutter map (pulses by columns), learned from n_scans."""
        n = len(table["patch_id"])
        good = np.ones(n, bool)
        for c, (low, high) in self.ranges.items():
            good &= _inside(table[c], low, high)
        if self.expression is not None:
            good &= holds(self.expression, table, n)
        if self.zones:
            good = self._zoned(good, table)
        if self.clutter_cutoff is not None and hits is not None and n_scans > 0:
            seen = np.where((samples[:, 1] < hits.shape[0]) & (samples[:, 2] < hits.shape[1]), hits[np.minimum(samples[:, 1], hits.shape[0] - 1), np.minimum(samples[:, 2], hits.shape[1] - 1)], 0)
            on_map = np.bincount(samples[:, 0], seen > 0, n) > 0
            good &= ~(on_map & (np.bincount(samples[:, 0], seen, n) / np.maximum(table["ns"], 1) >= self.clutter_cutoff * n_scans))
        return good

    def _zoned(self, good: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
        x, y = table["x"], table["y"]
        r, a = np.sqrt(x * x + y * y), (90 - np.degrees(np.arctan2(y, x))) % 360
        zone = np.full(len(x), -1)
        names = {z["zone_ord"]: z for z in self.zones}
        for z in self.zones:
            if not z["enabled"] or z["r1"] == z["r2"]:
                continue
            end = z["a_start"] + z["a_extent"]
            inside = (r >= min(z["r1"], z["r2"])) & (r <= max(z["r1"], z["r2"])) & ((a >= z["a_start"]) & (a <= end) | (end > 360) & (a <= end - 360))
            zone[inside & (zone < 0)] = z["zone_ord"]
        for number, z in names.items():
            here = zone == number
            if not here.any():
                continue
            own = np.zeros(len(x), bool)
            if z["zone_id"] != "exclusion":
                own = np.logical_and.reduce([_inside(table[c], z[f"{k}_min"], z[f"{k}_max"]) for k, c in RANGES.items()])
            good = np.where(here, own, good)
        for number, tree in self.zone_expressions.items():
            good = good & ((zone != number) | holds(tree, table, len(x)))
        return good
