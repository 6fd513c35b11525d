"""Detection with feedback: statistics leave blips out, so a scan's blips depend on all scans before it.

A fold per sequence of scans (source, run, angle class, epoch: operators.background.sequences) reads pulses in order, holds one scan and the statistics of its cells, and gives the
runs of each scan's patches. The whole chain of filters decides what is left out of the statistics: ranges, expression, zones and clutter map, in this order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.functions.geometry import pulse_table
from skysweep.operators.background import UNIT, Learner, noise_filter, scores_of, sequences
from skysweep.operators.onescan import Filters, labelled_runs, patch_table

SCAN = ["source_id", "run_id", "scan_id"]
#: Fields of a scan that its patches' statistics need.
META = {"pulses": "int", "ts": "double", "duration_ms": "double", "bits_per_sample": "int", "sample_dist": "double", "first_sample_dist": "double", "bearing": "double", "bearing_offset": "double", "elevation": "double", "is_rectangular": "boolean"}
RUNS = {"pulse": pa.int32(), "col": pa.int32(), "length": pa.int32(), "run_no": pa.int32(), "patch_id": pa.int32(), "is_blip": pa.bool_(), "values": pa.list_(pa.int32())}


def meta_columns(scans: DataFrame) -> list[str]:
    """The expressions of META's fields over scans."""
    return [f"cast({c if c in scans.columns else 'false'} as {kind}) as {c}" for c, kind in META.items()]


class Detector:
    """Statistics of one sequence of scans, and the patches of each new scan."""

    def __init__(self, find: Any, blip: Any, filters: Filters):
        self.find, self.blip, self.filters = find, blip, filters
        self.learner = Learner(find.learn_scans, int(find.decay * 4096))

    def step(self, values: np.ndarray, there: np.ndarray, azi: np.ndarray, elev: np.ndarray, meta: dict, hits: np.ndarray | None = None, n_scans: int = 0) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Takes the next scan (pulses x samples, and which of them exist): its runs (pulse, col, length, run_no, patch_id) of patches of more than one sample, the patches' statistics,
        and which patches are blips."""
        if self.find.noise_cutoff:
            values = np.where(values < self.find.noise_cutoff, 0, values)
        size = self.find.cell_size
        shape = tuple(-(-x // size) for x in values.shape)
        cell = (np.arange(values.shape[0]) // size)[:, None] * shape[1] + np.arange(values.shape[1]) // size
        mean, dev, known = (x.ravel() for x in self.learner.before(*shape))
        use, runs, table, good = there, np.zeros((0, 5), np.int64), {"patch_id": np.zeros(0, np.int64)}, np.zeros(0, bool)
        if known.any():
            score = scores_of(values, mean[cell], dev[cell])
            hot = ((score >= int(self.find.hot_score * UNIT)) | (score <= int(self.find.low_score * UNIT))) & known[cell] & there
            found, pairs = labelled_runs(hot, max(0, int(np.floor(-meta["first_sample_dist"] / meta["sample_dist"]))), self.find.diagonal, not meta["is_rectangular"])
            whole = np.bincount(found[:, 3], found[:, 2], len(found) + 1)[found[:, 3]] > 1 if len(found) else np.zeros(0, bool)
            number = np.flatnonzero(whole)
            if len(number):
                place = np.cumsum(whole) - 1
                runs = np.column_stack((found[whole][:, :3], number, found[whole][:, 3]))
                pairs = pairs[whole[pairs[:, 0]]]
                table, samples = patch_table(values, runs[:, [0, 1, 2, 4]], np.column_stack((place[pairs[:, :2]], pairs[:, 2])), azi, elev, meta, self.blip.area_weighting)
                good = self.filters.keep(table, samples, hits, n_scans)
                out = samples[good[samples[:, 0]]]
                use = there.copy()
                use[out[:, 1], out[:, 2]] = False
        at, v = cell[use], values[use]
        cells = shape[0] * shape[1]
        n = np.bincount(at, minlength=cells)
        total = np.bincount(at, v, cells).astype(np.int64)
        middle = (total + n // 2) // np.maximum(n, 1)
        distance = np.bincount(at, np.abs(v - middle[at]), cells).astype(np.int64)
        self.learner.step(*(x.reshape(shape) for x in (n, total, middle, distance)))
        return runs, table, good


def matrix(lists: pa.Array, pulse: np.ndarray, n_pulses: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample arrays of pulses as a matrix, and which of its samples exist."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(pulse.astype(np.int64), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = np.zeros((max(n_pulses, int(row.max(initial=-1)) + 1), max(1, int(sizes.max(initial=0)))), np.int64)
    there = np.zeros(values.shape, bool)
    values[row, col], there[row, col] = flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    return values, there


def with_hits(pulses: DataFrame, scans: DataFrame, clutter: DataFrame) -> DataFrame:
    """pulses with the clutter map's row of their pulse: hits, an array by column, and n_scans; null where the map has nothing."""
    shape = ["source_id", "angle_class", "pulses", "samples_per_pulse"]
    rows = clutter.groupBy(*shape, "pulse").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("hits").cast("bigint")))).alias("_m"), F.max("n_scans").alias("n_scans"))
    rows = rows.withColumn("hits", F.expr("transform(sequence(0, samples_per_pulse - 1), c -> coalesce(_m[c], 0L))")).drop("_m")
    return pulses.join(scans.select(*SCAN, *shape[1:]), SCAN).join(rows, [*shape, "pulse"], "left").drop(*shape[1:])


def coupled_runs(pulses: DataFrame, scans: DataFrame, params: Any, zones: DataFrame | None = None, clutter: DataFrame | None = None) -> DataFrame:
    """Runs of patches (of more than one sample) of all scans after the learning: source_id, run_id, scan_id, pulse, col, length, run_no, patch_id, is_blip (by the whole chain of filters), values (the run's samples)."""
    in_order, keys = sequences(scans)
    geometry = pulse_table(scans).select(*SCAN, "pulse", "azi", "elev")
    own = [c for c in keys if c not in SCAN]
    meta = scans.selectExpr(*SCAN, *meta_columns(scans)).join(in_order, SCAN)
    rows = (noise_filter(pulses, params.find.noise_cutoff) if params.find.noise_cutoff else pulses).select(*SCAN, "pulse", "samples")
    rows = with_hits(rows, scans, clutter) if clutter is not None else rows.withColumns({"hits": F.lit(None).cast("array<bigint>"), "n_scans": F.lit(None).cast("bigint")})
    rows = rows.join(geometry, [*SCAN, "pulse"]).join(meta, SCAN).select(*SCAN, *own, "pulse", "samples", "azi", "elev", "hits", "n_scans", *META)
    find, blip, filters = params.find, params.blip, Filters.of(params, pulses, zones, clutter is not None)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = scan = detector = None
        held: list[pa.RecordBatch] = []

        def scan_done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            first, pulse = {c: whole.column(c)[0].as_py() for c in META}, whole.column("pulse").to_numpy()
            values, there = matrix(whole.column("samples").combine_chunks(), pulse, first["pulses"])
            azi, elev = np.zeros(len(values)), np.zeros(len(values))
            azi[pulse], elev[pulse] = whole.column("azi").to_numpy(), whole.column("elev").to_numpy()
            n_scans = max((x for x in whole.column("n_scans").to_pylist() if x), default=0)
            hits = matrix(whole.column("hits").combine_chunks(), pulse, first["pulses"])[0] if n_scans else None
            runs, table, good = detector.step(values, there, azi, elev, first, hits, n_scans)
            is_blip = np.isin(runs[:, 4], table["patch_id"][good])
            lengths = runs[:, 2]
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            inside = values[np.repeat(runs[:, 0], lengths), np.repeat(runs[:, 1], lengths) + at]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(inside, pa.int32()))
            named = [pa.array([k] * len(runs), t) for k, t in zip((now[0], now[1], scan), types, strict=True)]
            return pa.record_batch([*named, *(pa.array(runs[:, i], pa.int32()) for i in range(5)), pa.array(is_blip), lists], names=[*SCAN, *RUNS])

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "scan_id")), strict=True))
            cuts = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if a == b:
                    continue
                if held and marks[a] != (*now, scan):
                    yield scan_done()
                    held = []
                if marks[a][:-1] != now:
                    now, detector = marks[a][:-1], Detector(find, blip, filters)
                scan = marks[a][-1]
                held.append(batch.slice(a, b - a))
        if held:
            yield scan_done()

    schema = T.StructType([rows.schema[c] for c in SCAN])
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}[f.dataType.simpleString()] for f in schema]
    for c, kind in RUNS.items():
        schema = schema.add(c, T.BooleanType() if kind == pa.bool_() else T.ArrayType(T.IntegerType()) if c == "values" else T.IntegerType())
    return rows.repartition(*keys).sortWithinPartitions(*keys, "scan_id", "pulse").mapInArrow(fold, schema)
