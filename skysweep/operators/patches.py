"""Patches: runs of hot samples, their adjacency, connected patches, and gathering by runs.

Runs are rows (source_id, run_id, scan_id, pulse, col, length, run_no), numbered per scan in (pulse, col) order from 0. A patch has the number of its first run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.functions.stored import dropped, stored
from skysweep.operators.background import HOT, UNIT, flat_scores

SCAN = ["source_id", "run_id", "scan_id"]


def hot_runs(classified: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Maximal runs of hot samples in each pulse. With scans, the samples before the radar (a negative first_sample_dist) are left out."""
    hot = classified.where(F.col("class") == HOT).select(*SCAN, "pulse", "col")
    if scans is not None:
        lead = scans.select(*SCAN, F.expr("cast(greatest(0, floor(-first_sample_dist / sample_dist)) as int)").alias("_skip"))
        hot = hot.join(lead, SCAN).where("col >= _skip").drop("_skip")
    island = F.col("col") - F.row_number().over(Window.partitionBy(*SCAN, "pulse").orderBy("col"))
    runs = hot.withColumn("_i", island).groupBy(*SCAN, "pulse", "_i").agg(F.min("col").alias("col"), F.count("*").cast("int").alias("length")).drop("_i")
    return numbered(runs)


def numbered(runs: DataFrame) -> DataFrame:
    """runs with run_no."""
    return runs.withColumn("run_no", F.row_number().over(Window.partitionBy(*SCAN).orderBy("pulse", "col")) - 1)


def scored_runs(pulses: DataFrame, scans: DataFrame, size: int, hot: float, low: float, number: bool = True) -> DataFrame:
    """The same from pulses that have the statistics of their cells (background.with_cell_stats), with values, the samples of each run: scores and classes stay in
    arrays, and only hot runs become rows. number: with run_no, for which all pulses of a scan must be there."""

    def is_hot(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, scores, valid, cuts = flat_scores(batch, size)
        return values, valid & ((scores >= int(hot * UNIT)) | (scores <= int(low * UNIT))), cuts

    runs = _runs_by(pulses, scans, ["samples", "_mean", "_dev"], is_hot)
    return numbered(runs) if number else runs


def classified_runs(pulses: DataFrame, scans: DataFrame, number: bool = True) -> DataFrame:
    """The same from pulses with classes, an array beside samples."""

    def is_hot(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, classes = batch.column("samples"), batch.column("classes")
        cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        if not lists.value_lengths().equals(classes.value_lengths()):
            raise ValueError("a pulse must have as many classes as samples")
        values, marks = (x.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, classes))
        return values, marks == HOT, cuts

    runs = _runs_by(pulses, scans, ["samples", "classes"], is_hot)
    return numbered(runs) if number else runs


def _runs_by(pulses: DataFrame, scans: DataFrame, columns: list[str], hot_samples: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Runs with their values, not numbered, from pulses; hot_samples gives a batch's samples one after another, which are hot, and where each pulse begins and ends."""
    lead = scans.select(*SCAN, F.expr("cast(greatest(0, floor(-first_sample_dist / sample_dist)) as int)").alias("_skip"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, hot, cuts = hot_samples(batch)
            row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            col = np.arange(len(values)) - cuts[row]
            at = np.flatnonzero(hot & (col >= batch.column("_skip").to_numpy(zero_copy_only=False)[row]))
            first = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(row[at]) > 0))) if len(at) else np.zeros(0, bool)
            starts = at[first]
            bounds = np.append(np.flatnonzero(first), len(at)).astype(np.int32)
            out = {c: batch.column(c).take(pa.array(row[starts])) for c in (*SCAN, "pulse")}
            out |= {"col": pa.array(col[starts], pa.int32()), "length": pa.array(np.diff(bounds), pa.int32()), "values": pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[at], pa.int32()))}
            yield pa.record_batch(out)

    schema = T.StructType([pulses.schema[c] for c in (*SCAN, "pulse")]).add("col", "integer").add("length", "integer").add("values", T.ArrayType(T.IntegerType()))
    return pulses.join(lead, SCAN).select(*SCAN, "pulse", *columns, "_skip").mapInArrow(found, schema)


def run_values(runs: DataFrame) -> DataFrame:
    """One row per sample of runs that have values: patch_id, pulse, col, value."""
    return runs.select(*SCAN, "patch_id", "pulse", F.col("col").alias("_c"), F.posexplode("values").alias("_i", "value")).select(*SCAN, "patch_id", "pulse", F.expr("_c + _i").alias("col"), "value")


def run_adjacency(runs: DataFrame, scans: DataFrame, diagonal: bool = False) -> DataFrame:
    """Pairs of touching runs of neighbouring pulses: a (in one pulse), b (in the next), and the overlap in samples. The last and the first pulse are neighbours unless the scan is
    rectangular (is_rectangular, false if absent)."""
    rect = F.col("is_rectangular") if "is_rectangular" in scans.columns else F.lit(False)
    shape = scans.select(*SCAN, "pulses", rect.alias("_rect"))
    one = runs.join(shape, SCAN).where("pulses > 1")
    one = one.withColumn("_next", F.expr("if(_rect, pulse + 1, pmod(pulse + 1, pulses))")).where("not (pulses = 2 and pulse = 1)")
    a = one.select(*SCAN, F.col("_next").alias("pulse"), F.col("run_no").alias("a"), F.col("col").alias("_ca"), F.col("length").alias("_la"), F.col("pulse").alias("pulse_a"))
    b = runs.select(*SCAN, "pulse", F.col("run_no").alias("b"), F.col("col").alias("_cb"), F.col("length").alias("_lb"))
    touch = a.join(b, [*SCAN, "pulse"]).withColumn("overlap", F.expr("least(_ca + _la, _cb + _lb) - greatest(_ca, _cb)"))
    return touch.where(f"overlap >= {0 if diagonal else 1}").select(*SCAN, "a", "b", "pulse_a", F.col("pulse").alias("pulse_b"), "overlap")


def find_patches(runs: DataFrame, adjacency: DataFrame, method: str = "grouped") -> DataFrame:
    """runs with patch_id: the smallest run number connected to the run.

    grouped: the runs and pairs of one scan (10^3 to 10^4) are joined by union-find in one task per scan. dataframe: smallest labels spread along the pairs, for scans too
    large for that; every round is a join and its result a stored table."""
    if method == "dataframe":
        return _spread(runs, adjacency)
    both = runs.select(*SCAN, F.col("run_no").alias("a"), F.col("run_no").alias("b")).unionByName(adjacency.select(*SCAN, "a", "b"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, types = None, {}, None

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def out() -> pa.RecordBatch:
            numbers = sorted(root)
            labels = [find(x) for x in numbers]
            columns = [*[pa.array([k] * len(numbers), t) for k, t in zip(now, types, strict=True)], pa.array(numbers, pa.int32()), pa.array(labels, pa.int32())]
            return pa.record_batch(columns, names=[*SCAN, "run_no", "patch_id"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in SCAN]
            for *key, a, b in zip(*(batch.column(c).to_pylist() for c in (*SCAN, "a", "b")), strict=True):
                if key != now:
                    if now is not None:
                        yield out()
                    now, root = key, {}
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        if now is not None:
            yield out()

    schema = runs.select(*SCAN, F.lit(0).alias("run_no"), F.lit(0).alias("patch_id")).schema
    found = both.repartition(*SCAN).sortWithinPartitions(*SCAN).mapInArrow(join, schema)
    return runs.join(found, [*SCAN, "run_no"])


def _spread(runs: DataFrame, adjacency: DataFrame) -> DataFrame:
    pairs = stored(adjacency.select(*SCAN, "a", "b").unionByName(adjacency.select(*SCAN, F.col("b").alias("a"), F.col("a").alias("b"))))
    table = stored(runs.select(*SCAN, "run_no", F.col("run_no").alias("patch_id")))
    labels = table
    while True:
        near = pairs.join(labels.withColumnRenamed("run_no", "b"), [*SCAN, "b"]).groupBy(*SCAN, F.col("a").alias("run_no")).agg(F.min("patch_id").alias("_m"))
        new = labels.join(near, [*SCAN, "run_no"], "left").withColumn("_new", F.least("patch_id", "_m"))
        jump = labels.select(*SCAN, F.col("run_no").alias("_new"), F.col("patch_id").alias("_far"))
        new = stored(new.join(jump, [*SCAN, "_new"]).withColumn("_to", F.least("_new", "_far")))
        if new.where("_to <> patch_id").isEmpty():
            dropped(pairs, new)
            return runs.join(labels, [*SCAN, "run_no"])
        dropped(table)
        table = new
        labels = new.select(*SCAN, "run_no", F.col("_to").alias("patch_id"))


def drop_singletons(runs: DataFrame) -> DataFrame:
    """Runs of the patches of more than one sample."""
    sizes = runs.groupBy(*SCAN, "patch_id").agg(F.sum("length").alias("_n")).where("_n > 1").drop("_n")
    return runs.join(sizes, [*SCAN, "patch_id"], "left_semi")


def patch_counts(patches: DataFrame, scans: DataFrame) -> DataFrame:
    """Per scan: patches, blips, hot samples in patches, and the blips of the run up to and with this scan."""
    found = patches.groupBy(*SCAN).agg(F.count("*").alias("n_patches"), F.count_if("is_blip").alias("n_blips"), F.sum("ns").alias("n_samples"))
    rows = scans.select(*SCAN).join(found, SCAN, "left").na.fill(0, ["n_patches", "n_blips", "n_samples"])
    return rows.withColumn("total_blips", F.sum("n_blips").over(Window.partitionBy("source_id", "run_id").orderBy("scan_id")))


def patch_samples(runs: DataFrame, samples_per_pulse: int | None = None) -> DataFrame:
    """One row per sample of each patch: patch_id, pulse, col, and the linear index if samples_per_pulse is given."""
    rows = runs.withColumn("col", F.explode(F.expr("sequence(col, col + length - 1)"))).select(*SCAN, "patch_id", "pulse", "col")
    return rows.withColumn("index", F.expr(f"cast(pulse as bigint) * {samples_per_pulse} + col")) if samples_per_pulse else rows


def patch_at(points: DataFrame, runs: DataFrame) -> DataFrame:
    """The samples of the patch at each point (source_id, run_id, scan_id, at_pulse, at_col), with the patch's place in its scan."""
    ordinal = runs.select(*SCAN, "patch_id").distinct().withColumn("patch_no", F.row_number().over(Window.partitionBy(*SCAN).orderBy("patch_id")))
    here = runs.select(*SCAN, "patch_id", F.col("pulse").alias("at_pulse"), F.col("col").alias("_c"), "length")
    hit = points.join(here, [*SCAN, "at_pulse"]).where("at_col >= _c and at_col < _c + length").drop("_c", "length")
    return hit.join(ordinal, [*SCAN, "patch_id"]).join(patch_samples(runs), [*SCAN, "patch_id"])


def gather_by_runs(pulses: DataFrame, runs: DataFrame) -> DataFrame:
    """The samples of each run, as a slice of its pulse: run_no, values."""
    return runs.join(pulses, [*SCAN, "pulse"]).withColumn("values", F.expr("slice(samples, col + 1, length)")).drop("samples")


def scatter_by_runs(gathered: DataFrame, scans: DataFrame) -> DataFrame:
    """Dense pulses from the values of runs, 0 elsewhere: all pulses of the scans, samples_per_pulse samples each."""
    cells = gathered.select(*SCAN, "pulse", F.expr("explode(transform(values, (v, i) -> struct(col + i as c, v as v)))").alias("x"))
    filled = cells.groupBy(*SCAN, "pulse").agg(F.map_from_entries(F.collect_list("x")).alias("m"))
    every = scans.select(*SCAN, "samples_per_pulse", F.explode(F.expr("sequence(0, pulses - 1)")).alias("pulse"))
    return every.join(filled, [*SCAN, "pulse"], "left").select(*SCAN, "pulse", F.expr("transform(sequence(0, samples_per_pulse - 1), c -> coalesce(m[c], 0))").alias("samples"))
