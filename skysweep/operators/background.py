"""Background statistics of cells, sample scores and classes.

Pulses are rows (source_id, run_id, scan_id, pulse, samples: an array), samples (source_id, run_id, scan_id, pulse, col, value). A cell is cell_size x cell_size samples (smaller at the edges). Means and deviations are integers; divisions
round to the nearest. Keys: the columns that name a scan sequence; add angle_class or epoch to them to keep separate statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = ["source_id", "run_id"]
CELL = ["cell_row", "cell_col"]
#: Classes of samples.
COLD, HOT, BLIP, OTHER, EXCLUDED = range(5)
#: Fixed-point parts of a score, and the range of a score.
UNIT, LOWEST, HIGHEST = 256, -32768, 32767


def rounded(x: str, y: str) -> str:
    """Integer quotient of non-negative numbers, rounded to the nearest."""
    return f"(({x} + {y} div 2) div {y})"


def noise_filter(pulses: DataFrame, cutoff: int) -> DataFrame:
    """Samples below the cutoff become 0."""
    return pulses.withColumn("samples", F.transform("samples", lambda x: F.when(x < cutoff, 0).otherwise(x)))


def in_cells(samples: DataFrame, size: int = 4) -> DataFrame:
    return samples.withColumns({"cell_row": F.expr(f"pulse div {size}"), "cell_col": F.expr(f"col div {size}")})


def scan_cell_stats(samples: DataFrame, size: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Per scan and cell: n, sum, mean, dev_sum (sum of distances from the rounded mean). One shuffle: a cell's values, at most size squared, are gathered."""
    by = [*(keys or RUN), "scan_id", *CELL]
    cells = in_cells(samples, size).groupBy(*by).agg(F.collect_list(F.col("value").cast("bigint")).alias("v"))
    cells = cells.withColumn("n", F.size("v").cast("bigint")).withColumn("sum", F.expr("aggregate(v, 0L, (a, x) -> a + x)")).withColumn("mean", F.expr(rounded("sum", "n")))
    return cells.withColumn("dev_sum", F.expr("aggregate(v, 0L, (a, x) -> a + abs(x - mean))")).select(*by, "n", "sum", "mean", "dev_sum")


def cell_row_stats(pulses: DataFrame, size: int = 4, keys: list[str] | None = None) -> DataFrame:
    """The same from pulses (samples arrays), one row per scan and row of cells: n, sum, mean, dev_sum are arrays by cell_col. A null sample is left out; a cell without
    samples has n 0 and a null mean. The one shuffle moves whole pulses, at most `size` to a row."""
    by = [*(keys or RUN), "scan_id", "cell_row"]
    rows = pulses.withColumn("cell_row", F.expr(f"pulse div {size}")).groupBy(*by).agg(F.collect_list("samples").alias("_rows"))
    cells = f"sequence(0, (greatest(1, array_max(transform(_rows, r -> size(r)))) - 1) div {size})"
    rows = rows.withColumn("_v", F.expr(f"transform({cells}, c -> filter(flatten(transform(_rows, r -> slice(r, c * {size} + 1, {size}))), x -> x is not null))"))
    rows = rows.withColumns({"n": F.expr("transform(_v, a -> cast(size(a) as bigint))"), "sum": F.expr("transform(_v, a -> aggregate(a, 0L, (s, x) -> s + x))")})
    rows = rows.withColumn("mean", F.expr(f"zip_with(sum, n, (s, m) -> if(m = 0, null, {rounded('s', 'm')}))"))
    return rows.withColumn("dev_sum", F.expr("zip_with(_v, mean, (a, m) -> aggregate(a, 0L, (s, x) -> s + abs(x - m)))")).select(*by, "n", "sum", "mean", "dev_sum")


def cells_of(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of cells with arrays by cell_col as one row a cell; cells without a mean are left out."""
    keep = [c for c in rows.columns if c not in columns]
    return rows.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("cell_col", "_x")).where("_x.mean is not null").select(*keep, "cell_col", *[F.col(f"_x.{c}").alias(c) for c in columns])


def scan_cell_stats_excluding(samples: DataFrame, size: int = 4, keys: list[str] | None = None) -> DataFrame:
    """The same over the samples whose class isn't BLIP. Cells without any are left out: they keep their old statistics."""
    return scan_cell_stats(samples.where(F.col("class") != BLIP), size, keys)


def learn_cell_stats(cells: DataFrame, learn: int, keys: list[str] | None = None) -> DataFrame:
    """Mean and deviation of each cell over the first `learn` scans of each sequence."""
    keys = keys or RUN
    nth = F.dense_rank().over(Window.partitionBy(*keys, *CELL).orderBy("scan_id"))
    first = cells.withColumn("_nth", nth).where(f"_nth <= {learn}")
    sums = first.groupBy(*keys, *CELL).agg(F.sum("sum").alias("s"), F.sum("n").alias("m"), F.sum("dev_sum").alias("d"), F.sum(F.col("n") - 1).alias("m1"))
    return sums.withColumn("mean", F.expr(rounded("s", "m"))).withColumn("dev", F.expr(f"case when m1 > 0 then {rounded('d', 'm1')} else 0L end")).drop("s", "m", "d", "m1")


def ewma_step(old: int, new: int, k1: int) -> int:
    return (k1 * old + (4096 - k1) * new + 2048) >> 12


class Learner:
    """Statistics of a grid of cells, scan after scan. The grid grows with the largest scan; a cell that comes late learns from its own first scans, one that is
    absent keeps its statistics."""

    def __init__(self, learn: int, k1: int):
        self.learn, self.k1 = learn, k1
        self.state = np.zeros((7, 0, 0), np.int64)  # scans seen, mean, dev; while learning the sums of values, samples, distances and samples less one

    def before(self, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means and deviations of the first rows and cols of cells, and whether there are any yet."""
        had = self.state.shape
        if rows > had[1] or cols > had[2]:
            self.state = np.pad(self.state, ((0, 0), (0, max(0, rows - had[1])), (0, max(0, cols - had[2]))))
        seen, mean, dev = self.state[:3, :rows, :cols]
        return mean.copy(), dev.copy(), seen >= self.learn

    def step(self, n: np.ndarray, total: np.ndarray, mean: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes a scan's cells (rows by cols); the means and deviations valid before it, and whether there are any."""
        *before, valid = self.before(*n.shape)
        seen, old, dev, *sums = self.state[:, : n.shape[0], : n.shape[1]]
        valid = valid & (n > 0)
        old[valid] = ewma_step(old[valid], mean[valid], self.k1)
        more = valid & (n > 1)
        dev[more] = ewma_step(dev[more], (distance[more] + (n[more] - 1) // 2) // (n[more] - 1), self.k1)
        new = (seen < self.learn) & (n > 0)
        for x, y in zip(sums, (total, n, distance, n - 1), strict=True):
            x[new] += y[new]
        seen[n > 0] += 1
        done = new & (seen == self.learn)
        value, count, spread, less = (x[done] for x in sums)
        old[done] = (value + count // 2) // count
        dev[done] = np.where(less > 0, (spread + less // 2) // np.maximum(less, 1), 0)
        return *before, valid


def ewma_cell_stats(rows: DataFrame, learn: int, decay: float = 0.95, keys: list[str] | None = None, absent: bool = False) -> DataFrame:
    """Statistics valid before each scan, from cell_row_stats: those of the first `learn` scans, then fixed-point exponentially weighted. Rows: keys, cell_row, scan_id, and mean and dev
    as arrays by cell_col, null for cells that have none yet. A row of cells is read scan by scan, its cells together; cells without samples in a scan keep
    their statistics, which that scan shows only with absent."""
    by, k1 = [*(keys or RUN), "cell_row"], int(decay * 4096)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, learner = None, None
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            sizes = batch.column("n").value_lengths().to_numpy()
            flat = [batch.column(c).flatten().fill_null(0).to_numpy() for c in ("n", "sum", "mean", "dev_sum")]
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            means, devs, valid = (np.zeros(cuts[-1], k) for k in (np.int64, np.int64, bool))
            for key, a, b in zip(own, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if key != now:
                    now, learner = key, Learner(learn, k1)
                known = learner.before(1, b - a)[2][0]
                means[a:b], devs[a:b], there = (x[0] for x in learner.step(*(x[None, a:b] for x in flat)))
                valid[a:b] = known if absent else there
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64(), mask=~valid)) for x in (means, devs)]
            some = np.logical_or.reduceat(valid, cuts[:-1]) if len(sizes) else np.zeros(0, bool)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "scan_id")), *lists], names=[*by, "scan_id", "mean", "dev"])
            yield out.filter(pa.array(some))

    schema = T.StructType([*rows.select(*by, "scan_id").schema, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("mean", "dev"))])
    # by a hash of the keys: after a join on the keys themselves Spark leaves a repartition by them out, and AQE may then read the join's shuffle by its map tasks, which cuts the folds
    return rows.select(*by, "scan_id", "n", "sum", "mean", "dev_sum").repartition(F.xxhash64(*by)).sortWithinPartitions(*by, "scan_id").mapInArrow(fold, schema)


def sequences(scans: DataFrame) -> tuple[DataFrame, list[str]]:
    """Each scan with the keys of the sequence that it learns in, and the names of these keys: source_id, run_id, angle_class if scans has it, and epoch (the run's restarts so far) if scans has restart.
    Scans of other shapes don't cut a sequence: cells are known by row and column."""
    keys = [*RUN, *(["angle_class"] if "angle_class" in scans.columns else []), *(["epoch"] if "restart" in scans.columns else [])]
    return (learning_epochs(scans) if "restart" in scans.columns else scans).select(*keys, "scan_id"), keys


def restart_at_new_shapes(scans: DataFrame) -> DataFrame:
    """scans with restart, also where a scan has other pulses or samples_per_pulse than the run's scan before: for radars whose cells then lie elsewhere."""
    shape = F.struct("pulses", "samples_per_pulse")
    changed = F.coalesce(shape != F.lag(shape).over(Window.partitionBy(*RUN).orderBy("scan_id")), F.lit(False))
    return scans.withColumn("restart", changed | F.coalesce("restart", F.lit(False)) if "restart" in scans.columns else changed)


def learning_epochs(scans: DataFrame, flag: str = "restart") -> DataFrame:
    """Adds epoch: it rises at each scan of a run that restarts the learning."""
    return scans.withColumn("epoch", F.sum(F.col(flag).cast("bigint")).over(Window.partitionBy(*RUN).orderBy("scan_id").rowsBetween(Window.unboundedPreceding, 0)))


def score(value: str = "value", mean: str = "mean", dev: str = "dev") -> str:
    """Fixed-point score of value against mean and dev: truncated, saturated; without deviation by sign; null without statistics."""
    return (
        f"cast(case when {dev} = 0 then case when {value} > {mean} then {HIGHEST} when {value} < {mean} then {LOWEST} else 0 end "
        f"else greatest({LOWEST}L, least({HIGHEST}L, (({value} - {mean}) * {UNIT}L) div {dev})) end as int)"
    )


def scores_of(values: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """The same for arrays of whole numbers."""
    off = (values - mean) * UNIT
    spread = np.where(dev == 0, np.sign(off) * (HIGHEST + 1), np.sign(off) * (np.abs(off) // np.maximum(dev, 1)))
    return np.clip(spread, LOWEST, HIGHEST)


def flat_scores(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pulses with samples and the statistics _mean, _dev of their row of cells: the samples of all pulses one after another, their scores, whether
    they have one, and where each pulse begins and ends."""
    lists = batch.column("samples")
    cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = lists.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    means, devs = (batch.column(c) for c in ("_mean", "_dev"))
    cells = means.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(cells)), np.diff(cuts))
    cell = (np.arange(len(values)) - cuts[row]) // size
    inside = cell < cells[row]
    at = np.where(inside, (np.cumsum(cells) - cells)[row] + cell, 0)
    known, mean, dev = means.flatten(), *(x.flatten().fill_null(0).to_numpy(zero_copy_only=False) for x in (means, devs))
    if not len(mean):
        return values, values, np.zeros(len(values), bool), cuts
    valid = there & inside & known.is_valid().to_numpy(zero_copy_only=False)[at]
    return values, scores_of(values, mean[at], dev[at]), valid, cuts


def with_cell_stats(pulses: DataFrame, stats: DataFrame, size: int = 4) -> DataFrame:
    """pulses with _mean and _dev, the arrays of ewma_cell_stats for their row of cells; pulses without any are left out. Whole pulses meet their statistics, no single samples."""
    by = [*RUN, "scan_id", "cell_row"]
    return pulses.withColumn("cell_row", F.expr(f"pulse div {size}")).join(stats.select(*by, F.col("mean").alias("_mean"), F.col("dev").alias("_dev")), by).drop("cell_row")


def score_samples(pulses: DataFrame, stats: DataFrame, size: int = 4) -> DataFrame:
    """pulses with scores, one for each sample, by the statistics of ewma_cell_stats; null where there are none, and pulses without any are left out."""

    names = pulses.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, scores, valid, cuts = flat_scores(batch, size)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(scores.astype(np.int32), mask=~valid))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "scores"])

    schema = T.StructType([*pulses.schema, T.StructField("scores", T.ArrayType(T.IntegerType()))])
    return with_cell_stats(pulses, stats, size).mapInArrow(add, schema)


def explode_scored(pulses: DataFrame) -> DataFrame:
    """One row per sample that has a score: ..., pulse, col, value, score."""
    keep = [c for c in pulses.columns if c not in ("samples", "scores")]
    rows = pulses.select(*keep, F.posexplode(F.arrays_zip("samples", "scores")).alias("col", "_x"))
    return rows.select(*keep, "col", F.col("_x.samples").alias("value"), F.col("_x.scores").alias("score")).where("score is not null")


def classify_samples(scored: DataFrame, hot: float = 2.5, low: float = -128.0) -> DataFrame:
    """Adds class: HOT at or above hot, or at or below low (in deviations), else COLD."""
    return scored.withColumn("class", F.expr(f"cast(case when score >= {int(hot * UNIT)} or score <= {int(low * UNIT)} then {HOT} else {COLD} end as tinyint)"))


def classify_pulses(scored: DataFrame, hot: float = 2.5, low: float = -128.0) -> DataFrame:
    """Pulses with scores (arrays) with classes, one for each sample; null without a score."""
    return scored.withColumn("classes", F.expr(f"transform(scores, x -> case when x >= {int(hot * UNIT)} or x <= {int(low * UNIT)} then {HOT} when x is not null then {COLD} end)"))


def class_counts(classified: DataFrame) -> DataFrame:
    """Cold and hot samples per scan."""
    return classified.groupBy(*RUN, "scan_id").agg(F.count_if(F.col("class") == COLD).alias("n_cold"), F.count_if(F.col("class") == HOT).alias("n_hot"))


def paint_blips(classified: DataFrame, blip_samples: DataFrame) -> DataFrame:
    """Final classes: BLIP for the samples (source_id, run_id, scan_id, pulse, col) of accepted patches."""
    keys = [*RUN, "scan_id", "pulse", "col"]
    marked = blip_samples.select(*keys).distinct().withColumn("_blip", F.lit(True))
    return classified.join(marked, keys, "left").withColumn("class", F.expr(f"cast(if(_blip, {BLIP}, class) as tinyint)")).drop("_blip")


def cell_lookup(points: DataFrame, scored: DataFrame, stats: DataFrame, size: int = 4) -> DataFrame:
    """Points (source_id, run_id, scan_id, pulse, col) with value, score, and their cell's mean and dev, from ewma_cell_stats."""
    keys = [*RUN, "scan_id", "pulse", "col"]
    found = in_cells(points.select(*keys).join(scored.select(*keys, "value", "score"), keys), size).join(stats.withColumnsRenamed({"mean": "_mean", "dev": "_dev"}), [*RUN, "scan_id", "cell_row"], "left")
    return found.withColumns({c: F.expr(f"get(_{c}, cast(cell_col as int))") for c in ("mean", "dev")}).drop("_mean", "_dev")
