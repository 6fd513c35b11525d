"""Scan sources: reading, unpacking, catalogue, metadata repair. Scans are rows (source_id, run_id, scan_id, ts, duration_ms, ...)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.functions.geometry import interp_state

RUN = ["source_id", "run_id"]
#: Seconds after the last scan in which a sought time still belongs to its run.
SEEK_TAIL = 5.0


def in_run(*order: str) -> Window:
    return Window.partitionBy(*RUN).orderBy(*(order or ("scan_id",)))


def read_scans(spark: SparkSession, path: str, source_id: str | None = None, run_id: int | None = None, columns: list[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A scan or pulse table, of one source or run if asked for: partitions are pruned and only the columns named are read. Without a schema
    the types of source_id and run_id are guessed from the folders' names."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    return rows.select(*columns) if columns else rows


def stream_scans(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same table as a stream of new files."""
    return spark.readStream.schema(schema).parquet(path)


def unpack_samples(packed: DataFrame, keep: list[str]) -> DataFrame:
    """From blobs (blob, n, bits, big_endian, deflated) to samples: n numbers without sign of 4, 8, 12, 16, 24 or 32 bits, as longs. A null or short blob gives null."""

    def one(blob: bytes | None, n: int, bits: int, big: bool, deflated: bool) -> np.ndarray | None:
        if blob is None:
            return None
        raw = np.frombuffer(zlib.decompress(blob) if deflated else blob, np.uint8)
        if len(raw) * 8 < n * bits:
            return None
        if bits % 8 == 0:
            parts = raw[: n * bits // 8].reshape(n, -1).astype(np.int64)
            return (parts << (8 * (np.arange(bits // 8)[::-1] if big else np.arange(bits // 8)))).sum(1)
        order = "big" if big else "little"
        wide = np.unpackbits(raw, bitorder=order)[: n * bits].reshape(n, bits).astype(np.int64)
        return (wide << (np.arange(bits)[::-1] if big else np.arange(bits))).sum(1)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("blob", "n", "bits", "big_endian", "deflated")), strict=True)
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"samples": pa.array([one(*x) for x in columns], pa.list_(pa.int64()))})

    schema = T.StructType([*packed.select(*keep).schema, T.StructField("samples", T.ArrayType(T.LongType()))])
    return packed.select(*dict.fromkeys([*keep, "blob", "n", "bits", "big_endian", "deflated"])).mapInArrow(unpack, schema)


def explode_samples(pulses: DataFrame) -> DataFrame:
    """One row per sample: ..., pulse, col, value."""
    return pulses.select(*[c for c in pulses.columns if c != "samples"], F.posexplode("samples").alias("col", "value"))


def contents(scans: DataFrame) -> DataFrame:
    """Per run: start, end (the last scan's end), scans, mean duration."""
    return scans.groupBy(*RUN).agg(F.min("ts").alias("start_ts"), F.max(F.expr("ts + duration_ms / 1000")).alias("end_ts"), F.count("*").alias("n_scans"), F.avg("duration_ms").alias("mean_duration_ms"))


def seek_scan(scans: DataFrame, source_id: str, run_id: int, scan_id: int) -> DataFrame:
    """Scans of a run from scan_id on."""
    return scans.where((F.col("source_id") == source_id) & (F.col("run_id") == run_id) & (F.col("scan_id") >= scan_id))


def seek_time(scans: DataFrame, times: DataFrame) -> DataFrame:
    """For each wanted (source_id, wanted): the run that covers it, up to SEEK_TAIL seconds after its end, and its first scan at or after
    that time (the last scan, in the tail)."""
    runs = scans.groupBy(*RUN).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"))
    hit = times.join(runs, "source_id").where(f"wanted >= start_ts and wanted <= last_ts + {SEEK_TAIL}D")
    near = hit.join(scans.select(*RUN, "scan_id", "ts"), RUN).where("ts >= least(wanted, last_ts)")
    return near.groupBy("source_id", "run_id", "wanted").agg(F.min_by("scan_id", "ts").alias("scan_id"))


def first_scan_offsets(scans: DataFrame) -> DataFrame:
    """Scans of a source before each of its runs, plus one."""
    runs = scans.groupBy(*RUN).agg(F.count("*").alias("n_scans"))
    before = Window.partitionBy("source_id").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("first_scan", F.coalesce(F.sum("n_scans").over(before), F.lit(0)) + 1)


def expand_scan_info(scans: DataFrame, fields: list[str]) -> DataFrame:
    """Null fields take the value of the run's first scan."""
    first = Window.partitionBy(*RUN).orderBy("scan_id").rowsBetween(Window.unboundedPreceding, 0)
    return scans.withColumns({c: F.coalesce(F.col(c), F.first(c).over(first)) for c in fields})


def diff_scan_info(scans: DataFrame, fields: list[str]) -> DataFrame:
    """Fields equal to those of the run's first scan become null, but in that scan."""
    first = Window.partitionBy(*RUN).orderBy("scan_id").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.row_number().over(Window.partitionBy(*RUN).orderBy("scan_id"))
    return scans.withColumns({c: F.when((nth > 1) & F.col(c).eqNullSafe(F.first(c).over(first)), None).otherwise(F.col(c)) for c in fields})


def apply_antenna(scans: DataFrame, antennas: DataFrame, fields: list[str]) -> DataFrame:
    """Antenna settings (source_id, <field>, override_<field>), one row a source: they fill what is missing, and replace what is flagged."""
    named = antennas.select("source_id", *[F.col(c).alias(f"_{c}") for c in fields], *[F.col(f"override_{c}").alias(f"_o_{c}") for c in fields])
    joined = scans.join(named, "source_id", "left")
    return joined.withColumns({c: F.when(F.col(f"_o_{c}") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.coalesce(F.col(c), F.col(f"_{c}"))) for c in fields}).select(*scans.columns)


def attach_comments(scans: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments (source_id, entered_ts, comment) go to the source's next scan. Of several before one scan the last wins; it replaces the scan's own."""
    both = scans.select("source_id", "scan_id", F.col("ts").alias("at"), F.lit(None).cast("string").alias("comment")).unionByName(
        comments.select("source_id", F.lit(None).cast("bigint").alias("scan_id"), F.col("entered_ts").alias("at"), "comment")
    )
    # from the end backwards, a scan before the comments of its time: the last scan so far is the next one
    backwards = Window.partitionBy("source_id").orderBy(F.desc("at"), F.col("scan_id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    goes_to = both.withColumn("to", F.last("scan_id", ignorenulls=True).over(backwards)).where("scan_id is null and to is not null")
    last = goes_to.groupBy("source_id", F.col("to").alias("scan_id")).agg(F.max_by("comment", "at").alias("_comment"))
    return scans.join(last, ["source_id", "scan_id"], "left").withColumn("user_comment", F.coalesce("_comment", "user_comment")).select(*scans.columns)


def resolve_timestamp(scans: DataFrame, base_ts: float, default_s: float, sane_after: float = 946684800.0) -> DataFrame:
    """Timestamp: the embedded one if sane, else base plus time of day, else base plus the scan's place in the run times the default duration."""
    place = F.row_number().over(in_run()) - 1
    day = F.lit(base_ts)
    return scans.withColumn("ts", F.coalesce(F.when(F.col("embedded_ts") > sane_after, F.col("embedded_ts")), day + F.col("time_of_day"), day + place * default_s))


def duration_from_next(scans: DataFrame, default_ms: float) -> DataFrame:
    """Duration: to the next scan of the run; the last one gets the default."""
    return scans.withColumn("duration_ms", F.coalesce((F.lead("ts").over(in_run("ts", "scan_id")) - F.col("ts")) * 1000, F.lit(default_ms)))


def repair_durations(scans: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """As duration_from_next, but a run's last scan keeps its duration unless that is more than tolerance off the mean of the others, which it then gets."""
    gap = scans.withColumn("_gap", (F.lead("ts").over(in_run("ts", "scan_id")) - F.col("ts")) * 1000)
    gap = gap.withColumn("_mean", F.avg("_gap").over(Window.partitionBy(*RUN)))
    last = F.when(F.abs(F.col("duration_ms") - F.col("_mean")) > tolerance * F.col("_mean"), F.col("_mean")).otherwise(F.col("duration_ms"))
    return gap.withColumn("duration_ms", F.coalesce("_gap", last)).drop("_gap", "_mean")


def drop_split_scans(scans: DataFrame, zero_ms: float = 2400.0) -> DataFrame:
    """Drops a scan with the next one's timestamp; a duration of 0 becomes zero_ms."""
    following = F.lead("ts").over(in_run("ts", "scan_id"))
    kept = scans.withColumn("_next", following).where("_next is null or _next <> ts").drop("_next")
    return kept.withColumn("duration_ms", F.when(F.col("duration_ms") == 0, F.lit(zero_ms)).otherwise(F.col("duration_ms")))


def mean_antenna_angle(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the angles (angle, t) of each key, each weighted by half the spans to its neighbours; a lone point counts as it is."""
    w = Window.partitionBy(*keys).orderBy("t")
    weight = (F.coalesce(F.lead("t").over(w), F.col("t")) - F.coalesce(F.lag("t").over(w), F.col("t"))) / 2
    rows = points.withColumn("_w", weight)
    return rows.groupBy(*keys).agg(F.when(F.sum("_w") > 0, F.sum(F.col("angle") * F.col("_w")) / F.sum("_w")).otherwise(F.avg("angle")).alias("mean_angle"))


def angle_class(angle: str = "mean_angle") -> Column:
    """The class under which separate statistics are kept: the whole degree, halves to even."""
    return F.bround(F.col(angle), 0).cast("int")


def decode_dbz(code: str) -> Column:
    """Weather code to dBZ; 0 (no data) and 255 (not scanned) are null."""
    return F.expr(f"case when {code} in (0, 255) then null else ({code} - 64) / 2D end")


def sample_to_dbm(sample: str, offset: float = 61.0) -> Column:
    """Sample value to received power in dBm."""
    return F.expr(f"-48.34D + 0.01738D * {sample} - 0.802D * {float(offset)!r}D")


def scale_frames(frames: DataFrame, rate: float, start_ts: float = 0.0) -> DataFrame:
    """Grey frames (8 bits) as scans of 15 bits: samples times 128, time by frame rate, rectangular geometry."""
    return frames.withColumn("samples", F.transform("samples", lambda x: (x * 128).cast("int"))).withColumn("ts", F.expr(f"{start_ts!r}D + frame / {rate!r}D")).withColumn("duration_ms", F.lit(1000.0 / rate)).withColumn("bits_per_sample", F.lit(15)).withColumn("is_rectangular", F.lit(True))


def simplify_series(points: DataFrame, keys: list[str], error: float, slope: float | None = None) -> DataFrame:
    """A subset of the points (t, s) of each key such that linear interpolation stays within error, found greedily: a piece is as long as the cone
    of lines through its first point that pass all its points allows. slope bounds how fast the curve between two points may rise or fall: the line then stays within error of
    all such curves (at the corners that they can reach), but for pieces of a single step, which nothing can improve. Points are read in order, one at a time.
    Points with a null t or s are left out; of points at one time, those further than error from the first begin pieces of their own."""
    names = points.columns

    def cone(base: dict, lo: float, hi: float, at: list[tuple[float, float]]) -> tuple[float, float]:
        """What is left of the slopes (lo, hi) of lines through base that pass the places (t, s) within error."""
        for t, s in at:
            if t > base["t"]:
                lo, hi = max(lo, (s - error - base["s"]) / (t - base["t"])), min(hi, (s + error - base["s"]) / (t - base["t"]))
        return lo, hi

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = base = last = None
        lo, hi = -np.inf, np.inf
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != now:
                    if last is not None and last is not base:
                        out.append(last)
                    now, base, last, lo, hi = key, r, r, -np.inf, np.inf
                    out.append(r)
                    continue
                if last is not base and r["t"] > base["t"]:
                    lo, hi = cone(base, lo, hi, corners(last, r, slope))
                    if not lo <= (r["s"] - base["s"]) / (r["t"] - base["t"]) <= hi:
                        out.append(last)
                        base, lo, hi = last, -np.inf, np.inf
                if r["t"] == base["t"]:  # no line has two values at one time
                    if abs(r["s"] - base["s"]) > error:
                        base, last, lo, hi = r, r, -np.inf, np.inf
                        out.append(r)
                    continue
                if last is base:
                    lo, hi = cone(base, lo, hi, corners(base, r, slope))
                lo, hi = cone(base, lo, hi, [(r["t"], r["s"])])
                last = r
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
            schema = batch.schema
        if last is not None and last is not base:
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    return points.where("t is not null and s is not null").repartition(*keys).sortWithinPartitions(*keys, "t", "s").select(*names).mapInArrow(fold, points.schema)


def corners(a: dict, b: dict, slope: float | None) -> list[tuple[float, float]]:
    """The outermost places (t, s) between two points that a curve of this slope can reach at their levels; none without a bound."""
    if not slope or b["t"] <= a["t"]:
        return []
    width = min(abs(b["s"] - a["s"]) / slope, b["t"] - a["t"])
    return [(a["t"] + width, b["s"]), (b["t"] - width, a["s"])]


def approx_error(points: DataFrame, kept: DataFrame, keys: list[str], slope: float | None = None) -> DataFrame:
    """Per key: the largest distance of points (t, s) from the line through the kept ones around them; with slope, of the corners between them too (see simplify_series)."""
    asked = points.select(*keys, F.col("t").alias("at"), F.col("s").alias("own"))
    if slope:
        w = Window.partitionBy(*keys).orderBy("t", "s")
        steps = points.where("t is not null and s is not null").select(*keys, "t", "s", F.lead("t").over(w).alias("_t"), F.lead("s").over(w).alias("_s")).where("_t > t")
        steps = steps.withColumn("_w", F.expr(f"least(abs(_s - s) / {float(slope)!r}D, _t - t)"))
        asked = asked.unionByName(steps.select(*keys, F.explode(F.expr("array(struct(t + _w as at, _s as own), struct(_t - _w as at, s as own))")).alias("c")).select(*keys, "c.at", "c.own"))
    return interp_state(kept.select(*keys, "t", "s"), asked, keys, ["s"]).groupBy(*keys).agg(F.max(F.abs(F.col("own") - F.col("s"))).alias("max_error"))
