"""Sinks: blips and tracks as text, blip samples and scores, raw scans. All write with Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.operators.trails import running_number
from skysweep.sources.scans import sample_to_dbm

SCAN = ["source_id", "run_id", "scan_id"]
# Columns and formats of the text files.
BLIP_COLUMNS = "blip.no,date,time,timestamp,x,y,z,ns,area,int,max,aspan,rspan,perim"
TRACK_COLUMNS = "scan.no,track.no,blip.no,date,time,timestamp,range,x,y,z,ns,area,int,max,aspan,rspan,perim"


def _formats(columns: str) -> list:
    text = {"scan.no": "cast(scan_id as string)", "track.no": "cast(track_id as string)", "blip.no": "cast(blip_no as string)", "date": "date_format(timestamp_micros(cast(t * 1000000 as bigint)), 'yyyy/MM/dd')", "time": "date_format(timestamp_micros(cast(t * 1000000 as bigint)), 'HH:mm:ss')", "timestamp": "format_string('%.3f', t)"}
    text |= {c: f"format_string('%.0f', `{c}`)" for c in ("range", "x", "y", "z", "area", "perim")} | {c: f"format_string('%.3f', {c})" for c in ("int", "max")}
    return [F.expr(text.get(c, f"cast({c} as string)")).alias(c) for c in columns.split(",")]


def format_blips(blips: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The 14 text columns of blips, numbered through each run in (scan, patch) order, after the n_before blips that before (source_id, run_id, n_before) names."""
    rows = running_number(blips, "patch_id")
    if before is not None:
        rows = rows.join(before, ["source_id", "run_id"], "left").withColumn("blip_no", F.expr("blip_no + coalesce(n_before, 0)"))
    return rows.select("source_id", "run_id", *_formats(BLIP_COLUMNS))


def format_tracks(track_points: DataFrame, blips: DataFrame) -> DataFrame:
    """The 17 text columns of track points: blips are joined by (source, run, scan, blip_id = patch_id) and numbered through the run."""
    numbered = running_number(blips, "patch_id").withColumnRenamed("patch_id", "blip_id")
    return track_points.select(*SCAN, "track_id", "blip_id").join(numbered, [*SCAN, "blip_id"]).select("source_id", "run_id", *_formats(TRACK_COLUMNS))


def _written_before(blips: DataFrame, path: str) -> DataFrame | None:
    """Blips of each run that the text files hold; none if there are no files."""
    spark = blips.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at):
        return None
    kinds = ", ".join(f"{c} {blips.schema[c].dataType.simpleString()}" for c in ("source_id", "run_id"))
    columns = ", ".join(f"`{c}` string" for c in BLIP_COLUMNS.split(","))
    rows = spark.read.schema(f"{columns}, {kinds}").csv(path, header=True)
    return rows.groupBy("source_id", "run_id").agg(F.count("*").alias("n_before"))


def write_blips_csv(blips: DataFrame, path: str) -> None:
    """Appends blips to text files by source and run; numbers go on from those there."""
    format_blips(blips, _written_before(blips, path)).write.mode("append").partitionBy("source_id", "run_id").csv(path, header=True)


def write_tracks_csv(track_points: DataFrame, blips: DataFrame, path: str) -> None:
    format_tracks(track_points, blips).write.mode("append").partitionBy("source_id", "run_id").csv(path, header=True)


def blip_sample_rows(samples: DataFrame, blips: DataFrame) -> DataFrame:
    """The samples (patch_id, pulse, col, value[, score]) of blips."""
    return samples.join(blips.select(*SCAN, "patch_id"), [*SCAN, "patch_id"], "left_semi")


def write_blip_samples(samples: DataFrame, blips: DataFrame, path: str) -> None:
    blip_sample_rows(samples, blips).write.mode("append").partitionBy("source_id", "run_id").parquet(path)


def read_blip_samples(stored: DataFrame, scans: DataFrame) -> DataFrame:
    """Dense pulses from stored blip samples: samples (0 where nothing is stored) and classes (2 where it is, else 0)."""
    cells = stored.groupBy(*SCAN, "pulse").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"))
    every = scans.select(*SCAN, "samples_per_pulse", F.explode(F.expr("sequence(0, pulses - 1)")).alias("pulse"))
    columns = {"samples": "coalesce(_m[c], 0)", "classes": "if(_m[c] is null, 0, 2)"}
    return every.join(cells, [*SCAN, "pulse"], "left").select(*SCAN, "pulse", *[F.expr(f"transform(sequence(0, samples_per_pulse - 1), c -> {v})").alias(k) for k, v in columns.items()])


def blip_scores(samples: DataFrame, blips: DataFrame, scans: DataFrame) -> DataFrame:
    """Per scan: its time and the scores of its blip samples, in run order."""
    rows = blip_sample_rows(samples, blips).groupBy(*SCAN).agg(F.expr("transform(array_sort(collect_list(struct(pulse, col, score))), x -> x.score)").alias("scores"))
    return rows.join(scans.select(*SCAN, "ts"), SCAN)


def write_scans(pulses: DataFrame, path: str) -> None:
    pulses.write.mode("append").partitionBy("source_id", "run_id").parquet(path)


def export_blips(samples: DataFrame, blips: DataFrame, geometry: DataFrame, scans: DataFrame) -> DataFrame:
    """Blips with the list of their samples: range, theta, phi (degrees), dBm, pulse, sample."""
    rows = samples.join(geometry.select(*SCAN, "pulse", "azi", "elev"), [*SCAN, "pulse"]).join(scans.select(*SCAN, "sample_dist", "first_sample_dist"), SCAN)
    rows = rows.select(*SCAN, "patch_id", F.struct("pulse", "col", F.expr("sample_dist * (col + 0.5D) + first_sample_dist").alias("r"), F.col("elev").alias("theta"), F.col("azi").alias("phi"), sample_to_dbm("value").alias("dbm")).alias("s"))
    lists = rows.groupBy(*SCAN, "patch_id").agg(F.array_sort(F.collect_list("s")).alias("cells"))
    return blips.join(lists, [*SCAN, "patch_id"])
