"""Trails of blips over scans, and analysis of stored blips. Blip samples are rows (source_id, run_id, scan_id, patch_id, pulse, col, value, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysweep.functions.geometry import angular_separation

RUN = ["source_id", "run_id"]


def trails_last_n(blip_samples: DataFrame, scans: DataFrame, n: int = 20, fadeout: float = 0.85) -> DataFrame:
    """For each scan the slots (pulse, col) hit in the last n scans, itself included: the newest hit's value, faded by fadeout to the power of its age (1 for the scan itself)."""
    # a hit is the newest until the next one of its slot, so that each row of the result comes from one hit
    until = F.lead("scan_id").over(Window.partitionBy(*RUN, "pulse", "col").orderBy("scan_id"))
    hits = blip_samples.withColumn("_from", F.col("scan_id")).withColumn("_to", F.least(F.expr(f"scan_id + {n - 1}"), until - 1)).where("_to >= _from")
    near = hits.withColumn("scan_id", F.explode(F.sequence("_from", "_to"))).join(scans.select(*RUN, "scan_id"), [*RUN, "scan_id"])
    return near.select(*RUN, "scan_id", "pulse", "col", "value", F.expr("cast(scan_id - _from + 1 as int)").alias("age")).withColumn("faded", F.expr(f"value * pow({fadeout!r}D, age)"))


def trails_storage(blip_samples: DataFrame) -> DataFrame:
    """Slots ever hit, with the latest value and score."""
    return blip_samples.groupBy(*RUN, "pulse", "col").agg(F.max_by("value", "scan_id").alias("value"), F.max_by("score", "scan_id").alias("score"))


def blip_cross_section(blip_samples: DataFrame, geometry: DataFrame) -> DataFrame:
    """The samples of each blip at the range of its brightest one, with their angle from it (radians, negative before it). Of equally bright ones the first counts."""
    blip = [*RUN, "scan_id", "patch_id"]
    rows = blip_samples.join(geometry.select(*RUN, "scan_id", "pulse", "azi", "elev"), [*RUN, "scan_id", "pulse"])
    best = rows.groupBy(*blip).agg(F.max(F.struct("value", (-F.col("pulse")).alias("p"), (-F.col("col")).alias("c"), "azi", "elev")).alias("b"))
    best = best.select(*blip, (-F.col("b.p")).alias("_p"), (-F.col("b.c")).alias("col"), F.col("b.azi").alias("_azi"), F.col("b.elev").alias("_elev"))
    angle = angular_separation("radians(azi)", "radians(elev)", "radians(_azi)", "radians(_elev)")
    return rows.join(best, [*blip, "col"]).withColumn("angle", angle * F.when(F.col("pulse") < F.col("_p"), -1).otherwise(1)).select(*blip, "pulse", "col", "value", "angle")


def blips_in_time(blips: DataFrame, t1: float, t2: float) -> DataFrame:
    return blips.where((F.col("t") >= t1) & (F.col("t") <= t2))


def blip_file_summary(blips: DataFrame) -> DataFrame:
    """Count, first and last time of stored blips."""
    return blips.agg(F.count("*").alias("n_blips"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def running_number(blips: DataFrame, *order: str) -> DataFrame:
    """blips with blip_no: their number in the run, from 1, by scan and then in this order. They are numbered in their scan, after the blips of the scans before."""
    scan = [*RUN, "scan_id"]
    counts = blips.groupBy(*scan).agg(F.count("*").alias("_n"))
    before = counts.select(*scan, (F.sum("_n").over(Window.partitionBy(*RUN).orderBy("scan_id")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*scan).orderBy(*order))
    return blips.join(before, scan).withColumn("blip_no", (F.col("_before") + own).cast("int")).drop("_before")
