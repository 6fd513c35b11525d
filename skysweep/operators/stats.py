"""Statistics of patches. Samples of patches are rows (source_id, run_id, scan_id, patch_id, pulse, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCAN = ["source_id", "run_id", "scan_id"]
PATCH = [*SCAN, "patch_id"]
META = ["ts", "duration_ms", "pulses", "bits_per_sample", "sample_dist", "first_sample_dist", "bearing", "bearing_offset", "elevation"]


def patch_stats(samples: DataFrame, geometry: DataFrame, scans: DataFrame, area_weighting: bool = False) -> DataFrame:
    """Per patch: x, y, z, t, ns, area, int, max, aspan, rspan, range. geometry: azi and elev of each pulse (source_id, run_id, scan_id, pulse).

    Centroids are weighted by value, or by area; they are null if all weights are 0. One shuffle by patch, after joins with the
    scan and pulse tables."""
    rows = samples.join(geometry.select(*SCAN, "pulse", "azi", "elev"), [*SCAN, "pulse"]).join(scans.select(*SCAN, *META), SCAN)
    rows = rows.withColumns({"_r": F.expr("col + first_sample_dist / sample_dist + 0.5D"), "_c": F.expr("cos(radians(elev))"), "_w": F.expr("2D * col + 1" if area_weighting else "cast(value as double)")})
    sums = rows.groupBy(*PATCH, *META).agg(
        F.count("*").cast("int").alias("ns"), F.sum(F.col("value").cast("bigint")).alias("_v"), F.max("value").alias("_m"), F.sum("_w").alias("_sw"),
        F.sum(F.expr("_w * _r * sin(radians(azi)) * _c")).alias("_sx"), F.sum(F.expr("_w * _r * cos(radians(azi)) * _c")).alias("_sy"), F.sum(F.expr("_w * _r * sin(radians(elev))")).alias("_sz"),
        F.sum(F.expr("2 * _r * _c * _c")).alias("_a"), F.min("pulse").alias("_p1"), F.max("pulse").alias("_p2"), F.count_distinct("pulse").cast("int").alias("_np"), F.min("col").alias("_c1"), F.max("col").alias("_c2"),
    )
    sums = sums.withColumns({k: F.expr(f"case when _sw <> 0 then sample_dist * {s} / _sw end") for k, s in (("x", "_sx"), ("y", "_sy"), ("_z", "_sz"))})
    turn = "pmod(2 * pi() + pi() / 2 - atan2(y, x) - radians(bearing + bearing_offset), 2 * pi())"
    out = {
        "z": "_z + elevation", "t": f"ts + duration_ms / 1000D * {turn} / (2 * pi())", "ns": "ns", "area": "pi() * sample_dist * sample_dist / pulses * _a",
        "int": "_v / (ns * (pow(2D, bits_per_sample) - 1))", "max": "_m / (pow(2D, bits_per_sample) - 1)", "aspan": "if(_p2 - _p1 + 1 = pulses, _np, _p2 - _p1 + 1)",
        "rspan": "_c2 - _c1 + 1", "range": "sqrt(x * x + y * y + _z * _z)",
    }
    return sums.select(*PATCH, "x", "y", *[F.expr(v).alias(k) for k, v in out.items()])


def perimeter(runs: DataFrame, adjacency: DataFrame, geometry: DataFrame, scans: DataFrame) -> DataFrame:
    """Per patch: perim, in metres. Edges along the beam less those shared with the next pulse, and edges across it by range. Kept as doubles, where integer
    arithmetic would cut at every run. adjacency must be that of 4 neighbours."""
    cos = geometry.select(*SCAN, "pulse", F.expr("cos(radians(elev))").alias("_c"))
    meta = scans.select(*SCAN, "pulses", "sample_dist", "first_sample_dist")
    own = runs.join(cos, [*SCAN, "pulse"]).join(meta, SCAN).select(*PATCH, F.expr("sample_dist * 2 * length * _c + sample_dist * (2 * pi() / pulses) * (2 * (col + first_sample_dist / sample_dist) + length) * _c").alias("_e"))
    shared = adjacency.join(runs.select(*SCAN, F.col("run_no").alias("a"), "patch_id"), [*SCAN, "a"]).join(cos.withColumnRenamed("pulse", "pulse_b"), [*SCAN, "pulse_b"]).join(meta, SCAN).select(*PATCH, F.expr("-2 * sample_dist * overlap * _c").alias("_e"))
    return own.unionByName(shared).groupBy(*PATCH).agg(F.sum("_e").alias("perim"))


def patch_stats_rect(samples: DataFrame, scans: DataFrame, area_weighting: bool = False) -> DataFrame:
    """Statistics of patches of rectangular frames: x by column, y by row; range is -1 until rect_to_spatial."""
    rows = samples.join(scans.select(*SCAN, "ts", "bits_per_sample", "sample_dist"), SCAN).withColumn("_w", F.lit(1.0) if area_weighting else F.col("value").cast("double"))
    sums = rows.groupBy(*PATCH, "ts", "bits_per_sample", "sample_dist").agg(
        F.count("*").cast("int").alias("ns"), F.sum("_w").alias("_sw"), F.sum(F.expr("_w * col")).alias("_sx"), F.sum(F.expr("_w * pulse")).alias("_sy"),
        F.sum(F.col("value").cast("bigint")).alias("_v"), F.max("value").alias("_m"), F.expr("max(pulse) - min(pulse) + 1").alias("aspan"), F.expr("max(col) - min(col) + 1").alias("rspan"),
    )
    out = {"x": "case when _sw <> 0 then _sx / _sw end", "y": "case when _sw <> 0 then _sy / _sw end", "z": "0D", "t": "ts", "ns": "ns", "area": "ns * sample_dist * sample_dist", "int": "_v / (ns * (pow(2D, bits_per_sample) - 1))", "max": "_m / (pow(2D, bits_per_sample) - 1)", "aspan": "aspan", "rspan": "rspan", "range": "-1D"}
    stats = sums.select(*PATCH, *[F.expr(v).alias(k) for k, v in out.items()])
    return stats.join(blip_edges(samples).join(scans.select(*SCAN, "sample_dist"), SCAN).select(*PATCH, F.expr("sample_dist * (along + across)").alias("perim")), PATCH)


def blip_edges(samples: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Edges of each patch, by its samples alone: along (between neighbouring pulses) and across (between neighbouring columns). With scans (pulses),
    the last and the first pulse are neighbours."""
    rows = samples.select(*PATCH, "pulse", "col")
    in_pulse, in_col = Window.partitionBy(*PATCH, "pulse").orderBy("col"), Window.partitionBy(*PATCH, "col").orderBy("pulse")
    rows = rows.withColumn("_ac", F.expr("2") - F.when(F.lag("col").over(in_pulse) == F.col("col") - 1, 2).otherwise(0))
    rows = rows.withColumn("_al", F.expr("2") - F.when(F.lag("pulse").over(in_col) == F.col("pulse") - 1, 2).otherwise(0))
    if scans is not None:
        whole = Window.partitionBy(*PATCH, "col")
        rows = rows.join(scans.select(*SCAN, "pulses"), SCAN)
        seam = (F.col("pulse") == 0) & (F.max("pulse").over(whole) == F.col("pulses") - 1) & (F.col("pulses") > 2)
        rows = rows.withColumn("_al", F.col("_al") - F.when(seam, 2).otherwise(0))
    return rows.groupBy(*PATCH).agg(F.sum("_al").alias("along"), F.sum("_ac").alias("across"))


def blip_perimeter(samples: DataFrame, scans: DataFrame) -> DataFrame:
    """Perimeter from the list of samples: edges along the beam times the sample distance, and the arcs at the inner and outer edge of each run."""
    rows = samples.select(*PATCH, "pulse", "col").join(scans.select(*SCAN, "pulses", "sample_dist", "first_sample_dist"), SCAN)
    in_pulse = Window.partitionBy(*PATCH, "pulse").orderBy("col")
    arc = "2 * pi() / pulses * ({} * sample_dist + first_sample_dist)"
    rows = rows.withColumn("_arcs", F.when(F.coalesce(F.lag("col").over(in_pulse) == F.col("col") - 1, F.lit(False)), 0.0).otherwise(F.expr(arc.format("col"))) + F.when(F.coalesce(F.lead("col").over(in_pulse) == F.col("col") + 1, F.lit(False)), 0.0).otherwise(F.expr(arc.format("(col + 1)"))))
    arcs = rows.groupBy(*PATCH).agg(F.sum("_arcs").alias("_arcs"))
    edges = blip_edges(samples, scans).join(scans.select(*SCAN, "sample_dist"), SCAN)
    return edges.join(arcs, PATCH).select(*PATCH, F.expr("along + across").alias("edges"), F.expr("along * sample_dist + _arcs").alias("perim"))


def summarize_patches(samples: DataFrame, geometry: DataFrame, scans: DataFrame, area_weighting: bool = False) -> DataFrame:
    """Another summary: centroid by area or by range-weighted intensity, intensity weighted by range, time at the mean pulse. Null where all weights are 0."""
    rows = samples.join(geometry.select(*SCAN, "pulse", "azi", "elev"), [*SCAN, "pulse"]).join(scans.select(*SCAN, *META), SCAN).withColumn("_r", F.expr("sample_dist * (col + 0.5D) + first_sample_dist"))
    rows = rows.withColumn("_w", F.col("_r") if area_weighting else F.expr("_r * value"))
    flat = "_w * _r * cos(radians(elev))"
    sums = rows.groupBy(*PATCH, "ts", "duration_ms", "pulses", "bits_per_sample").agg(F.count("*").cast("int").alias("ns"), F.sum("_w").alias("_sw"), F.sum("_r").alias("_sr"), F.sum(F.expr("_r * value")).alias("_srv"), F.sum(F.expr(f"{flat} * sin(radians(azi))")).alias("_sx"), F.sum(F.expr(f"{flat} * cos(radians(azi))")).alias("_sy"), F.avg("pulse").alias("_p"))
    return sums.select(*PATCH, "ns", F.expr("try_divide(_sx, _sw)").alias("x"), F.expr("try_divide(_sy, _sw)").alias("y"), F.expr("try_divide(_srv, _sr) / (pow(2D, bits_per_sample) - 1)").alias("int"), F.expr("ts + duration_ms / 1000D * _p / pulses").alias("t"))
