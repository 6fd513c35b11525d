"""Filters of patches. They never delete rows: they set is_blip, so that filters can be tried again on stored patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCAN = ["source_id", "run_id", "scan_id"]
PATCH = [*SCAN, "patch_id"]
#: Column of patches that each range is about.
RANGES = {"samples": "ns", "area": "area", "angular": "aspan", "radial": "rspan"}


def unfilter(patches: DataFrame) -> DataFrame:
    """All patches become candidates again."""
    return patches.withColumn("is_blip", F.lit(True))


def in_range(column: str, low: str, high: str) -> str:
    """Inclusive; a negative maximum is none."""
    return f"({column} >= {low} and ({high} < 0 or {column} <= {high}))"


def filter_range(patches: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """samples, area, angular, radial: (min, max)."""
    tests = [in_range(RANGES[k], repr(a), repr(b)) for k, (a, b) in ranges.items()]
    return patches.withColumn("is_blip", F.expr(" and ".join(["is_blip", *tests])))


def filter_expr(patches: DataFrame, expression: str) -> DataFrame:
    """A user's SQL predicate over the patch columns; it must be Boolean. Null counts as false."""
    if not isinstance(patches.select(F.expr(expression).alias("x")).schema["x"].dataType, T.BooleanType):
        raise TypeError(f"not a Boolean expression: {expression}")
    return patches.withColumn("is_blip", F.col("is_blip") & F.coalesce(F.expr(expression), F.lit(False)))


def filter_chain(patches: DataFrame, filters: list[tuple[Callable[[DataFrame], DataFrame], bool]]) -> DataFrame:
    """Filters (function, reads_only) in order, those that only read first; each sees the result of those before."""
    for f, _ in sorted(filters, key=lambda x: not x[1]):
        patches = patches.transform(f)
    return patches


def combine_filter_record(scans: DataFrame) -> DataFrame:
    """The filter that holds for a scan: the ranges (min, max; a negative max is none) of source and user intersected, their expressions joined by AND."""
    top = "case when src_max < 0 then max when max < 0 then src_max else least(src_max, max) end"
    both = "nullif(concat_ws(' AND ', if(src_expr is null, null, concat('(', src_expr, ')')), if(expr is null, null, concat('(', expr, ')'))), '')"
    return scans.withColumns({"eff_min": F.expr("greatest(src_min, min)"), "eff_max": F.expr(top), "eff_expr": F.expr(both)})


# --- zones: rows (zone_ord, zone_id, enabled, segment, r1, r2, a_start, a_extent, samples_min, ..., filter_expr) ---


def _angle_inside(a: str) -> str:
    return f"(({a} >= a_start and {a} <= a_start + a_extent) or (a_start + a_extent > 360 and {a} <= a_start + a_extent - 360))"


def _segments(zones: DataFrame, *columns: str) -> Column:
    """The segments of a zone table as one array: zones are drawn by hand, so it is small; a scalar subquery brings it to the rows without a join."""
    return zones.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()


def zone_of_xy(points: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """points (..., x, y) with zone_ord: the first enabled zone that holds the point, else null. zones has one row a segment."""
    found = points.withColumns({"_r": F.expr("sqrt(x * x + y * y)"), "_a": F.expr("pmod(90 - degrees(atan2(y, x)), 360D)"), "_zones": _segments(zones.where("enabled and r1 <> r2"), "zone_ord", "r1", "r2", "a_start", "a_extent")})
    inside = _angle_inside("_a").replace("a_", "z.a_")
    return found.withColumn("zone_ord", F.expr(f"get(filter(_zones, z -> _r between least(z.r1, z.r2) and greatest(z.r1, z.r2) and {inside}), 0).zone_ord")).drop("_r", "_a", "_zones")


_SHAPE = ["pulses", "samples_per_pulse", "sample_dist", "first_sample_dist", "bearing_offset"]


def compile_zones(zones: DataFrame, scans: DataFrame) -> DataFrame:
    """Segments in terms of each scan geometry: samples s1 to s2, pulses p1 to p2 (0-based); a range across the last pulse has both pulses negated, less one."""
    rows = scans.select(*_SHAPE).distinct().withColumn("_z", F.explode(_segments(zones, *zones.columns))).select(*_SHAPE, "_z.*")
    rows = rows.withColumns({"s1": F.expr("cast(greatest(0, floor((least(r1, r2) - first_sample_dist) / sample_dist)) as int)"), "s2": F.expr("cast(least(samples_per_pulse - 1, floor((greatest(r1, r2) - first_sample_dist) / sample_dist)) as int)"), "_b": F.expr("cast(floor(pmod(a_start - bearing_offset, 360D) / 360 * pulses) as int)"), "_n": F.expr("cast(least(pulses, ceil(a_extent / 360 * pulses)) as int)")})
    rows = rows.withColumn("_e", F.expr("_b + _n - 1"))
    return rows.withColumns({"p1": F.expr("if(_e >= pulses, -_b - 1, _b)"), "p2": F.expr("if(_e >= pulses, -(_e - pulses) - 1, _e)")}).drop("_b", "_n", "_e")


def zone_of_sample(samples: DataFrame, compiled: DataFrame, scans: DataFrame, keys: list[str]) -> DataFrame:
    """samples (..., source_id, run_id, scan_id, pulse, col) with zone_ord: the first enabled zone that holds the sample, else null. The zones go to the scans, one array
    each, and the samples meet their scan once."""
    lists = compiled.where("enabled").groupBy(*_SHAPE).agg(F.array_sort(F.collect_list(F.struct("zone_ord", "s1", "s2", "p1", "p2"))).alias("_zones"))
    with_zones = scans.select(*SCAN, *_SHAPE).join(lists, _SHAPE, "left").select(*SCAN, "_zones")
    within = "((z.p1 >= 0 and pulse between z.p1 and z.p2) or (z.p1 < 0 and (pulse >= -z.p1 - 1 or pulse <= -z.p2 - 1)))"
    return samples.join(with_zones, SCAN, "left").withColumn("zone_ord", F.expr(f"get(filter(_zones, z -> col between z.s1 and z.s2 and {within}), 0).zone_ord")).drop("_zones")


def exclude_zone_class(classified: DataFrame, compiled: DataFrame, scans: DataFrame, excluded: int = 4) -> DataFrame:
    """Samples in an enabled zone with id "exclusion" get the class EXCLUDED."""
    keys = [*SCAN, "pulse", "col"]
    return zone_of_sample(classified, compiled.where("zone_id = 'exclusion'"), scans, keys).withColumn("class", F.expr(f"cast(if(zone_ord is null, class, {excluded}) as tinyint)")).drop("zone_ord")


def exclude_zone_zero(samples: DataFrame, compiled: DataFrame, scans: DataFrame) -> DataFrame:
    """Samples in the exclusion zone become 0."""
    keys = [*SCAN, "pulse", "col"]
    return zone_of_sample(samples, compiled.where("zone_id = 'exclusion'"), scans, keys).withColumn("value", F.expr("if(zone_ord is null, value, 0)")).drop("zone_ord")


def filter_zones(patches: DataFrame, zones: DataFrame, expressions: dict[int, str] | None = None) -> DataFrame:
    """Zone ranges replace the keep flag of patches (with x, y) inside a zone; the exclusion zone then drops them; expressions, by zone_ord, are ANDed."""
    limits = zones.groupBy("zone_ord", "zone_id").agg(*[F.first(f"{k}_{m}").alias(f"_{k}_{m}") for k in RANGES for m in ("min", "max")])
    rows = zone_of_xy(patches, zones, PATCH).join(limits, "zone_ord", "left")
    ranges = " and ".join(in_range(c, f"_{k}_min", f"_{k}_max") for k, c in RANGES.items())
    keep = F.expr(f"case when zone_ord is null then is_blip when zone_id = 'exclusion' then false else {ranges} end")
    for zone, expression in (expressions or {}).items():
        keep = keep & (F.coalesce(F.col("zone_ord") != zone, F.lit(True)) | F.coalesce(F.expr(expression), F.lit(False)))
    return rows.withColumn("is_blip", keep).drop("zone_id", *[f"_{k}_{m}" for k in RANGES for m in ("min", "max")])


# --- clutter maps ---


def learn_clutter(blip_samples: DataFrame, scans: DataFrame) -> DataFrame:
    """Per (source_id, angle_class, pulse, col): hits by blip samples, and the scans learned from. Both tables have angle_class; maps of other dimensions are other keys
    (pulses, samples_per_pulse)."""
    shape = ["source_id", "angle_class", "pulses", "samples_per_pulse"]
    hits = blip_samples.join(scans.select(*SCAN, *shape[1:]), SCAN).groupBy(*shape, "pulse", "col").agg(F.count("*").alias("hits"))
    return hits.join(scans.groupBy(*shape).agg(F.count("*").alias("n_scans")), shape)


def occupancy(clutter: DataFrame) -> DataFrame:
    """Hit rate of each slot."""
    return clutter.withColumn("rate", F.col("hits") / F.col("n_scans"))


def filter_clutter(patches: DataFrame, blip_samples: DataFrame, scans: DataFrame, clutter: DataFrame, cutoff: float = 0.003) -> DataFrame:
    """Drops blips whose samples' mean hit count is cutoff times the scans learned, or more."""
    shape = ["source_id", "angle_class", "pulses", "samples_per_pulse"]
    rows = blip_samples.join(scans.select(*SCAN, *shape[1:]), SCAN).join(clutter, [*shape, "pulse", "col"], "left")
    mean = rows.groupBy(*PATCH).agg(F.avg(F.coalesce("hits", F.lit(0))).alias("_hits"), F.max("n_scans").alias("_scans"))
    return patches.join(mean, PATCH, "left").withColumn("is_blip", F.expr(f"is_blip and not coalesce(_scans > 0 and _hits >= {cutoff!r}D * _scans, false)")).drop("_hits", "_scans")


# --- user functions ---


def patch_sample_predicate(patches: DataFrame, samples: DataFrame, keep: Callable[[pd.DataFrame], bool]) -> DataFrame:
    """keep sees the samples (pulse, col, value, score) of each patch, in one piece: a patch is bounded by its scan."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, bool(keep(rows.sort_values(["pulse", "col"])))]], columns=[*PATCH, "_keep"])

    schema = samples.select(*PATCH, F.lit(True).alias("_keep")).schema
    flags = samples.groupBy(*PATCH).applyInPandas(one, schema)
    return patches.join(flags, PATCH, "left").withColumn("is_blip", F.expr("is_blip and coalesce(_keep, false)")).drop("_keep")


def for_each_blip(patches: DataFrame, action: Callable[[Iterator], None]) -> None:
    """Runs action on the blips of each partition. A lost task may run it again: actions should be repeatable."""
    patches.where("is_blip").foreachPartition(action)


