"""Geometry of scans: interpolation, beams, and transforms between samples, metres and angles. Angles in degrees, clockwise from north; x east, y north, z up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI = "pi()"


def interp_state(points: DataFrame, times: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """times (keys, at, ...) with values: piecewise-linear interpolation of points (keys, t, values). Null outside the points; a single point holds always. Of points at
    one time the last in order of values counts from there on. Points and times go through one shuffle, each time then has its neighbours in order."""
    knots = points.select(*keys, F.col("t").alias("_t"), F.struct("t", *values).alias("_k"))
    rows = knots.unionByName(times.withColumn("_t", F.col("at")), allowMissingColumns=True).withColumn("_asked", F.col("_k").isNull())
    start = Window.unboundedPreceding
    before = Window.partitionBy(*keys).orderBy("_t", "_asked", "_k").rowsBetween(start, 0)
    behind = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_asked"), F.desc("_k")).rowsBetween(start, 0)
    rows = rows.withColumns({"_n": F.count("_k").over(Window.partitionBy(*keys)), "_a": F.last("_k", True).over(before), "_b": F.last("_k", True).over(behind), "_one": F.max("_k").over(Window.partitionBy(*keys))})
    line = "case when _n = 1 then _one.{0} when _b is null and _a.t = at or _b.t > at and _a.t = at then _a.{0} when _a.t < at and _b.t > at then _a.{0} + (_b.{0} - _a.{0}) * (at - _a.t) / (_b.t - _a.t) end"
    return rows.where("_asked").select(*times.columns, *[F.expr(line.format(v)).alias(v) for v in values])


def lin_interp(points: DataFrame, times: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Linear interpolation of points (keys, t, value) at times (keys, at), held at the end values outside."""
    ends = points.groupBy(*keys).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    held = times.join(ends, keys).withColumn("_asked_at", F.col("at")).withColumn("at", F.expr("least(greatest(at, _first), _last)"))
    return interp_state(points, held, keys, [value]).select(*keys, F.col("_asked_at").alias("at"), value)


def pulse_table(scans: DataFrame) -> DataFrame:
    """One row per pulse of each scan, with its time and the directions of beam and waveguide: ts, azi, elev, wg_azi, wg_elev.

    scans: keys, ts, duration_ms, pulses, orientation, bearing_offset, and axis_azimuth, axis_elevation, tilt (degrees; for axes that
    move within a scan, join interp_state to the exploded pulses and call beam)."""
    rows = scans.withColumn("pulse", F.explode(F.expr("sequence(0, pulses - 1)"))).withColumn("scan_ts", F.col("ts"))
    return beam(rows.withColumn("ts", F.expr("scan_ts + pulse * duration_ms / 1000D / pulses"))).drop("scan_ts")


#: Turns of beam and waveguide by the angle _o, and the directions that they give.
_TURNED = {f"_b{c}": f"cos(_t) * (cos(_o) * _u{c} + sin(_o) * _v{c}) + sin(_t) * _r{c}" for c in "xyz"}
_AZI, _ELEV = "pmod(450 - degrees(atan2(_by, _bx)), 360D)", "degrees(asin(greatest(-1D, least(1D, _bz))))"
_ANGLE = PI + " * (bearing_offset / 180D + 2D * {} * orientation / pulses)"


def _axes(rows: DataFrame) -> DataFrame:
    """The axis _r and two directions _u, _v across it, from axis_azimuth and axis_elevation; _t from tilt."""
    rows = rows.withColumns({"_a": F.radians("axis_azimuth"), "_e": F.radians("axis_elevation"), "_t": F.radians("tilt")})
    rows = rows.withColumns({"_rx": F.expr("sin(_a) * cos(_e)"), "_ry": F.expr("cos(_a) * cos(_e)"), "_rz": F.expr("sin(_e)"), "_ux": F.expr("cos(_a) * sin(_a) * (sin(_e) - 1)"), "_uy": F.expr("sin(_a) * sin(_a) + sin(_e) * cos(_a) * cos(_a)"), "_uz": F.expr("-cos(_a) * cos(_e)")})
    return rows.withColumns({"_vx": F.expr("1 + sin(_e) - _uy"), "_vy": F.col("_ux"), "_vz": F.expr("-sin(_a) * cos(_e)")})


def beam(rows: DataFrame) -> DataFrame:
    """Adds azi, elev, wg_azi, wg_elev to rows with pulse, pulses, orientation, bearing_offset, axis_azimuth, axis_elevation, tilt."""
    rows = _axes(rows).withColumn("_o", F.expr(_ANGLE.format("pulse"))).withColumns({k: F.expr(v) for k, v in _TURNED.items()})
    rows = rows.withColumns({"_wx": F.expr("_by * _rz - _bz * _ry"), "_wy": F.expr("_bz * _rx - _bx * _rz"), "_wz": F.expr("_bx * _ry - _by * _rx")})
    out = {"azi": _AZI, "elev": _ELEV, "wg_azi": "pmod(450 - degrees(atan2(_wy, _wx)), 360D)", "wg_elev": "degrees(asin(greatest(-1D, least(1D, try_divide(_wz, sqrt(_wx * _wx + _wy * _wy + _wz * _wz))))))"}
    return rows.withColumns({k: F.expr(v) for k, v in out.items()}).drop(*[c for c in rows.columns if c.startswith("_")])


def beam_arrays(scans: DataFrame) -> DataFrame:
    """Adds azi and elev to scans as arrays by pulse: for streams, where a scan stays one row."""
    rows = _axes(scans)
    turned = "struct({})".format(", ".join(f"{v.replace('_o', '_w')} as {k}" for k, v in _TURNED.items()))
    rows = rows.withColumn("_beams", F.expr(f"transform(transform(sequence(0, pulses - 1), i -> {_ANGLE.format('i')}), _w -> {turned})"))
    inside = lambda x: x.replace("_b", "_q._b")
    rows = rows.withColumns({"azi": F.expr(f"transform(_beams, _q -> {inside(_AZI)})"), "elev": F.expr(f"transform(_beams, _q -> {inside(_ELEV)})")})
    return rows.drop(*[c for c in rows.columns if c.startswith("_") and c not in scans.columns])


def xy_to_sample_pulse(x: str, y: str) -> dict[str, Column]:
    """1-based sample and pulse of a point, for scans with sample_dist, first_sample_dist, pulses, bearing_offset and tilt."""
    x, y = f"({x})", f"({y})"
    return {
        "sample": F.expr(f"1 + cast(floor(sqrt({x} * {x} + {y} * {y}) / (sample_dist * cos(radians(tilt))) - first_sample_dist / sample_dist) as int)"),
        "pulse": F.expr(f"1 + cast(floor(pmod({PI} / 2 - atan2({y}, {x}) + (180D / pulses - bearing_offset) * {PI} / 180, 2 * {PI}) / (2 * {PI}) * pulses) as int)"),
    }


def sample_pulse_to_range_bearing(sample: str, pulse: str) -> dict[str, Column]:
    """Range (m) and bearing of the centre of a cell, given by 1-based sample and pulse."""
    return {"range": F.expr(f"sample_dist * ({sample} - 0.5D) + first_sample_dist"), "bearing_deg": F.expr(f"pmod(({pulse} - 1) * 360D / pulses + bearing_offset, 360D)")}


def sample_pulse_to_spherical(sample: str, pulse: str) -> dict[str, Column]:
    """Range, inclination theta (from the horizontal) and azimuth phi of a cell, in radians; turns with orientation and bearing."""
    return {
        "r": F.expr(f"sample_dist * ({sample} - 0.5D) + first_sample_dist"),
        "theta": F.expr("radians(tilt)"),
        "phi": F.expr(f"pmod(radians(bearing + bearing_offset) + orientation * 2 * {PI} * ({pulse} - 1) / pulses, 2 * {PI})"),
    }


def planar_scale() -> dict[str, Column]:
    """Metres per sample along the beam, over ground, and in height."""
    return {"range_per_sample": F.col("sample_dist"), "planar_per_sample": F.expr("sample_dist * cos(radians(tilt))"), "elevation_per_sample": F.expr("sample_dist * sin(radians(tilt))")}


def dist3d(a: str = "a", b: str = "b") -> Column:
    """Distance of the points in the columns a_x, a_y, a_z and b_x, b_y, b_z."""
    return F.expr(f"sqrt(pow({a}_x - {b}_x, 2) + pow({a}_y - {b}_y, 2) + pow({a}_z - {b}_z, 2))")


def cos_angle3d(a: str = "a", b: str = "b") -> Column:
    """Cosine between two vectors; NaN if one is zero."""
    size = "sqrt({0}_x * {0}_x + {0}_y * {0}_y + {0}_z * {0}_z)"
    product = f"({size.format(a)} * {size.format(b)})"
    return F.expr(f"case when {product} = 0 then double('NaN') else ({a}_x * {b}_x + {a}_y * {b}_y + {a}_z * {b}_z) / {product} end")


def angular_separation(phi1: str, theta1: str, phi2: str, theta2: str) -> Column:
    """Great-circle angle (radians) between two directions given by azimuth and inclination."""
    return F.expr(f"acos(greatest(-1D, least(1D, sin({theta1}) * sin({theta2}) + cos({theta1}) * cos({theta2}) * cos({phi1} - {phi2}))))")


_GRID = ["pulses", "samples_per_pulse", "sample_dist", "first_sample_dist", "bearing_offset", "tilt"]


def pixel_table(scans: DataFrame, size: int, metres_per_pixel: float, centre: tuple[float, float] = (0.0, 0.0), rotation: float = 0.0) -> DataFrame:
    """For each scan geometry (distinct pulses, samples_per_pulse, sample_dist, first_sample_dist, bearing_offset, tilt): the pulse and sample
    under the centre of each pixel of a square grid. centre: the place (x east, y north, in metres from the radar) in the middle of the grid; rotation: how far north is turned clockwise from the grid's
    upward direction, in degrees. Pixels outside the scan are left out. Size: grid squared times geometries."""
    shape = scans.select(*_GRID).distinct()
    grid = shape.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    grid = grid.withColumns({"_x": F.expr(f"(px + 0.5D - {size / 2!r}D) * {metres_per_pixel!r}D"), "_y": F.expr(f"({size / 2!r}D - py - 0.5D) * {metres_per_pixel!r}D")})
    if rotation:
        c, s = f"cos(radians({float(rotation)!r}D))", f"sin(radians({float(rotation)!r}D))"
        grid = grid.withColumns({"_x": F.expr(f"_x * {c} - _y * {s}"), "_y": F.expr(f"_x * {s} + _y * {c}")})
    if centre != (0.0, 0.0):
        grid = grid.withColumns({"_x": F.expr(f"_x + {float(centre[0])!r}D"), "_y": F.expr(f"_y + {float(centre[1])!r}D")})
    grid = grid.withColumns({k: v - 1 for k, v in xy_to_sample_pulse("_x", "_y").items()}).withColumnRenamed("sample", "col")
    return grid.where("col >= 0 and col < samples_per_pulse and pulse < pulses").drop("_x", "_y")


def polar_to_grid(samples: DataFrame, scans: DataFrame, size: int, metres_per_pixel: float, spread: int = 0, visible: list[int] | None = None, centre: tuple[float, float] = (0.0, 0.0), rotation: float = 0.0) -> DataFrame:
    """Pixel values of scans: source_id, run_id, scan_id, px, py, value, the sample nearest to the pixel's centre, or the mean of it and its next `spread` (0 to 3) samples
    along the beam. visible: classes that are shown, if samples have a column class. centre and rotation: as in pixel_table."""
    scan = ["source_id", "run_id", "scan_id"]
    lookup = pixel_table(scans, size, metres_per_pixel, centre, rotation)
    if spread:
        lookup = lookup.withColumn("col", F.explode(F.expr(f"sequence(col, least(col + {spread}, samples_per_pulse - 1))")))
    shown = samples if visible is None else samples.where(F.col("class").isin(visible))
    with_shape = shown.join(scans.select(*scan, *_GRID), scan)
    # the lookup's size is a grid per geometry; Spark broadcasts it if it is small
    return with_shape.join(lookup, [*_GRID, "pulse", "col"]).groupBy(*scan, "px", "py").agg(F.avg("value").alias("value"))


def rect_to_spatial(patches: DataFrame) -> DataFrame:
    """Patches of rectangular frames (x by column, y by row) in metres: scale, rotation (degrees), origin_x, origin_y; range recomputed."""
    c, s = "cos(radians(rotation))", "sin(radians(rotation))"
    moved = patches.withColumns({"_x": F.expr(f"origin_x + scale * (x * {c} - y * {s})"), "_y": F.expr(f"origin_y + scale * (x * {s} + y * {c})")})
    return moved.withColumn("x", F.col("_x")).withColumn("y", F.col("_y")).withColumn("range", F.expr("sqrt(x * x + y * y + z * z)")).drop("_x", "_y")
