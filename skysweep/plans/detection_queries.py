"""Queries over geometry, background statistics, patches and filters, with their SQL for DuckDB. Three learning scans, 4 x 4 cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep.functions import geometry as C
from skysweep.functions.stored import new_path, stored
from skysweep.operators import background as B
from skysweep.operators import filters as Z
from skysweep.operators import patches as E
from skysweep.operators import stats as S
from skysweep.operators.cluttermap import clutter_map, update_clutter
from skysweep.plans import detect as I
from skysweep.plans.derived import BLIPS, PARCELS, PULSES, blips, parcels, pulses, scans, with_
from skysweep.sources.scans import explode_samples

LEARN = 3
PARAMS = I.Params.of({"find": {"learn_scans": LEARN, "exclude_blips": False}, "blip": {"samples": (10, 5000), "area": (10.0, 100000.0), "expression": "perim * perim / (area * 4 * pi()) < 5"}})
SCAN = ["source_id", "run_id", "scan_id"]


def samples(s, d):
    return explode_samples(pulses(s, d))


def cells(s, d, key=None, rows=None):
    stats = B.cell_row_stats(pulses(s, d) if rows is None else rows, keys=[*B.RUN, *([key] if key else [])])
    return B.cells_of(stats, "n", "sum", "mean", "dev_sum")


def scored(s, d):
    return I.scored_samples(pulses(s, d), PARAMS.find)


def classified(s, d):
    return B.classify_samples(scored(s, d))


def runs(s, d):
    return E.hot_runs(classified(s, d), scans(s, d))


def adjacency(s, d):
    return E.run_adjacency(runs(s, d), scans(s, d))


def patched(s, d):
    return I.runs_of(pulses(s, d), scans(s, d), PARAMS.find)


def patch_values(s, d):
    return E.run_values(patched(s, d))


def table(s, d):
    return C.pulse_table(scans(s, d))


def patches(s, d):
    return I.detect(pulses(s, d), scans(s, d), PARAMS)


def blip_samples(s, d):
    return samples_of_blips(*I.detected(pulses(s, d), scans(s, d), PARAMS))


def samples_of_blips(found, runs):
    return E.patch_samples(runs).join(found.where("is_blip").select(*E.SCAN, "patch_id"), S.PATCH, "left_semi")


def zones(s, d):
    """A zone for each region: an exclusion around the radar, sectors, one of them across north."""
    rows = s.read.parquet(f"{d}/region.parquet")
    return rows.selectExpr("cast(r_regionkey as int) as zone_ord", "if(r_regionkey = 0, 'exclusion', concat('special', r_regionkey)) as zone_id", "true as enabled", "0 as segment", "60D * r_regionkey as r1", "60D * r_regionkey + 90 as r2", "cast(pmod(300 + 80 * (r_regionkey - 1), 360) as double) as a_start", "if(r_regionkey = 0, 360D, 117.8D) as a_extent", "2D as samples_min", "-1D as samples_max", "20D as area_min", "9000D as area_max", "0D as angular_min", "-1D as angular_max", "0D as radial_min", "12D as radial_max")


ZONES = """zn as (select r_regionkey::int zone_ord, case when r_regionkey = 0 then 'exclusion' else 'special' || r_regionkey end zone_id, 60::double * r_regionkey r1,
  60::double * r_regionkey + 90 r2, ((300 + 80 * (r_regionkey - 1)) % 360)::double a0, case when r_regionkey = 0 then 360::double else 117.8::double end ax from region)"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def points(s, d):
    return samples(s, d).where("pulse % 7 = 3 and col % 9 = 4").select(*SCAN, "pulse", "col")


def clutter_scans(s, d):
    return scans(s, d).withColumn("angle_class", F.expr("cast(bround(tilt) as int)"))


def _without_clutter(s, d):
    """One detection gives the patches, the map that is learned from their blips, and the samples that meet it."""
    found, runs = I.detected(pulses(s, d), scans(s, d), PARAMS)
    found = stored(found)
    samples_, all_scans = stored(samples_of_blips(found, runs)), stored(clutter_scans(s, d))
    return Z.filter_clutter(found, samples_, all_scans, Z.learn_clutter(samples_, all_scans), 0.15).select(*S.PATCH, "is_blip")


def _lasting(s, d):
    """The clutter map from a folder that three batches of scans were added to, the second one twice."""
    all_scans, samples_ = clutter_scans(s, d), stored(blip_samples(s, d))
    n, path = (all_scans.agg(F.max("scan_id")).first()[0] or 0) + 1, new_path(s, "clutter")
    for batch in (0, 1, 1, 2):
        cut = f"scan_id >= {batch * n // 3} and scan_id < {(batch + 1) * n // 3}"
        update_clutter(path, batch, samples_.where(cut), all_scans.where(cut))
    return clutter_map(s, path)


def _shared_numbers(s, d, table):
    """The table for two sources whose scans have the same numbers."""
    rows = table(s, d)
    return rows.withColumn("source_id", F.lit("a")).unionByName(rows.withColumns({"source_id": F.lit("b"), **({"value": F.expr("value div 2")} if "value" in rows.columns else {})}))


def _interp(s, d, clamp=False):
    series = pulses(s, d).selectExpr("scan_id", "cast(pulse as double) as t", "cast(samples[3] as double) as u", "cast(samples[9] as double) as v").where("t % 4 = 1")
    times = pulses(s, d).selectExpr("scan_id", "cast(pulse as double) + 0.25D as at")
    if clamp:
        return rounded(C.lin_interp(series, times, ["scan_id"], "u"), "u")
    return rounded(C.interp_state(series, times, ["scan_id"], ["u", "v"]), "u", "v")


def _pairs(s, d):
    a = blips(s, d).selectExpr("scan_id", "blip_no as i", "x as a_x", "y as a_y", "z as a_z")
    return a.join(a.selectExpr("scan_id", "i as j", "a_x as b_x", "a_y as b_y", "a_z as b_z"), "scan_id")


def _record(s, d):
    return blips(s, d).selectExpr("scan_id", "blip_no", "cast(scan_id % 7 as double) as src_min", "cast(blip_no % 5 as double) as min", "if(scan_id % 3 = 0, -1D, 20D + scan_id % 4) as src_max", "if(blip_no % 4 = 0, -1D, 15D + blip_no) as max", "if(blip_no % 2 = 0, 'ns > 3', null) as src_expr", "if(scan_id % 5 = 0, null, 'area < 9') as expr")


META = "source_id, run_id, scan_id"
#: Statistics valid before each scan, by recursion over the scans of each cell.
CELLS = PULSES + """,
c0 as (select source_id, run_id, scan_id, pulse // 4 cell_row, col // 4 cell_col, count(*) n, sum("value")::bigint s from samp group by all),
c1 as (select *, (s + n // 2) // n mean from c0),
cell as (select c1.*, d dev_sum, row_number() over (partition by source_id, run_id, cell_row, cell_col order by scan_id) r from c1 join
  (select source_id, run_id, scan_id, cell_row, cell_col, sum(abs("value" - mean))::bigint d from samp join c1 using (source_id, run_id, scan_id)
   where pulse // 4 = cell_row and col // 4 = cell_col group by all) using (source_id, run_id, scan_id, cell_row, cell_col)),
learned as (select source_id, run_id, cell_row, cell_col, (sum(s) + sum(n) // 2)::bigint // sum(n)::bigint mean,
  case when sum(n - 1) > 0 then (sum(dev_sum) + sum(n - 1) // 2)::bigint // sum(n - 1)::bigint else 0 end dev from cell where r <= 3 group by all),
full_ as (select l.* from learned l join cell c using (source_id, run_id, cell_row, cell_col) where c.r = 3)"""
EWMA = CELLS + """,
st as (select source_id, run_id, cell_row, cell_col, 4::bigint r, mean::bigint mean, dev::bigint dev from full_ union all
  select st.source_id, st.run_id, st.cell_row, st.cell_col, st.r + 1, (3891 * st.mean + 205 * c.mean + 2048) >> 12,
    case when c.n > 1 then (3891 * st.dev + 205 * ((c.dev_sum + (c.n - 1) // 2) // (c.n - 1)) + 2048) >> 12 else st.dev end
  from st join cell c using (source_id, run_id, cell_row, cell_col) where c.r = st.r),
stats as (select c.source_id, c.run_id, c.scan_id, c.cell_row, c.cell_col, st.mean, st.dev from st join cell c using (source_id, run_id, cell_row, cell_col) where c.r = st.r)"""
SCORED = EWMA + """,
scored as (select samp.*, stats.mean, stats.dev, (case when dev = 0 then case when "value" > mean then 32767 when "value" < mean then -32768 else 0 end
  else greatest(-32768, least(32767, (("value" - mean) * 256) // dev)) end)::int score from samp join stats using (source_id, run_id, scan_id)
  where pulse // 4 = cell_row and col // 4 = cell_col),
cls as (select *, case when score >= 640 or score <= -32768 then 1 else 0 end class from scored)"""
RUNS = SCORED + """,
isl as (select source_id, run_id, scan_id, pulse, col, col - row_number() over (partition by source_id, run_id, scan_id, pulse order by col) i from cls where class = 1),
r0 as (select source_id, run_id, scan_id, pulse, min(col) col, count(*)::int length from isl group by source_id, run_id, scan_id, pulse, i),
runs as (select *, (row_number() over (partition by source_id, run_id, scan_id order by pulse, col) - 1)::int run_no from r0)"""
ADJ = RUNS + """,
adj as (select a.source_id, a.run_id, a.scan_id, a.run_no a, b.run_no b, a.pulse pulse_a, b.pulse pulse_b, least(a.col + a.length, b.col + b.length) - greatest(a.col, b.col) overlap
  from runs a join scan using (source_id, run_id, scan_id) join runs b on a.source_id = b.source_id and a.run_id = b.run_id and a.scan_id = b.scan_id and b.pulse = (a.pulse + 1) % pulses
  where pulses > 2 and least(a.col + a.length, b.col + b.length) > greatest(a.col, b.col))"""
PATCHED = ADJ + """,
both_ as (select source_id, run_id, scan_id, a x, b y from adj union all select source_id, run_id, scan_id, b, a from adj),
reach as (select source_id, run_id, scan_id, run_no x, run_no y from runs union select r.source_id, r.run_id, r.scan_id, r.x, b.y from reach r join both_ b on r.source_id = b.source_id and r.run_id = b.run_id and r.scan_id = b.scan_id and r.y = b.x),
lab as (select source_id, run_id, scan_id, x run_no, min(y)::int patch_id from reach group by all),
p0 as (select runs.*, patch_id from runs join lab using (source_id, run_id, scan_id, run_no)),
sz as (select source_id, run_id, scan_id, patch_id from p0 group by all having sum(length) > 1),
patched as (select * from p0 semi join sz using (source_id, run_id, scan_id, patch_id)),
psamp as (select p.source_id, p.run_id, p.scan_id, p.patch_id, s.pulse, s.col, s."value" from patched p join samp s on p.source_id = s.source_id and p.run_id = s.run_id and p.scan_id = s.scan_id
  and p.pulse = s.pulse and s.col >= p.col and s.col < p.col + p.length)"""
GEOM = """,
geo as (select source_id, run_id, scan_id, pulses, ts t0, unnest(range(pulses))::int pulse from scan),
pg as (select *, t0 + pulse * 2500 / 1000::double / pulses ts, pi() * (15 / 180::double + 2::double * pulse / pulses) o, radians(5::double) tl from geo),
pv as (select *, cos(tl) * sin(o) bx, cos(tl) * cos(o) by_, sin(tl) bz from pg),
tab as (select source_id, run_id, scan_id, pulse, ts, (450 - degrees(atan2(by_, bx))) % 360 azi, degrees(asin(bz)) elev,
  (450 - degrees(atan2(-bx, by_))) % 360 wg_azi, 0::double wg_elev from pv)"""
# the axis points up (elevation 90), so u1 is north, u2 is east
STATS = PATCHED + GEOM + """,
q as (select psamp.*, col + 2.5::double r, cos(radians(elev)) c, azi, elev, pulses, t0 from psamp join tab using (source_id, run_id, scan_id, pulse) join (select distinct source_id, run_id, scan_id, pulses, t0 from geo) using (source_id, run_id, scan_id)),
q1 as (select source_id, run_id, scan_id, patch_id, pulses, t0, count(*)::int ns, sum("value")::bigint v, max("value") m, sum("value"::double) sw, 5 * sum("value" * r * sin(radians(azi)) * c) / sum("value"::double) x,
  5 * sum("value" * r * cos(radians(azi)) * c) / sum("value"::double) y, 5 * sum("value" * r * sin(radians(elev))) / sum("value"::double) z0, sum(2 * r * c * c) a, min(pulse) p1, max(pulse) p2, count(distinct pulse)::int np, min(col) c1, max(col) c2 from q group by all),
ed as (select source_id, run_id, scan_id, patch_id, 10 * length * cos(radians(elev)) + 5 * (2 * pi() / pulses) * (2 * (p.col + 2) + length) * cos(radians(elev)) e from patched p join tab using (source_id, run_id, scan_id, pulse) join scan using (source_id, run_id, scan_id)
  union all select a.source_id, a.run_id, a.scan_id, patch_id, -10 * overlap * cos(radians(elev)) from adj a join patched p on a.source_id = p.source_id and a.run_id = p.run_id and a.scan_id = p.scan_id and a.a = p.run_no
  join tab t on a.source_id = t.source_id and a.run_id = t.run_id and a.scan_id = t.scan_id and a.pulse_b = t.pulse),
pe as (select source_id, run_id, scan_id, patch_id, sum(e) perim from ed group by all),
ps as (select source_id, run_id, scan_id, patch_id, x, y, z0 + 12 z, t0 + 2.5::double * ((4 * pi() + pi() / 2 - atan2(y, x) - radians(45::double)) % (2 * pi())) / (2 * pi()) t, ns, pi() * 25 / pulses * a area,
  v / (ns * 4095::double) int, m / 4095::double max, (case when p2 - p1 + 1 = pulses then np else p2 - p1 + 1 end)::int aspan, c2 - c1 + 1 rspan, sqrt(x * x + y * y + z0 * z0) "range", perim from q1 join pe using (source_id, run_id, scan_id, patch_id)),
pf as (select *, ns >= 10 and ns <= 5000 and area >= 10 and area <= 100000 and aspan >= 2 and rspan >= 2 and perim * perim / (area * 4 * pi()) < 5 is_blip from ps)"""
_R = lambda *cs, n=6: ", ".join(f"round({c}, {n}) + 0 {c.strip(chr(34))}" if c != '"range"' else f'round("range", {n}) + 0 "range"' for c in cs)
_P = 'source_id, run_id, scan_id, patch_id'
_STAT = _R("x", "y", "z", "t", "area", "int", "max", '"range"', "perim")
_STAT_COLUMNS = ["x", "y", "z", "t", "area", "int", "max", "range", "perim"]
BLIPSAMP = STATS + ",\nbs as (select psamp.* from psamp semi join (select source_id, run_id, scan_id, patch_id from pf where is_blip) using (source_id, run_id, scan_id, patch_id))"
_ZONE_XY = STATS + ",\n" + ZONES + """,
zx as (select pf.*, (select min(zone_ord) from zn where sqrt(x * x + y * y) between least(r1, r2) and greatest(r1, r2) and
  (((450 - degrees(atan2(y, x))) % 360 between a0 and a0 + ax) or (a0 + ax > 360 and (450 - degrees(atan2(y, x))) % 360 <= a0 + ax - 360))) zone_ord from pf)"""
_COMPILED = """,
zc as (select zn.*, shp.pulses, greatest(0, floor((least(r1, r2) - 10) / 5))::int s1, least(63, floor((greatest(r1, r2) - 10) / 5))::int s2, floor(((a0 - 15 + 360) % 360) / 360 * shp.pulses)::int b,
  least(shp.pulses, ceil(ax / 360 * shp.pulses))::int n from zn cross join (select distinct pulses from scan) shp),
zz as (select *, case when b + n - 1 >= pulses then -b - 1 else b end p1, case when b + n - 1 >= pulses then -(b + n - 1 - pulses) - 1 else b + n - 1 end p2 from zc)"""
_ZS = lambda only="": f"(select min(zone_ord) from zz where zz.pulses = scan.pulses and col between s1 and s2 and ((p1 >= 0 and pulse between p1 and p2) or (p1 < 0 and (pulse >= -p1 - 1 or pulse <= -p2 - 1))) {only})"

QUERIES = {
    "c01_interp_state": _interp,
    "c02_lin_interp": lambda s, d: _interp(s, d, clamp=True),
    "c03_pulse_table": lambda s, d: rounded(table(s, d), "ts", "azi", "elev", "wg_azi", "wg_elev").select(*SCAN, "pulse", "ts", "azi", "elev", "wg_azi", "wg_elev"),
    "c04_xy_to_sample_pulse": lambda s, d: blips(s, d).select("scan_id", "blip_no", "x", "y").withColumns({"pulses": F.lit(64), "sample_dist": F.lit(5.0), "first_sample_dist": F.lit(10.0), "bearing_offset": F.lit(15.0), "tilt": F.lit(5.0)}).select("scan_id", "blip_no", *[v.alias(k) for k, v in C.xy_to_sample_pulse("x + 0.1D", "y + 0.2D").items()]),
    "c05_sample_pulse_to_range_bearing": lambda s, d: rounded(samples(s, d).join(scans(s, d), SCAN).select(*SCAN, "pulse", "col", *[v.alias(k) for k, v in C.sample_pulse_to_range_bearing("(col + 1)", "(pulse + 1)").items()]), "range", "bearing_deg"),
    "c06_sample_pulse_to_spherical": lambda s, d: rounded(samples(s, d).join(scans(s, d), SCAN).select(*SCAN, "pulse", "col", *[v.alias(k) for k, v in C.sample_pulse_to_spherical("(col + 1)", "(pulse + 1)").items()]), "r", "theta", "phi"),
    "c07_planar_scale": lambda s, d: rounded(scans(s, d).select(*SCAN, *[v.alias(k) for k, v in C.planar_scale().items()]), "range_per_sample", "planar_per_sample", "elevation_per_sample"),
    "c08_dist3d": lambda s, d: rounded(_pairs(s, d).select("scan_id", "i", "j", C.dist3d().alias("dist")), "dist"),
    "c09_cos_angle3d": lambda s, d: rounded(_pairs(s, d).select("scan_id", "i", "j", F.nanvl(C.cos_angle3d(), F.lit(None)).alias("cosine")), "cosine"),
    "c10_angular_separation": lambda s, d: rounded(_pairs(s, d).where("i < j").select("scan_id", "i", "j", C.angular_separation("a_x / 400", "a_y / 2000", "b_x / 400", "b_y / 2000").alias("angle")), "angle"),
    "c11_polar_to_grid": lambda s, d: rounded(C.polar_to_grid(samples(s, d), scans(s, d), 40, 17.0, spread=2), "value").drop("source_id", "run_id"),
    "c11_polar_to_grid_turned": lambda s, d: rounded(C.polar_to_grid(_shared_numbers(s, d, samples), _shared_numbers(s, d, scans), 30, 9.0, centre=(55.0, -38.0), rotation=33.0), "value"),
    "c12_rect_to_spatial": lambda s, d: rounded(C.rect_to_spatial(S.patch_stats_rect(patch_values(s, d), scans(s, d)).withColumns({"scale": F.lit(2.5), "rotation": F.lit(30.0), "origin_x": F.lit(100.0), "origin_y": F.lit(-50.0)})).select(*S.PATCH, "x", "y", "range"), "x", "y", "range"),
    "d01_noise_filter": lambda s, d: explode_samples(B.noise_filter(pulses(s, d), 900)).select("scan_id", "pulse", "col", "value"),
    "d02_scan_cell_stats": lambda s, d: cells(s, d).withColumn("cell_col", F.col("cell_col").cast("int")),
    "d02_scan_cell_stats_sparse": lambda s, d: B.scan_cell_stats(parcels(s, d), 16, ["scan_id"]).groupBy("cell_row", "cell_col").agg(F.count("*").alias("cells"), F.sum("sum").alias("sum"), F.sum("mean").alias("mean"), F.sum("dev_sum").alias("dev_sum")),
    "d03_scan_cell_stats_excluding": lambda s, d: B.scan_cell_stats_excluding(B.paint_blips(classified(s, d), blip_samples(s, d))),
    "d04_learn_cell_stats": lambda s, d: B.learn_cell_stats(cells(s, d), LEARN),
    "d05_ewma_cell_stats": lambda s, d: B.cells_of(B.ewma_cell_stats(B.cell_row_stats(pulses(s, d)), LEARN), "mean", "dev"),
    "d07_per_angle_stats": lambda s, d: B.learn_cell_stats(cells(s, d, "angle_class", pulses(s, d).withColumn("angle_class", F.expr("cast(scan_id % 2 as int)"))), 2, ["source_id", "run_id", "angle_class"]),
    "d08_learning_epochs": lambda s, d: B.learning_epochs(scans(s, d).withColumn("restart", F.expr("scan_id % 3 = 2"))).select(*SCAN, "epoch"),
    "d09_score_samples": lambda s, d: scored(s, d).select(*SCAN, "pulse", "col", "value", "score"),
    "d10_classify_samples": lambda s, d: classified(s, d).selectExpr(*SCAN, "pulse", "col", "int(class) as class"),
    "d11_class_counts": lambda s, d: B.class_counts(classified(s, d)),
    "d12_exclude_zone_class": lambda s, d: Z.exclude_zone_class(classified(s, d), Z.compile_zones(zones(s, d), scans(s, d)), scans(s, d)).selectExpr(*SCAN, "pulse", "col", "int(class) as class"),
    "d13_exclude_zone_zero": lambda s, d: Z.exclude_zone_zero(samples(s, d), Z.compile_zones(zones(s, d), scans(s, d)), scans(s, d)).select(*SCAN, "pulse", "col", "value"),
    "d14_paint_blips": lambda s, d: B.paint_blips(classified(s, d), blip_samples(s, d)).selectExpr(*SCAN, "pulse", "col", "int(class) as class"),
    "d15_cell_lookup": lambda s, d: B.cell_lookup(points(s, d), scored(s, d), B.ewma_cell_stats(B.cell_row_stats(pulses(s, d)), LEARN)),
    "e01_hot_runs": runs,
    "e02_run_adjacency": adjacency,
    "e03_find_patches": lambda s, d: E.find_patches(runs(s, d), adjacency(s, d)).select(*SCAN, "run_no", "patch_id"),
    "e04_drop_singletons": lambda s, d: patched(s, d).select(*SCAN, "run_no", "patch_id"),
    "e05_patch_counts": lambda s, d: E.patch_counts(patches(s, d), scans(s, d)),
    "e06_patch_at": lambda s, d: E.patch_at(points(s, d).withColumnsRenamed({"pulse": "at_pulse", "col": "at_col"}), patched(s, d)),
    "e07_patch_samples": lambda s, d: E.patch_samples(patched(s, d), 64),
    "e08_gather_by_runs": lambda s, d: E.gather_by_runs(pulses(s, d), patched(s, d)).selectExpr(*SCAN, "run_no", "size(values) as n", "aggregate(values, 0L, (a, x) -> a * 7 + x) as mark"),
    "e09_scatter_by_runs": lambda s, d: E.scatter_by_runs(E.gather_by_runs(pulses(s, d), patched(s, d)), scans(s, d)).selectExpr(*SCAN, "pulse", "size(samples) as n", "aggregate(samples, 0L, (a, x) -> (a * 31 + x) % 1000003) as mark"),
    "f01_patch_stats": lambda s, d: rounded(patches(s, d), *_STAT_COLUMNS).drop("is_blip"),
    "f02_perimeter": lambda s, d: rounded(S.perimeter(patched(s, d), adjacency(s, d), table(s, d), scans(s, d)), "perim"),
    "f03_patch_stats_rect": lambda s, d: rounded(S.patch_stats_rect(patch_values(s, d), scans(s, d)), "x", "y", "t", "area", "int", "max", "perim").drop("z", "range"),
    "f04_summarize_patches": lambda s, d: rounded(S.summarize_patches(patch_values(s, d), table(s, d), scans(s, d)), "x", "y", "int", "t"),
    "f05_blip_perimeter": lambda s, d: rounded(S.blip_perimeter(patch_values(s, d), scans(s, d)), "perim"),
    "f06_filter_range": lambda s, d: Z.filter_range(Z.unfilter(patches(s, d)), samples=(4, -1), radial=(2, 6)).select(*S.PATCH, "is_blip"),
    "f07_filter_expr": lambda s, d: Z.filter_expr(Z.unfilter(patches(s, d)), "perim * perim / (area * 4 * pi()) < 3").select(*S.PATCH, "is_blip"),
    "f08_filter_chain": lambda s, d: Z.filter_chain(patches(s, d), [(lambda p: Z.filter_range(p, samples=(3, -1)), False), (Z.unfilter, True), (lambda p: Z.filter_expr(p, "max > 0.3"), False)]).select(*S.PATCH, "is_blip"),
    "f09_unfilter": lambda s, d: Z.unfilter(patches(s, d)).select(*S.PATCH, "is_blip"),
    "f10_combine_filter_record": lambda s, d: Z.combine_filter_record(_record(s, d)).select("scan_id", "blip_no", "eff_min", "eff_max", "eff_expr"),
    "f11_zone_of_xy": lambda s, d: Z.zone_of_xy(patches(s, d), zones(s, d), S.PATCH).select(*S.PATCH, "zone_ord"),
    "f12_compile_zones": lambda s, d: Z.compile_zones(zones(s, d), scans(s, d)).select("zone_ord", "pulses", "s1", "s2", "p1", "p2"),
    "f13_zone_of_sample": lambda s, d: Z.zone_of_sample(samples(s, d), Z.compile_zones(zones(s, d), scans(s, d)), scans(s, d), [*SCAN, "pulse", "col"]).groupBy("scan_id", "zone_ord").agg(F.count("*").alias("n")),
    "f14_filter_zones": lambda s, d: Z.filter_zones(patches(s, d), zones(s, d), {2: "max > 0.4"}).select(*S.PATCH, "zone_ord", "is_blip"),
    "f15_learn_clutter": lambda s, d: Z.learn_clutter(blip_samples(s, d), clutter_scans(s, d)),
    "f15_lasting_clutter_map": _lasting,
    "f16_occupancy": lambda s, d: Z.occupancy(Z.learn_clutter(blip_samples(s, d), clutter_scans(s, d))).select("pulses", "pulse", "col", "rate"),
    "f17_filter_clutter": _without_clutter,
    "f18_patch_sample_predicate": lambda s, d: Z.patch_sample_predicate(patches(s, d), patch_values(s, d), lambda rows: len(rows) % 3 == 0).select(*S.PATCH, "is_blip"),
    "i01_detect": lambda s, d: rounded(patches(s, d), *_STAT_COLUMNS).where("is_blip").drop("is_blip"),
    "i03_refilter": lambda s, d: I.refilter(patches(s, d), I.BlipParams(samples=(2, 12), area=(0.0, -1.0))).select(*S.PATCH, "is_blip"),
}
_CL = ",\ncl as (select source_id, pulses, pulse, col, count(*) hits from bs join scan using (source_id, run_id, scan_id) group by all),\nnc as (select source_id, pulses, count(*) n_scans from scan group by all)"
ORACLES = {
    "c01_interp_state": with_(PULSES, 's as (select scan_id, pulse::double t, max("value") filter (col = 3)::double u, max("value") filter (col = 9)::double v from samp where pulse % 4 = 1 group by all), n as (select *, lead(t) over w t2, lead(u) over w u2, lead(v) over w v2 from s window w as (partition by scan_id order by t)), w as (select distinct scan_id, pulse + 0.25::double "at" from samp)') + 'select w.scan_id, w."at", round(case when t2 is null then u else u + (u2 - u) * ("at" - t) / (t2 - t) end, 6) + 0 u, round(case when t2 is null then v else v + (v2 - v) * ("at" - t) / (t2 - t) end, 6) + 0 v from w left join n on w.scan_id = n.scan_id and (("at" >= t and "at" < t2) or (t2 is null and "at" = t))',
    "c02_lin_interp": with_(PULSES, 's as (select scan_id, pulse::double t, max("value") filter (col = 3)::double u from samp where pulse % 4 = 1 group by all), n as (select *, lead(t) over w t2, lead(u) over w u2 from s window w as (partition by scan_id order by t)), e as (select scan_id, min(t) lo, max(t) hi from s group by 1), w as (select distinct scan_id, pulse + 0.25::double "at", least(greatest(pulse + 0.25::double, lo), hi) h from samp join e using (scan_id))') + 'select w.scan_id, w."at", round(case when t2 is null then u else u + (u2 - u) * (h - t) / (t2 - t) end, 6) + 0 u from w join n on w.scan_id = n.scan_id and ((h >= t and h < t2) or (t2 is null and h = t))',
    "c03_pulse_table": with_(PULSES + GEOM) + f"select {META}, pulse, {_R('ts', 'azi', 'elev', 'wg_azi', 'wg_elev')} from tab",
    "c04_xy_to_sample_pulse": with_(BLIPS, "p as (select scan_id, blip_no, x + 0.1::double x, y + 0.2::double y from blips)") + "select scan_id, blip_no, (1 + floor(sqrt(x * x + y * y) / (5 * cos(radians(5::double))) - 2))::int sample, (1 + floor(((pi() / 2 - atan2(y, x) + (180 / 64::double - 15) * pi() / 180 + 4 * pi()) % (2 * pi())) / (2 * pi()) * 64))::int pulse from p",
    "c05_sample_pulse_to_range_bearing": with_(PULSES) + f'select {META}, pulse, col, round(5 * (col + 0.5::double) + 10, 6) + 0 "range", round((pulse * 360::double / pulses + 15) % 360, 6) + 0 bearing_deg from samp join scan using ({META})',
    "c06_sample_pulse_to_spherical": with_(PULSES) + f"select {META}, pulse, col, round(5 * (col + 0.5::double) + 10, 6) + 0 r, round(radians(5::double), 6) theta, round((radians(45::double) + 2 * pi() * pulse / pulses) % (2 * pi()), 6) + 0 phi from samp join scan using ({META})",
    "c07_planar_scale": with_(PULSES) + f"select {META}, 5::double range_per_sample, round(5 * cos(radians(5::double)), 6) planar_per_sample, round(5 * sin(radians(5::double)), 6) elevation_per_sample from scan",
    "c08_dist3d": with_(BLIPS) + "select a.scan_id, a.blip_no i, b.blip_no j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) + 0 dist from blips a join blips b using (scan_id)",
    "c09_cos_angle3d": with_(BLIPS) + "select a.scan_id, a.blip_no i, b.blip_no j, round((a.x * b.x + a.y * b.y + a.z * b.z) / nullif(sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z), 0), 6) + 0 cosine from blips a join blips b using (scan_id)",
    "c10_angular_separation": with_(BLIPS) + "select a.scan_id, a.blip_no i, b.blip_no j, round(acos(greatest(-1::double, least(1::double, sin(a.y / 2000) * sin(b.y / 2000) + cos(a.y / 2000) * cos(b.y / 2000) * cos(a.x / 400 - b.x / 400)))), 6) + 0 angle from blips a join blips b using (scan_id) where a.blip_no < b.blip_no",
    "c11_polar_to_grid": with_(PULSES, "g as (select scan_id, pulses, px, py, (px + 0.5::double - 20) * 17 x, (20 - py - 0.5::double) * 17 y from scan, (select unnest(range(40)) px) a, (select unnest(range(40)) py) b), h as (select scan_id, px, py, floor(sqrt(x * x + y * y) / (5 * cos(radians(5::double))) - 2)::int c, floor(((pi() / 2 - atan2(y, x) + (180::double / pulses - 15) * pi() / 180 + 4 * pi()) % (2 * pi())) / (2 * pi()) * pulses)::int p from g)") + 'select scan_id, px::int px, py::int py, round(avg("value"), 6) + 0 "value" from h join samp using (scan_id) where c >= 0 and c < 64 and pulse = p and col between c and c + 2 group by all',
    "c11_polar_to_grid_turned": with_(PULSES, "g0 as (select scan_id, run_id, pulses, px, py, (px + 0.5::double - 15) * 9 dx, (15 - py - 0.5::double) * 9 dy from scan, (select unnest(range(30)) px) a, (select unnest(range(30)) py) b), g as (select *, dx * cos(radians(33::double)) - dy * sin(radians(33::double)) + 55 x, dx * sin(radians(33::double)) + dy * cos(radians(33::double)) - 38 y from g0), h as (select scan_id, run_id, px, py, floor(sqrt(x * x + y * y) / (5 * cos(radians(5::double))) - 2)::int c, floor(((pi() / 2 - atan2(y, x) + (180::double / pulses - 15) * pi() / 180 + 4 * pi()) % (2 * pi())) / (2 * pi()) * pulses)::int p from g)") + 'select source, h.run_id, h.scan_id, px::int px, py::int py, (case when source = \'a\' then "value" else "value" // 2 end)::double + 0 "value" from h join samp on h.scan_id = samp.scan_id and pulse = p and col = c, (select unnest([\'a\', \'b\']) source) where c >= 0 and c < 64'.replace("select source,", "select source source_id,"),
    "c12_rect_to_spatial": with_(PATCHED, f'm as (select {_P}, sum("value"::double * col) / sum("value") x, sum("value"::double * pulse) / sum("value") y from psamp group by all), k as (select {_P}, 100 + 2.5::double * (x * cos(radians(30::double)) - y * sin(radians(30::double))) x, -50 + 2.5::double * (x * sin(radians(30::double)) + y * cos(radians(30::double))) y from m)') + f'select {_P}, round(x, 6) + 0 x, round(y, 6) + 0 y, round(sqrt(x * x + y * y), 6) + 0 "range" from k',
    "d01_noise_filter": with_(PULSES) + 'select scan_id, pulse, col, case when "value" < 900 then 0 else "value" end "value" from samp',
    "d02_scan_cell_stats": with_(CELLS) + f'select {META}, cell_row, cell_col, n, s "sum", mean, dev_sum from cell',
    "d02_scan_cell_stats_sparse": with_(PARCELS, 'a as (select scan_id, pulse // 16 cell_row, col // 16 cell_col, count(*) n, sum("value")::bigint s from parcels group by all), m as (select *, (s + n // 2) // n mean from a), e as (select scan_id, cell_row, cell_col, sum(abs("value" - mean))::bigint d from parcels join m using (scan_id) where pulse // 16 = cell_row and col // 16 = cell_col group by all)') + 'select cell_row, cell_col, count(*) cells, sum(s)::bigint "sum", sum(mean)::bigint mean, sum(d)::bigint dev_sum from m join e using (scan_id, cell_row, cell_col) group by all',
    "d03_scan_cell_stats_excluding": with_(BLIPSAMP, f'k as (select source_id, run_id, scan_id, pulse, col, "value", pulse // 4 cell_row, col // 4 cell_col from cls anti join bs using (source_id, run_id, scan_id, pulse, col)), a as (select {META}, cell_row, cell_col, count(*) n, sum("value")::bigint s from k group by all), m as (select *, (s + n // 2) // n mean from a)') + f'select {META}, cell_row, cell_col, n, s "sum", mean, sum(abs("value" - mean))::bigint dev_sum from k join m using ({META}, cell_row, cell_col) group by all',
    "d04_learn_cell_stats": with_(CELLS) + "select * from learned",
    "d05_ewma_cell_stats": with_(EWMA) + "select * from stats",
    "d07_per_angle_stats": with_(CELLS, "a as (select *, (scan_id % 2)::int angle_class, row_number() over (partition by source_id, run_id, scan_id % 2, cell_row, cell_col order by scan_id) k from cell)") + "select source_id, run_id, angle_class, cell_row, cell_col, (sum(s) + sum(n) // 2)::bigint // sum(n)::bigint mean, case when sum(n - 1) > 0 then (sum(dev_sum) + sum(n - 1) // 2)::bigint // sum(n - 1)::bigint else 0 end dev from a where k <= 2 group by all",
    "d08_learning_epochs": with_(PULSES) + f"select {META}, (sum((scan_id % 3 = 2)::int) over (partition by source_id, run_id order by scan_id))::bigint epoch from scan",
    "d09_score_samples": with_(SCORED) + f'select {META}, pulse, col, "value", score from scored',
    "d10_classify_samples": with_(SCORED) + f"select {META}, pulse, col, class from cls",
    "d11_class_counts": with_(SCORED) + f"select {META}, count(*) filter (class = 0) n_cold, count(*) filter (class = 1) n_hot from cls group by all",
    "d12_exclude_zone_class": with_(SCORED, ZONES + _COMPILED) + f"select {META}, pulse, col, case when {_ZS(' and zone_ord = 0')} is null then class else 4 end class from cls join scan using ({META})",
    "d13_exclude_zone_zero": with_(PULSES, ZONES + _COMPILED) + f'select {META}, pulse, col, case when {_ZS(" and zone_ord = 0")} is null then "value" else 0 end "value" from samp join scan using ({META})',
    "d14_paint_blips": with_(BLIPSAMP) + f"select {META}, pulse, col, case when bs.patch_id is not null then 2 else class end class from cls left join bs using ({META}, pulse, col)",
    "d15_cell_lookup": with_(SCORED) + f'select {META}, pulse, col, "value", score, pulse // 4 cell_row, col // 4 cell_col, mean, dev from scored where pulse % 7 = 3 and col % 9 = 4',
    "e01_hot_runs": with_(RUNS) + "select * from runs",
    "e02_run_adjacency": with_(ADJ) + "select * from adj",
    "e03_find_patches": with_(PATCHED) + f"select {META}, run_no, patch_id from p0",
    "e04_drop_singletons": with_(PATCHED) + f"select {META}, run_no, patch_id from patched",
    "e05_patch_counts": with_(STATS, f"k as (select {META}, count(*) n_patches, count(*) filter (is_blip) n_blips, sum(ns)::bigint n_samples from pf group by all)") + f"select {META}, coalesce(n_patches, 0) n_patches, coalesce(n_blips, 0) n_blips, coalesce(n_samples, 0) n_samples, (sum(coalesce(n_blips, 0)) over (partition by source_id, run_id order by scan_id))::bigint total_blips from scan left join k using ({META})",
    "e06_patch_at": with_(PATCHED, f"o as (select {_P}, row_number() over (partition by {META} order by patch_id)::int patch_no from (select distinct {_P} from psamp))") + f"select {_P}, a.pulse at_pulse, a.col at_col, patch_no, b.pulse, b.col from psamp a join psamp b using ({_P}) join o using ({_P}) where a.pulse % 7 = 3 and a.col % 9 = 4",
    "e07_patch_samples": with_(PATCHED) + f'select {_P}, pulse, col, pulse::bigint * 64 + col "index" from psamp',
    "e08_gather_by_runs": with_(PATCHED) + f'select p.source_id, p.run_id, p.scan_id, run_no, length n, list_reduce(list_prepend(0::bigint, list("value" order by s.col)::bigint[]), lambda a, x: a * 7 + x) mark from patched p join psamp s on p.source_id = s.source_id and p.run_id = s.run_id and p.scan_id = s.scan_id and p.patch_id = s.patch_id and p.pulse = s.pulse and s.col between p.col and p.col + p.length - 1 group by all',
    "e09_scatter_by_runs": with_(PATCHED, f"f as (select s.source_id, s.run_id, s.scan_id, s.pulse, s.col, coalesce(p.\"value\", 0) v from samp s left join psamp p using ({META}, pulse, col))") + f"select {META}, pulse, 64 n, list_reduce(list_prepend(0::bigint, list(v order by col)::bigint[]), lambda a, x: (a * 31 + x) % 1000003) mark from f group by all",
    "f01_patch_stats": with_(STATS) + f"select {_P}, {_STAT}, ns, aspan, rspan from ps",
    "f02_perimeter": with_(STATS) + f"select {_P}, {_R('perim')} from pe",
    "f03_patch_stats_rect": with_(PATCHED, "n4 as (select a.*, (select count(*) from psamp b where b.source_id = a.source_id and b.run_id = a.run_id and b.scan_id = a.scan_id and b.patch_id = a.patch_id and abs(a.pulse - b.pulse) + abs(a.col - b.col) = 1) k from psamp a)") + f'select {_P}, round(sum("value"::double * col) / sum("value"), 6) + 0 x, round(sum("value"::double * pulse) / sum("value"), 6) + 0 y, round(any_value(scan_id * 2.5::double), 6) t, count(*)::int ns, count(*) * 25::double area, round(sum("value") / (count(*) * 4095::double), 6) + 0 int, round(max("value") / 4095::double, 6) + 0 max, max(pulse) - min(pulse) + 1 aspan, max(col) - min(col) + 1 rspan, 5::double * sum(4 - k) perim from n4 group by all',
    "f04_summarize_patches": with_(STATS, f'w as (select *, 5 * (r - 2) + 10 rr from q)') + f'select {_P}, count(*)::int ns, round(sum(rr * "value" * rr * c * sin(radians(azi))) / sum(rr * "value"), 6) + 0 x, round(sum(rr * "value" * rr * c * cos(radians(azi))) / sum(rr * "value"), 6) + 0 y, round(sum(rr * "value") / sum(rr) / 4095::double, 6) + 0 int, round(any_value(t0) + 2.5::double * avg(pulse) / any_value(pulses), 6) + 0 t from w group by all',
    "f05_blip_perimeter": with_(PATCHED, "j as (select psamp.*, pulses from psamp join scan using (source_id, run_id, scan_id)), n4 as (select a.*, (select count(*) from j b where b.source_id = a.source_id and b.run_id = a.run_id and b.scan_id = a.scan_id and b.patch_id = a.patch_id and a.col = b.col and (a.pulse + 1) % a.pulses = b.pulse) ku, (select count(*) from j b where b.source_id = a.source_id and b.run_id = a.run_id and b.scan_id = a.scan_id and b.patch_id = a.patch_id and a.pulse = b.pulse and a.col + 1 = b.col) kr, (select count(*) from j b where b.source_id = a.source_id and b.run_id = a.run_id and b.scan_id = a.scan_id and b.patch_id = a.patch_id and a.pulse = b.pulse and a.col - 1 = b.col) kl from j a)") + f"select {_P}, (sum(2 - 2 * ku) + sum(2 - 2 * kr))::bigint edges, round(5::double * sum(2 - 2 * ku) + sum((1 - kl) * 2 * pi() / pulses * (col * 5 + 10) + (1 - kr) * 2 * pi() / pulses * ((col + 1) * 5 + 10)), 6) + 0 perim from n4 group by all",
    "f06_filter_range": with_(STATS) + f"select {_P}, ns >= 4 and rspan between 2 and 6 is_blip from ps",
    "f07_filter_expr": with_(STATS) + f"select {_P}, perim * perim / (area * 4 * pi()) < 3 is_blip from ps",
    "f08_filter_chain": with_(STATS) + f"select {_P}, ns >= 3 and max > 0.3::double is_blip from ps",
    "f09_unfilter": with_(STATS) + f"select {_P}, true is_blip from ps",
    "f10_combine_filter_record": with_(BLIPS, "r as (select scan_id, blip_no, (scan_id % 7)::double a1, (blip_no % 5)::double a2, case when scan_id % 3 = 0 then -1 else 20 + scan_id % 4 end::double b1, case when blip_no % 4 = 0 then -1 else 15 + blip_no end::double b2, case when blip_no % 2 = 0 then '(ns > 3)' end e1, case when scan_id % 5 <> 0 then '(area < 9)' end e2 from blips)") + "select scan_id, blip_no, greatest(a1, a2) eff_min, case when b1 < 0 then b2 when b2 < 0 then b1 else least(b1, b2) end eff_max, nullif(concat_ws(' AND ', e1, e2), '') eff_expr from r",
    "f11_zone_of_xy": with_(_ZONE_XY) + f"select {_P}, zone_ord from zx",
    "f12_compile_zones": with_(PULSES, ZONES + _COMPILED) + "select zone_ord, pulses, s1, s2, p1, p2 from zz",
    "f13_zone_of_sample": with_(PULSES, ZONES + _COMPILED) + f"select scan_id, zone_ord, count(*) n from (select scan_id, {_ZS()} zone_ord from samp join scan using ({META})) group by all",
    "f14_filter_zones": with_(_ZONE_XY) + f"select {_P}, zone_ord, (case when zone_ord is null then is_blip when zone_ord = 0 then false else ns >= 2 and area between 20 and 9000 and rspan between 0 and 12 end) and (coalesce(zone_ord, -1) <> 2 or max > 0.4::double) is_blip from zx",
    "f15_learn_clutter": with_(BLIPSAMP + _CL) + "select source_id, 5 angle_class, pulses, 64 samples_per_pulse, pulse, col, hits, n_scans from cl join nc using (source_id, pulses)",
    "f15_lasting_clutter_map": with_(BLIPSAMP, "ch as (select *, coalesce((pulses <> lag(pulses) over w)::int, 0) c from scan window w as (partition by source_id order by ts, run_id, scan_id)), nn as (select *, sum(c) over (partition by source_id order by ts, run_id, scan_id) k from ch), lst as (select * from nn qualify k = max(k) over (partition by source_id)), hh as (select source_id, pulses, pulse, col, count(*) hits from bs join lst using (source_id, run_id, scan_id) group by all), ns as (select source_id, pulses, count(*) n_scans from lst group by all)") + "select source_id, 5 angle_class, pulses, 64 samples_per_pulse, pulse, col, hits, n_scans from hh join ns using (source_id, pulses)",
    "f16_occupancy": with_(BLIPSAMP + _CL) + "select pulses, pulse, col, hits / n_scans rate from cl join nc using (source_id, pulses)",
    "f17_filter_clutter": with_(BLIPSAMP + _CL, f"h as (select bs.source_id, bs.run_id, bs.scan_id, bs.patch_id, avg(hits) h, max(n_scans) n from bs join scan using ({META}) join cl on cl.source_id = bs.source_id and cl.pulses = scan.pulses and cl.pulse = bs.pulse and cl.col = bs.col join nc on nc.source_id = bs.source_id and nc.pulses = scan.pulses group by all)") + f"select {_P}, is_blip and not coalesce(h >= 0.15::double * n, false) is_blip from pf left join h using ({_P})",
    "f18_patch_sample_predicate": with_(STATS) + f"select {_P}, is_blip and ns % 3 = 0 is_blip from pf",
    "i01_detect": with_(STATS) + f"select {_P}, {_STAT}, ns, aspan, rspan from pf where is_blip",
    "i03_refilter": with_(STATS) + f"select {_P}, ns between 2 and 12 and area >= 0 and aspan >= 2 and rspan >= 2 is_blip from ps",
}
