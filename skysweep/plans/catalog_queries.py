"""Queries over scan catalogues and metadata, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep.functions.stored import new_path
from skysweep.plans.derived import PULSES, SWEEPS, pulses, sweeps, with_
from skysweep.sources import scans as A
from skysweep.sources import sinks as K

RUN = "source_id, run_id"


def _packed(s, d, bits):
    """Pulses as big-endian blobs of 16 bits a sample, or of 12 bits."""
    digits = {16: 4, 12: 3}[bits]
    blob = f"unhex(array_join(transform(samples, x -> lpad(hex(x), {digits}, '0')), ''))"
    return pulses(s, d).selectExpr("scan_id", "pulse", f"{blob} as blob", "size(samples) as n", f"{bits} as bits", "true as big_endian", "false as deflated")


def archived(s, d, *columns, **of):
    """The pulses, written as an archive and read back."""
    rows, path = pulses(s, d), new_path(s, "scans")
    K.write_scans(rows, path)
    return A.read_scans(s, path, columns=columns, schema=rows.schema, **of)


def _unpacked(s, d):
    both = A.unpack_samples(_packed(s, d, 16), ["scan_id", "pulse", "bits"]).unionByName(A.unpack_samples(_packed(s, d, 12), ["scan_id", "pulse", "bits"]))
    return both.selectExpr("scan_id", "pulse", "bits", "size(samples) as n", "aggregate(samples, 0L, (a, x) -> a * 31 % 1000003 + x) as mark")


def _antennas(s, d):
    return sweeps(s, d).groupBy("source_id").agg(F.expr("cast(count(*) % 360 as double)").alias("bearing"), F.expr("20D").alias("elevation")).selectExpr("*", "source_id = 'radar1' as override_bearing", "false as override_elevation")


def _comments(s, d):
    return sweeps(s, d).where("scan_id % 8 = 3").selectExpr("source_id", "ts + 1D as entered_ts", "concat('note ', scan_id) as comment")


def _times(s, d):
    return sweeps(s, d).groupBy("source_id", "run_id").agg(F.expr("min(ts) + 13.3D").alias("wanted")).drop("run_id")


def _simplified(s, d, kept):
    rows = pulses(s, d).selectExpr("scan_id", "cast(pulse as double) as t", "cast(samples[7] as double) as s")
    return A.simplify_series(rows, ["scan_id"], 120.0) if kept else A.approx_error(rows, A.simplify_series(rows, ["scan_id"], 120.0), ["scan_id"]).selectExpr("scan_id", "max_error <= 120.000001D as within")


def _thinned(s, d):
    """The error of keeping every eighth point and the last, with what a curve of slope 50 may do between the points."""
    rows = pulses(s, d).selectExpr("scan_id", "cast(pulse as double) as t", "cast(samples[7] as double) as s")
    kept = rows.join(rows.groupBy("scan_id").agg(F.max("t").alias("last")), "scan_id").where("t % 8 = 0 or t = last").drop("last")
    return A.approx_error(rows, kept, ["scan_id"], 50.0).withColumn("max_error", F.expr("round(max_error, 6) + 0"))


def _angles(s, d):
    return sweeps(s, d).selectExpr("source_id", "run_id", "ts as t", "cast(pmod(scan_id * 37, 90) as double) as angle")


QUERIES = {
    "a01_read_scans": lambda s, d: archived(s, d, "source_id", "run_id", "scan_id", "pulse", "samples", source_id="radar0").selectExpr("source_id", "run_id", "scan_id", "pulse", "size(samples) as n", "aggregate(samples, 0L, (a, x) -> a + x) as total"),
    "a02_unpack_samples": _unpacked,
    "a03_explode_samples": lambda s, d: A.explode_samples(pulses(s, d)),
    "a04_contents": lambda s, d: A.contents(sweeps(s, d)),
    "a05_seek_scan": lambda s, d: A.seek_scan(sweeps(s, d), "radar0", 1, 30).select("source_id", "run_id", "scan_id", "ts"),
    "a06_seek_time": lambda s, d: A.seek_time(sweeps(s, d), _times(s, d)),
    "a07_first_scan_offsets": lambda s, d: A.first_scan_offsets(sweeps(s, d)),
    "a08_expand_scan_info": lambda s, d: A.expand_scan_info(sweeps(s, d), ["bearing", "elevation"]).select("source_id", "run_id", "scan_id", "bearing", "elevation"),
    "a09_diff_scan_info": lambda s, d: A.diff_scan_info(sweeps(s, d), ["duration_ms", "elevation"]).select("source_id", "run_id", "scan_id", "duration_ms", "elevation"),
    "a10_apply_antenna": lambda s, d: A.apply_antenna(sweeps(s, d), _antennas(s, d), ["bearing", "elevation"]).select("source_id", "scan_id", "bearing", "elevation"),
    "a11_attach_comments": lambda s, d: A.attach_comments(sweeps(s, d), _comments(s, d)).select("source_id", "scan_id", "user_comment"),
    "a12_resolve_timestamp": lambda s, d: A.resolve_timestamp(sweeps(s, d), 1704067200.0, 2.4).select("source_id", "scan_id", "ts"),
    "a13_duration_from_next": lambda s, d: A.duration_from_next(sweeps(s, d), 2500.0).selectExpr("source_id", "scan_id", "round(duration_ms, 6) as duration_ms"),
    "a14_repair_durations": lambda s, d: A.repair_durations(sweeps(s, d)).selectExpr("source_id", "scan_id", "round(duration_ms, 6) as duration_ms"),
    "a15_drop_split_scans": lambda s, d: A.drop_split_scans(sweeps(s, d).withColumn("ts", F.expr("floor(ts / 5) * 5D"))).select("source_id", "scan_id", "ts", "duration_ms"),
    "a16_mean_antenna_angle": lambda s, d: A.mean_antenna_angle(_angles(s, d), ["source_id", "run_id"]).selectExpr("source_id", "run_id", "round(mean_angle, 9) as mean_angle"),
    "a17_angle_class": lambda s, d: sweeps(s, d).selectExpr("source_id", "scan_id", "cast(scan_id as double) / 2D as mean_angle").select("source_id", "scan_id", A.angle_class().alias("angle_class")),
    "a18_decode_dbz": lambda s, d: A.explode_samples(pulses(s, d)).withColumn("code", F.expr("value % 256")).select("scan_id", "pulse", "col", A.decode_dbz("code").alias("dbz")),
    "a19_sample_to_dbm": lambda s, d: A.explode_samples(pulses(s, d)).select("scan_id", "pulse", "col", F.round(A.sample_to_dbm("value"), 9).alias("dbm")),
    "a20_scale_frames": lambda s, d: A.scale_frames(pulses(s, d).selectExpr("scan_id as frame", "pulse", "transform(samples, x -> x % 256) as samples"), 25.0).selectExpr("frame", "pulse", "round(ts, 9) as ts", "duration_ms", "bits_per_sample", "is_rectangular", "aggregate(samples, 0L, (a, x) -> a + x) as total"),
    "a21_simplify_series": lambda s, d: _simplified(s, d, True),
    "a21_approx_error": lambda s, d: _simplified(s, d, False),
    "a21_approx_error_thinned": _thinned,
}

ORACLES = {
    "a01_read_scans": with_(PULSES) + 'select source_id, run_id, scan_id, pulse, count(*)::int n, sum("value")::bigint total from samp where source_id = \'radar0\' group by all',
    "a02_unpack_samples": with_(PULSES, 'l as (select scan_id, pulse, list("value" order by col) v from samp group by all)') + "select scan_id, pulse, b bits, len(v)::int n, list_reduce(list_prepend(0::bigint, v::bigint[]), lambda a, x: a * 31 % 1000003 + x) mark from l cross join (values (12), (16)) t(b)",
    "a03_explode_samples": with_(PULSES) + 'select source_id, run_id, scan_id, pulse, col, "value" from samp',
    "a04_contents": with_(SWEEPS) + f"select {RUN}, min(ts) start_ts, max(ts + duration_ms / 1000) end_ts, count(*) n_scans, avg(duration_ms) mean_duration_ms from sweeps group by all",
    "a05_seek_scan": with_(SWEEPS) + "select source_id, run_id, scan_id, ts from sweeps where source_id = 'radar0' and run_id = 1 and scan_id >= 30",
    "a06_seek_time": with_(SWEEPS, f"w as (select source_id, min(ts) + 13.3::double wanted from sweeps group by source_id, run_id), r as (select {RUN}, min(ts) a, max(ts) b from sweeps group by all)") + "select w.source_id, r.run_id, wanted, (select s.scan_id from sweeps s where s.source_id = r.source_id and s.run_id = r.run_id and s.ts >= least(wanted, r.b) order by s.ts limit 1) scan_id from w join r on w.source_id = r.source_id and wanted >= a and wanted <= b + 5",
    "a07_first_scan_offsets": with_(SWEEPS, f"c as (select {RUN}, count(*) n_scans from sweeps group by all)") + "select *, (coalesce(sum(n_scans) over (partition by source_id order by run_id rows between unbounded preceding and 1 preceding), 0) + 1)::bigint first_scan from c",
    "a08_expand_scan_info": with_(SWEEPS) + f"select {RUN}, scan_id, coalesce(bearing, first_value(bearing) over w) bearing, coalesce(elevation, first_value(elevation) over w) elevation from sweeps window w as (partition by {RUN} order by scan_id)",
    "a09_diff_scan_info": with_(SWEEPS, f"f as (select *, first_value(duration_ms) over w d1, first_value(elevation) over w e1, row_number() over w n from sweeps window w as (partition by {RUN} order by scan_id))") + f"select {RUN}, scan_id, case when n = 1 or duration_ms is distinct from d1 then duration_ms end duration_ms, case when n = 1 or elevation is distinct from e1 then elevation end elevation from f",
    "a10_apply_antenna": with_(SWEEPS, "a as (select source_id, (count(*) % 360)::double b from sweeps group by 1)") + "select source_id, scan_id, case when source_id = 'radar1' then b else coalesce(bearing, b) end bearing, coalesce(elevation, 20::double) elevation from sweeps join a using (source_id)",
    "a11_attach_comments": with_(SWEEPS, "c as (select source_id, ts + 1 e, 'note ' || scan_id note from sweeps where scan_id % 8 = 3), g as (select c.source_id, note, e, (select s.scan_id from sweeps s where s.source_id = c.source_id and s.ts >= c.e order by s.ts limit 1) scan_id from c), l as (select source_id, scan_id, arg_max(note, e) note from g group by all)") + "select source_id, scan_id, coalesce(note, user_comment) user_comment from sweeps left join l using (source_id, scan_id)",
    "a12_resolve_timestamp": with_(SWEEPS) + f"select source_id, scan_id, case when embedded_ts > 946684800 then embedded_ts when time_of_day is not null then 1704067200::double + time_of_day else 1704067200::double + (row_number() over (partition by {RUN} order by scan_id) - 1) * 2.4::double end ts from sweeps",
    "a13_duration_from_next": with_(SWEEPS) + f"select source_id, scan_id, round(coalesce((lead(ts) over (partition by {RUN} order by ts, scan_id) - ts) * 1000, 2500), 6) duration_ms from sweeps",
    "a14_repair_durations": with_(SWEEPS, f"g as (select *, (lead(ts) over (partition by {RUN} order by ts, scan_id) - ts) * 1000 g from sweeps), m as (select *, avg(g) over (partition by {RUN}) m from g)") + "select source_id, scan_id, round(case when g is not null then g when abs(duration_ms - m) > 0.2::double * m then m else duration_ms end, 6) duration_ms from m",
    "a15_drop_split_scans": with_(SWEEPS, f"f as (select * replace (floor(ts / 5) * 5 as ts) from sweeps), n as (select *, lead(ts) over (partition by {RUN} order by ts, scan_id) nx from f)") + "select source_id, scan_id, ts, case when duration_ms = 0 then 2400 else duration_ms end duration_ms from n where nx is null or nx <> ts",
    "a16_mean_antenna_angle": with_(SWEEPS, f"p as (select {RUN}, ts t, (scan_id * 37 % 90)::double angle from sweeps), w as (select *, (coalesce(lead(t) over x, t) - coalesce(lag(t) over x, t)) / 2 w from p window x as (partition by {RUN} order by t))") + f"select {RUN}, round(sum(angle * w) / sum(w), 9) mean_angle from w group by all",
    "a17_angle_class": with_(SWEEPS) + "select source_id, scan_id, round_even(scan_id::double / 2, 0)::int angle_class from sweeps",
    "a18_decode_dbz": with_(PULSES) + 'select scan_id, pulse, col, case when "value" % 256 in (0, 255) then null else ("value" % 256 - 64) / 2::double end dbz from samp',
    "a19_sample_to_dbm": with_(PULSES) + 'select scan_id, pulse, col, round(-48.34::double + 0.01738::double * "value" - 0.802::double * 61, 9) dbm from samp',
    "a20_scale_frames": with_(PULSES) + 'select scan_id frame, pulse, round(scan_id / 25::double, 9) ts, 40::double duration_ms, 15 bits_per_sample, true is_rectangular, sum("value" % 256 * 128)::bigint total from samp group by all',
    "a21_approx_error_thinned": with_(PULSES, 'p as (select scan_id, pulse::double t, "value"::double s from samp where col = 7), m as (select scan_id, max(t) last from p group by all), n as (select *, lead(t) over (partition by scan_id order by t) t2, lead(s) over (partition by scan_id order by t) s2 from p), w as (select *, least(abs(s2 - s) / 50, t2 - t) w from n where t2 is not null), q as (select scan_id, t a, s own from p union all select scan_id, t + w, s2 from w union all select scan_id, t2 - w, s from w), k0 as (select p.* from p join m using (scan_id) where t % 8 = 0 or t = last), k as (select *, lead(t) over (partition by scan_id order by t) t2, lead(s) over (partition by scan_id order by t) s2 from k0)') + "select q.scan_id, round(max(abs(own - case when k.t2 is null then k.s else k.s + (k.s2 - k.s) * (a - k.t) / (k.t2 - k.t) end)), 6) + 0 max_error from q join k on q.scan_id = k.scan_id and a >= k.t and (a < k.t2 or k.t2 is null) group by all",
    "a21_approx_error": with_(PULSES) + 'select distinct scan_id, true as "within" from samp',
}
