"""Queries over tracks, trails, sinks and whole jobs, with their SQL for DuckDB."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from skysweep.operators import tracking as G
from skysweep.operators import trails as H
from skysweep.plans import detect
from skysweep.plans import detection_queries as Q
from skysweep.plans.catalog_queries import archived
from skysweep.plans.derived import BLIPS, PULSES, blips, pulses, scans, sweeps, with_
from skysweep.plans.detection_queries import _P, BLIPSAMP, SCAN, STATS, rounded
from skysweep.sources import sinks as K

SPEED = 3000.0
COUPLED = detect.Params.of({"find": {"learn_scans": 3}, "blip": {"samples": (10, 5000), "area": (10.0, 100000.0)}, "track": {"min_blips": 2, "max_speed_kmh": 400.0}, "mfc": {"min_gain": 0.3}, "zones": {"expressions": {2: "max > 0.4"}}})

IN_ROUNDS = replace(COUPLED, find=replace(COUPLED.find, in_rounds=True))


def events(s, d):
    return blips(s, d).withColumnRenamed("blip_no", "blip_id").withColumn("max_dist", F.lit(8000.0))


def chains(s, d):
    """Tracks by rule: the blips of one number in one run, in blocks of seven scans."""
    return events(s, d).withColumn("track_id", F.expr("blip_id * 1000 + scan_id div 7")).withColumn("seq", F.col("scan_id") % 7)


def cut_at(s, d):
    return chains(s, d).where("scan_id % 7 = 4 and blip_id % 3 = 0").select("source_id", "run_id", "track_id", "scan_id", "blip_id")


def moving(s, d):
    """Candidate pairs over up to two scans, whose first blip has a velocity."""
    first = G.new_state(chains(s, d)).where("vx is not null")
    return G.candidate_pairs(events(s, d), 3, SPEED, first=first, own=["vx", "vy", "vz"]).withColumn("max_dist", F.lit(8000.0))


def good(s, d):
    return Q.patches(s, d).where("is_blip")


def good_samples(s, d):
    return K.blip_sample_rows(Q.patch_values(s, d).join(Q.scored(s, d).select(*SCAN, "pulse", "col", "score"), [*SCAN, "pulse", "col"]), good(s, d))


def tracked(s, d, model):
    rows = good(s, d).withColumnRenamed("patch_id", "blip_id")
    if model == "mfc":
        return G.track_mfc(rows, scans(s, d), frames=2, max_dist=800.0, max_speed_kmh=400.0, min_gain=0.3)
    return G.track_nn(rows, scans(s, d), max_speed_kmh=400.0, max_change_percent=400.0, max_turn_rate=60.0)


def _exported(s, d):
    rows = K.export_blips(good_samples(s, d), good(s, d), Q.table(s, d), scans(s, d))
    return rows.selectExpr(*SCAN, "patch_id", "size(cells) as n", "round(aggregate(cells, 0D, (a, x) -> a + x.dbm), 6) + 0 as dbm", "round(aggregate(cells, 0D, (a, x) -> a + x.r), 6) + 0 as r", "round(aggregate(cells, 0D, (a, x) -> a + x.phi), 6) + 0 as phi")


def _dense(s, d):
    return K.read_blip_samples(good_samples(s, d), scans(s, d)).selectExpr(*SCAN, "pulse", "aggregate(samples, 0L, (a, x) -> a + x) as total", "aggregate(classes, 0L, (a, x) -> a + x) as marks")


QUERIES = {
    "b01_write_blips_csv": lambda s, d: K.format_blips(good(s, d)).select("source_id", "run_id", *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in K.BLIP_COLUMNS.split(",")]),
    "b02_write_tracks_csv": lambda s, d: K.format_tracks(tracked(s, d, "mfc"), good(s, d)).select("source_id", "run_id", *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in K.TRACK_COLUMNS.split(",")]),
    "b03_write_blip_samples": lambda s, d: good_samples(s, d).select(*SCAN, "patch_id", "pulse", "col", "value", "score"),
    "b04_read_blip_samples": _dense,
    "b05_write_blip_scores": lambda s, d: K.blip_scores(good_samples(s, d), good(s, d), scans(s, d)).selectExpr(*SCAN, "ts", "size(scores) as n", "aggregate(scores, 0L, (a, x) -> (a * 31 + x) % 1000003) as mark"),
    "b06_write_scans": lambda s, d: archived(s, d, "source_id", "run_id", "scan_id").groupBy("source_id", "run_id").agg(F.count("*").alias("n_pulses"), F.count_distinct("scan_id").alias("n_scans")),
    "b07_export_blips": _exported,
    "g01_candidate_pairs": lambda s, d: rounded(G.candidate_pairs(events(s, d), 3, SPEED).select("source_id", "run_id", "u_scan", "u_blip_id", "v_scan", "v_blip_id", "dist", "dt"), "dist", "dt"),
    "g02_gain_pp": lambda s, d: rounded(G.candidate_pairs(events(s, d), 3, SPEED).withColumn("max_dist", F.lit(8000.0)).select("u_scan", "u_blip_id", "v_scan", "v_blip_id", G.gain_pp().alias("gain")), "gain", digits=9),
    "g03_gain_tp": lambda s, d: rounded(moving(s, d).select("u_scan", "u_blip_id", "v_scan", "v_blip_id", G.gain_tp(min_gain=0.6).alias("gain")), "gain", digits=9),
    "g04_new_state": lambda s, d: rounded(G.new_state(chains(s, d)).select("track_id", "run_id", "seq", "vx", "vy", "vz"), "vx", "vy", "vz"),
    "g05_max_pair_distance": lambda s, d: rounded(scans(s, d).withColumn("tilt", F.expr("cast(scan_id % 90 as double)")).select(*SCAN, G.max_pair_distance().alias("max_dist")), "max_dist"),
    "g06_track_mfc": lambda s, d: tracked(s, d, "mfc"),
    "g06_track_mfc_events": lambda s, d: G.track_mfc(events(s, d), None, frames=3, max_dist=8000.0, max_speed_kmh=900.0),
    "g06_track_mfc_slices": lambda s, d: G.track_mfc(events(s, d), None, (12, 4), frames=2, max_dist=8000.0, max_speed_kmh=900.0),
    "g07_track_nn_slices": lambda s, d: G.track_nn(events(s, d), sweeps(s, d), (12, 6), max_speed_kmh=900.0, max_change_percent=900.0),
    "g07_track_nn": lambda s, d: tracked(s, d, "nn"),
    "g08_nn_gates": lambda s, d: G.nn_gates(events(s, d), SPEED).select("v_scan", "u_blip_id", "v_blip_id", "too_fast", "area_changed", "int_changed", "passes"),
    "g08_nn_gates_near": lambda s, d: G.nn_gates(events(s, d), 1500.0, near=True).select("v_scan", "u_blip_id", "v_blip_id", "area_changed", "int_changed", "passes"),
    "g11_filter_short_tracks": lambda s, d: G.filter_short_tracks(chains(s, d), 5).select("run_id", "track_id", "seq", "blip_id"),
    "g12_track_summary": lambda s, d: rounded(G.track_summary(chains(s, d)), "length_m", "mean_speed_kmh"),
    "g13_tracks_in_interval": lambda s, d: G.tracks_in_interval(G.track_summary(chains(s, d)), 100.0, 200.0).select("run_id", "track_id", "t_start", "t_end"),
    "g14_scan_track_index": lambda s, d: G.scan_track_index(chains(s, d), events(s, d)).withColumn("track_ids", F.array_join("track_ids", ",")),
    "g15_gain_log_units": lambda s, d: rounded(blips(s, d).select("scan_id", "blip_no", G.gain_to_log_units("int").alias("units")).withColumn("gain", G.log_units_to_gain()), "units", "gain"),
    "g17_truncate_track": lambda s, d: G.truncate_track(chains(s, d), cut_at(s, d)).select("run_id", "track_id", "seq", "blip_id"),
    "g18_match_adjacent": lambda s, d: G.match_adjacent(events(s, d), max_dist=8000.0, max_speed_kmh=SPEED),
    "h01_trails_last_n": lambda s, d: rounded(H.trails_last_n(good_samples(s, d), scans(s, d), 4), "faded"),
    "h02_trails_storage": lambda s, d: H.trails_storage(good_samples(s, d)),
    "h03_blip_cross_section": lambda s, d: rounded(H.blip_cross_section(good_samples(s, d), Q.table(s, d)), "angle", digits=5),
    "h04_blips_in_time": lambda s, d: H.blips_in_time(events(s, d), 100.0, 200.0).select("scan_id", "blip_id", "t"),
    "h05_blip_file_summary": lambda s, d: H.blip_file_summary(events(s, d)),
    "d06_detect_coupled": lambda s, d: detect.detect(pulses(s, d), scans(s, d), COUPLED),
    "d06_detect_in_rounds": lambda s, d: detect.detect(pulses(s, d), scans(s, d), IN_ROUNDS),
    "i02_detect_and_track": lambda s, d: detect.detect_and_track(pulses(s, d), scans(s, d), COUPLED, Q.zones(s, d).where("zone_id <> 'exclusion'"))[1],
    "i03_retrack": lambda s, d: G.track_nn(events(s, d), sweeps(s, d), max_speed_kmh=900.0, max_change_percent=900.0),
}

_TEXT = "strftime(make_timestamp((t * 1000000)::bigint), '%Y/%m/%d') date, strftime(make_timestamp((t * 1000000)::bigint), '%H:%M:%S') \"time\", printf('%.3f', t) \"timestamp\", printf('%.0f', x) x, printf('%.0f', y) y, printf('%.0f', z) z, ns::varchar ns, printf('%.0f', area) area, printf('%.3f', int) int, printf('%.3f', max) max, aspan::varchar aspan, rspan::varchar rspan, printf('%.0f', perim) perim"
_CHAIN = BLIPS + ",\nch as (select *, blip_no * 1000 + scan_id // 7 track_id, scan_id % 7 seq from blips)"
_STEP = _CHAIN + ",\nnv as (select *, (x - lag(x) over w) / (t - lag(t) over w) vx, (y - lag(y) over w) / (t - lag(t) over w) vy, (z - lag(z) over w) / (t - lag(t) over w) vz, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2) st from ch window w as (partition by source_id, run_id, track_id order by seq))"
_PAIR = ",\npr as (select u.source_id, u.run_id, u.scan_id u_scan, u.blip_no u_blip_id, v.scan_id v_scan, v.blip_no v_blip_id, u.x ux, u.y uy, u.z uz, v.x wx, v.y wy, v.z wz, sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2) dist, v.t - u.t dt, v.scan_id - u.scan_id step from blips u join blips v on u.source_id = v.source_id and u.run_id = v.run_id and v.scan_id in (u.scan_id + 1, u.scan_id + 2)),\ncp as (select * from pr where dt <> 0 and abs(dist / dt) <= 3000 / 3.6::double)"
_SUM = "ts_ as (select source_id, run_id, track_id, count(*) n_points, min(t) t_start, max(t) t_end, coalesce(sum(st), 0) length_m from nv group by all)"
_GOOD = BLIPSAMP + ",\ngs as (select bs.*, score from bs join scored using (source_id, run_id, scan_id, pulse, col))"
_RUN = "source_id, run_id, scan_id"
ORACLES = {
    "b01_write_blips_csv": with_(STATS) + f"select source_id, run_id, (row_number() over (partition by source_id, run_id order by scan_id, patch_id))::varchar blip_no, {_TEXT} from pf where is_blip",
    "b03_write_blip_samples": with_(_GOOD) + f'select {_P}, pulse, col, "value", score from gs',
    "b04_read_blip_samples": with_(_GOOD) + f"select {_RUN}, s.pulse, sum(coalesce(g.\"value\", 0))::bigint total, sum(case when g.\"value\" is null then 0 else 2 end)::bigint marks from samp s left join gs g using ({_RUN}, pulse, col) group by all",
    "b05_write_blip_scores": with_(_GOOD) + f"select {_RUN}, any_value(ts) ts, count(*)::int n, list_reduce(list_prepend(0::bigint, list(score order by pulse, col)::bigint[]), lambda a, x: (a * 31 + x) % 1000003) mark from gs join scan using ({_RUN}) group by {_RUN}",
    "b06_write_scans": with_(PULSES) + "select source_id, run_id, count(distinct (scan_id, pulse)) n_pulses, count(distinct scan_id) n_scans from samp group by all",
    "b07_export_blips": with_(_GOOD) + f'select {_P}, count(*)::int n, round(sum(-48.34::double + 0.01738::double * "value" - 0.802::double * 61), 6) + 0 dbm, round(sum(5 * (col + 0.5::double) + 10), 6) + 0 r, round(sum(azi), 6) + 0 phi from gs join tab using ({_RUN}, pulse) group by all',
    "g01_candidate_pairs": with_(BLIPS + _PAIR) + "select source_id, run_id, u_scan, u_blip_id, v_scan, v_blip_id, round(dist, 6) + 0 dist, round(dt, 6) + 0 dt from cp",
    "g02_gain_pp": with_(BLIPS + _PAIR) + "select u_scan, u_blip_id, v_scan, v_blip_id, round(least(1::double, 0.5::double * (1 - dist / 8000) - case when step = 1 then 0 else 0.001::double end), 9) + 0 gain from cp",
    "g03_gain_tp": with_(_STEP + _PAIR, "m as (select cp.*, vx, vy, vz, sqrt((ux + dt * vx - wx) ** 2 + (uy + dt * vy - wy) ** 2 + (uz + dt * vz - wz) ** 2) o, dt * sqrt(vx * vx + vy * vy + vz * vz) p from cp join nv on nv.source_id = cp.source_id and nv.run_id = cp.run_id and nv.scan_id = u_scan and nv.blip_no = u_blip_id and vx is not null), g as (select *, least(1::double, 0.5::double * greatest(0::double, 1 - o / 8000) + 0.5::double * case when dist > 0 and p > 0 then 0.5::double + dt * (vx * (wx - ux) + vy * (wy - uy) + vz * (wz - uz)) / (2 * dist * p) else 0 end - case when step = 1 then 0 else 0.001::double end) g from m)") + "select u_scan, u_blip_id, v_scan, v_blip_id, round(case when g < 0.6::double then 0 else g end, 9) + 0 gain from g",
    "g04_new_state": with_(_STEP) + "select track_id, run_id, seq, round(vx, 6) + 0 vx, round(vy, 6) + 0 vy, round(vz, 6) + 0 vz from nv",
    "g05_max_pair_distance": with_(PULSES) + f"select {_RUN}, round(case when scan_id % 90 >= 60 then 330 else 660 * cos(radians((scan_id % 90)::double)) end, 6) + 0 max_dist from scan",
    "g08_nn_gates": with_(BLIPS, "n as (select v.scan_id v_scan, u.blip_no u_blip_id, v.blip_no v_blip_id, sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2) d, v.t - u.t dt, v.area va, u.area ua, v.int vi, u.int ui from blips u join blips v on u.source_id = v.source_id and u.run_id = v.run_id and v.scan_id = u.scan_id + 1), f as (select *, case when dt = 0 then d > 0 else abs(d / dt) > 3000 / 3.6::double end too_fast, case when ua = 0 then va <> 0 when dt = 0 then true else va / ua / dt > 2.5::double or va / ua * dt < 0.4::double end area_changed, case when ui = 0 then vi <> 0 when dt = 0 then true else vi / ui / dt > 2.5::double or vi / ui * dt < 0.4::double end int_changed from n)") + "select v_scan, u_blip_id, v_blip_id, too_fast, area_changed, int_changed, not (too_fast or area_changed or int_changed) passes from f",
    "g08_nn_gates_near": with_(BLIPS, "n as (select v.scan_id v_scan, u.blip_no u_blip_id, v.blip_no v_blip_id, sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2) d, v.t - u.t dt, v.area va, u.area ua, v.int vi, u.int ui from blips u join blips v on u.source_id = v.source_id and u.run_id = v.run_id and v.scan_id = u.scan_id + 1), f as (select *, case when dt = 0 then d > 0 else abs(d / dt) > 1500 / 3.6::double end too_fast, case when ua = 0 then va <> 0 when dt = 0 then true else va / ua / dt > 2.5::double or va / ua * dt < 0.4::double end area_changed, case when ui = 0 then vi <> 0 when dt = 0 then true else vi / ui / dt > 2.5::double or vi / ui * dt < 0.4::double end int_changed from n)") + "select v_scan, u_blip_id, v_blip_id, area_changed, int_changed, not (too_fast or area_changed or int_changed) passes from f where not too_fast",
    "g11_filter_short_tracks": with_(_CHAIN) + "select run_id, track_id, seq, blip_no blip_id from ch qualify count(*) over (partition by source_id, run_id, track_id) >= 5",
    "g12_track_summary": with_(_STEP, _SUM) + "select source_id, run_id, track_id, n_points, t_start, t_end, round(length_m, 6) + 0 length_m, round(case when t_end > t_start then length_m / (t_end - t_start) * 3.6::double end, 6) + 0 mean_speed_kmh from ts_",
    "g13_tracks_in_interval": with_(_STEP, _SUM) + "select run_id, track_id, t_start, t_end from ts_ where t_start <= 200 and t_end >= 100",
    "g14_scan_track_index": with_(_CHAIN, "c as (select source_id, run_id, scan_id, count(*) n_blips from blips group by all), a as (select source_id, run_id, scan_id, array_to_string(list_sort(list(distinct track_id)), ',') track_ids from ch group by all)") + "select c.*, (coalesce(sum(n_blips) over (partition by source_id, run_id order by scan_id rows between unbounded preceding and 1 preceding), 0) + 1)::bigint first_blip, track_ids from c left join a using (source_id, run_id, scan_id)",
    "g15_gain_log_units": with_(BLIPS, "u as (select scan_id, blip_no, case when int = 1 then 'Infinity'::double when int = 0 then '-Infinity'::double when int > 0 and int < 1 then 10 * log10(int / (1 - int)) end u from blips)") + "select scan_id, blip_no, round(u, 6) + 0 units, round(1 / (1 + pow(10::double, -u / 10)), 6) + 0 gain from u",
    "g17_truncate_track": with_(_CHAIN, "k as (select source_id, run_id, track_id, min(seq) k from ch where scan_id % 7 = 4 and blip_no % 3 = 0 group by all)") + "select run_id, track_id, seq, blip_no blip_id from ch left join k using (source_id, run_id, track_id) where k is null or seq < k",
    "h01_trails_last_n": with_(_GOOD, 'h as (select scan.source_id, scan.run_id, scan.scan_id, gs.pulse, gs.col, arg_max(gs."value", gs.scan_id) v, (scan.scan_id - max(gs.scan_id) + 1)::int age from scan join gs on gs.source_id = scan.source_id and gs.run_id = scan.run_id and gs.scan_id between scan.scan_id - 3 and scan.scan_id group by scan.source_id, scan.run_id, scan.scan_id, gs.pulse, gs.col)') + 'select source_id, run_id, scan_id, pulse, col, v "value", age, round(v * pow(0.85::double, age), 6) + 0 faded from h',
    "h02_trails_storage": with_(_GOOD) + 'select source_id, run_id, pulse, col, arg_max("value", scan_id) "value", arg_max(score, scan_id) score from gs group by all',
    "h03_blip_cross_section": with_(_GOOD, f'gg as (select gs.*, azi, elev from gs join tab using ({_RUN}, pulse)), b as (select {_P}, pulse bp, col bc, azi ba, elev be from gg qualify row_number() over (partition by {_P} order by "value" desc, pulse, col) = 1)') + f'select {_P}, pulse, col, "value", round(acos(greatest(-1::double, least(1::double, sin(radians(elev)) * sin(radians(be)) + cos(radians(elev)) * cos(radians(be)) * cos(radians(azi) - radians(ba))))) * case when pulse < bp then -1 else 1 end, 5) + 0 angle from gg join b using ({_P}) where col = bc',
    "h04_blips_in_time": with_(BLIPS) + "select scan_id, blip_no blip_id, t from blips where t between 100 and 200",
    "h05_blip_file_summary": with_(BLIPS) + "select count(*) n_blips, min(t) first_t, max(t) last_t from blips",
}
