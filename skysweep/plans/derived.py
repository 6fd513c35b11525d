"""Radar tables derived from the driver's tables by plain arithmetic, in Spark and (as common table expressions) in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Radar geometry of the derived scans.
GEOMETRY = {
    "samples_per_pulse": "64", "bits_per_sample": "12", "sample_dist": "5D", "first_sample_dist": "10D", "bearing": "30D", "bearing_offset": "15D",
    "orientation": "1", "axis_azimuth": "0D", "axis_elevation": "90D", "tilt": "5D", "elevation": "12D",
}


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, run_id, scan_id, pulse, samples: one pulse per embedding, with two targets that move by a fixed step a scan; the second crosses
    the seam between the last and the first pulse."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    dp = "least(abs(pulse - pmod({0}, 64)), 64 - abs(pulse - pmod({0}, 64)))"
    lift = "case when {0} * {0} + abs(i - ({1})) * abs(i - ({1})) <= 9 then 1500 else 0 end"
    value = f"cast(floor((cast(e as double) + 1) * 1024) as int) + {lift.format('dp1', '15 + 2 * (scan_id % 16)')} + {lift.format('dp2', '40 - (scan_id % 16)')}"
    return (
        rows.selectExpr("vec_id div 64 as scan_id", "cast(vec_id % 64 as int) as pulse", "embedding")
        .withColumn("dp1", F.expr(dp.format("8 + 3 * scan_id")))
        .withColumn("dp2", F.expr(dp.format("60 + 2 * scan_id")))
        .selectExpr("concat('radar', scan_id div 64 % 3) as source_id", "scan_id div 16 as run_id", "scan_id", "pulse", f"transform(embedding, (e, i) -> least(4095, {value})) as samples")
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scan of the pulses, with metadata."""
    found = pulses(spark, sf_dir).groupBy("source_id", "run_id", "scan_id").agg(F.count("*").cast("int").alias("pulses"))
    return found.selectExpr("*", "cast(scan_id as double) * 2.5D as ts", "2500D as duration_ms", *[f"{v} as {k}" for k, v in GEOMETRY.items()])


PULSES = """e0 as (select vec_id // 64 scan_id, (vec_id % 64)::int pulse, (i - 1)::int col, embedding[i]::double e
  from (select vec_id, embedding, unnest(range(1, 65)) i from embeddings)),
e1 as (select *, least(abs(pulse - (8 + 3 * scan_id) % 64), 64 - abs(pulse - (8 + 3 * scan_id) % 64)) p1, abs(col - (15 + 2 * (scan_id % 16))) s1,
  least(abs(pulse - (60 + 2 * scan_id) % 64), 64 - abs(pulse - (60 + 2 * scan_id) % 64)) p2, abs(col - (40 - scan_id % 16)) s2 from e0),
samp as (select 'radar' || (scan_id // 64 % 3) source_id, scan_id // 16 run_id, scan_id, pulse, col,
  least(4095, floor((e + 1) * 1024)::int + case when p1 * p1 + s1 * s1 <= 9 then 1500 else 0 end + case when p2 * p2 + s2 * s2 <= 9 then 1500 else 0 end) "value" from e1),
scan as (select source_id, run_id, scan_id, count(distinct pulse)::int pulses, scan_id::double * 2.5::double ts from samp group by all)"""

_SWEEP = {
    "source_id": "concat('radar', cast(s // 100 % 3 as string))",
    "run_id": "s // 25",
    "scan_id": "s",
    "ts": "cast(s as double) * 2.5D + cast(u % 5 as double) * 0.125D",
    "duration_ms": "case when u % 11 = 0 then 0D when u % 13 = 0 then 4000D else 2400D + cast(n as double) * 5D end",
    "bearing": "case when u % 4 = 0 then null else cast(u % 360 as double) end",
    "elevation": "case when u % 3 = 0 then null else cast(u % 50 as double) end",
    "user_comment": "case when u % 9 = 0 then concat('gain ', cast(u as string)) end",
    "embedded_ts": "case when u % 6 = 0 then 0D else 1704067200D + cast(s as double) * 2.5D end",
    "time_of_day": "case when u % 12 = 0 then null else cast(s as double) * 2.5D end",
}


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan metadata of several sources and runs: 20 events make a scan."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id div 20").alias("s")).agg(F.count("*").alias("n"), F.min("user_id").alias("u"))
    return rows.selectExpr(*[f"{v.replace('//', 'div')} as {k}" for k, v in _SWEEP.items()])


def _duck(expression: str) -> str:
    import re

    return re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"\1::double", expression).replace("as string", "as varchar")


SWEEPS = "sw0 as (select event_id // 20 s, count(*) n, min(user_id) u from events group by 1),\nsweeps as (select " + ", ".join(f"{_duck(v)} {k}" for k, v in _SWEEP.items()) + " from sw0)"


def blips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blips of the sweeps, one per event: source_id, run_id, scan_id, blip_no, t, x, y, z, area, int."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr(
        "concat('radar', event_id div 20 div 100 % 3) as source_id", "event_id div 20 div 25 as run_id", "event_id div 20 as scan_id", "event_id % 20 as blip_no",
        "cast(event_id div 20 as double) * 2.5D + cast(event_id % 20 as double) * 0.125D as t", "cast((event_id * 7919) % 4001 - 2000 as double) as x",
        "cast((event_id * 6101) % 4001 - 2000 as double) as y", "cast(event_id % 7 as double) as z", "value * 10D as area", "cast(1 + user_id % 100 as double) / 100D as int",
    )


BLIPS = """blips as (select 'radar' || (event_id // 20 // 100 % 3) source_id, event_id // 20 // 25 run_id, event_id // 20 scan_id, event_id % 20 blip_no,
  (event_id // 20)::double * 2.5::double + (event_id % 20)::double * 0.125::double t, ((event_id * 7919) % 4001 - 2000)::double x,
  ((event_id * 6101) % 4001 - 2000)::double y, (event_id % 7)::double z, "value" * 10::double area, (1 + user_id % 100)::double / 100::double int from events)"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger sparse sample table, from lineitem: scan_id, pulse, col, value."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.selectExpr("l_orderkey div 64 as scan_id", "cast(l_partkey % 256 as int) as pulse", "cast(l_suppkey % 256 as int) as col", "cast(l_quantity as int) as q").groupBy("scan_id", "pulse", "col").agg(F.expr("cast(least(4095, sum(q) * 40) as int)").alias("value"))


PARCELS = """parcels as (select l_orderkey // 64 scan_id, (l_partkey % 256)::int pulse, (l_suppkey % 256)::int col, least(4095, sum(l_quantity::int) * 40)::int "value" from lineitem group by 1, 2, 3)"""


def with_(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"
