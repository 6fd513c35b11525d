"""Clutter maps that last: counts on disk that batch after batch adds to.

A map is a folder of Parquet tables, one a batch, in the order of the batches' numbers: hits by (source_id, angle_class, pulses, samples_per_pulse, pulse, col), and for each (source_id, angle_class) a row without
pulse and col that counts the scans. A batch that comes again replaces what it gave before, so it counts once. Scans of other dimensions begin a map anew: what came before
them, in the batch or in earlier ones, no longer counts. The sum over the batches is the map that filter_clutter reads; compact() makes one batch of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCAN = ["source_id", "run_id", "scan_id"]
OWN = ["source_id", "angle_class"]
SHAPE = ["pulses", "samples_per_pulse"]
SCHEMA = "source_id string, angle_class int, pulses int, samples_per_pulse int, pulse int, col int, hits long, n_scans long, anew boolean, batch long"


def update_clutter(path: str, batch: int, blip_samples: DataFrame, scans: DataFrame) -> None:
    """Adds a batch of scans (with angle_class, ts, pulses, samples_per_pulse) and their blips' samples. batch: its number, as a stream's micro-batches have; a number that comes again replaces its batch."""
    in_order = Window.partitionBy(*OWN).orderBy("ts", "run_id", "scan_id")
    changed = F.struct(*SHAPE) != F.lag(F.struct(*SHAPE)).over(in_order)
    rows = scans.select(*SCAN, "angle_class", "ts", *SHAPE).withColumn("nth", F.coalesce(F.sum(changed.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.withColumn("last", F.max("nth").over(Window.partitionBy(*OWN))).where("nth = last")
    seen = rows.groupBy(*OWN, *SHAPE).agg(F.count("*").alias("n_scans"), F.max(F.col("last") > 0).alias("anew"))
    hits = blip_samples.select(*SCAN, "pulse", "col").join(rows.select(*SCAN, "angle_class", *SHAPE), SCAN).groupBy(*OWN, *SHAPE, "pulse", "col").agg(F.count("*").alias("hits"))
    both = seen.unionByName(hits, allowMissingColumns=True).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in SCHEMA.replace("long", "bigint").split(", ") if not c.startswith(("batch", "pulse ", "col "))], "cast(pulse as int) as pulse", "cast(col as int) as col")
    both.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def _counted(spark: SparkSession, path: str) -> DataFrame:
    """The batches' rows that still count."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    heads = rows.where("pulse is null")
    in_order = Window.partitionBy(*OWN).orderBy("batch")
    shape = F.struct(*SHAPE)
    start = heads.withColumn("new", F.col("anew") | F.coalesce(shape != F.lag(shape).over(in_order), F.lit(False))).where("new").groupBy(*OWN).agg(F.max("batch").alias("start"))  # a row a batch and map
    return rows.join(start, OWN, "left").where("start is null or batch >= start").drop("start")


def clutter_map(spark: SparkSession, path: str) -> DataFrame:
    """The map as learn_clutter gives it: source_id, angle_class, pulses, samples_per_pulse, pulse, col, hits, n_scans."""
    rows = _counted(spark, path)
    seen = rows.where("pulse is null").groupBy(*OWN, *SHAPE).agg(F.sum("n_scans").alias("n_scans"))
    return rows.where("pulse is not null").groupBy(*OWN, *SHAPE, "pulse", "col").agg(F.sum("hits").alias("hits")).join(seen, [*OWN, *SHAPE])


def compact(spark: SparkSession, path: str, to: str, batch: int) -> None:
    """Writes the map as one batch, with the number of the last one that it holds, to a new folder; further batches can be added to that."""
    rows = _counted(spark, path).where(F.col("batch") <= batch)
    rows.groupBy(*OWN, *SHAPE, "pulse", "col").agg(F.sum("hits").alias("hits"), F.sum("n_scans").alias("n_scans"), F.when(F.col("pulse").isNull(), F.lit(False)).alias("anew")).write.mode("overwrite").parquet(f"{to.rstrip('/')}/batch={batch}")
