"""Intermediate tables in the cluster's shared folder: they are computed once, cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables that scratch() deletes at its end: one list per block that is open.
_OPEN: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session (tests) gets a new one; a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if where is None:
        now = context.getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not (context.master() == "local" or context.master().startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which scratch() deletes."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append((spark, path))
    return path


def stored(df: DataFrame, partitions: int | None = None, **options: str) -> DataFrame:
    """df as a Parquet table of the shared folder, with the writer's options."""
    path = new_path(df.sparkSession, "table")
    (df.coalesce(partitions) if partitions else df).write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing lazy refers to any more."""
    for table in tables:
        delete(table.sparkSession, table._stored_at)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what was stored inside: for a job whose result is written before that."""
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path in _OPEN.pop():
            delete(spark, path)
