"""Radar scan analytics on Spark DataFrames: detection, patches, tracks, geometry and catalogues."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Sends this package's modules to the executors, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_skysweep_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="spark-"), "skysweep_modules.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("skysweep", os.path.relpath(path, here)))
    sc.addPyFile(to)
    sc._skysweep_shipped = True
