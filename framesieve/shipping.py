"""Sending this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = __name__.split(".")[0]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application.

    Workers import operator code by module name; on a cluster nothing
    guarantees that the driver's folder is on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_framesieve_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="framesieve-"), f"{_PACKAGE}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(root, _PACKAGE)):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(d, x)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._framesieve_shipped = True
