"""Makes this package importable in Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Adds the package's place to the workers' path, for workers that see the same files.

    On other machines the package is installed or shipped with ``--py-files``.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([here, *[p for p in known if p]])
