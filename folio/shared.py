"""The folder that all executors and the driver share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or in folio.scratch.dir; a temporary one where neither is set and Spark runs in one process.

    On a cluster a temporary folder would be another one on each machine, so there the
    setting must be made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("folio.scratch.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("folio.scratch.dir", found)
    return found.rstrip("/")
