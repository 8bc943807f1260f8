"""Where jobs put tables that their other tasks read."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset the warehouse, or in local mode, where
    all run on one machine, a temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.nodewell.shared.dir", None)
    if known is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        known = tempfile.mkdtemp(prefix="nodewell-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.nodewell.shared.dir", known)
    return known.rstrip("/")
