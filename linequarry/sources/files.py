"""Where the engine may write what its own plans read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a local one, removed at exit, only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_linequarry_scratch", None)
        if base is None:
            base = spark.sparkContext._linequarry_scratch = tempfile.mkdtemp(prefix="linequarry-")
            atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")
