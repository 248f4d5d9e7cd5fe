"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new place in spark.checkpoint.dir; where that is unset, in a folder of our own in local mode, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"
