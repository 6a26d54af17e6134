"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir. Where that is unset, one in a folder of our own on a single machine;
    a cluster has to name a folder."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", told)
    return f"{told.rstrip('/')}/sightline-{uuid.uuid4().hex}/{name}"
