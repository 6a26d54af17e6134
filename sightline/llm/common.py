"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Between words of ASCII letters, digits and non-ASCII characters; a Java and Python pattern.
DELIMITER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, one of our own on a
    single machine; a cluster has to name one."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: it cuts the lineage, is computed once and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/sightline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def raw_words(text: Column) -> Column:
    """The words of a text as an array, letters as they stand; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{DELIMITER}+", -1), "")


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """128 bits as two longs: xxhash64 from two seeds."""
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)
