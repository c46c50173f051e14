"""Intermediate tables written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_path(spark: SparkSession) -> str:
    """A path of its own under spark.checkpoint.dir (a temporary folder in local mode, where that is unset)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = _own.setdefault("path", tempfile.mkdtemp(prefix="stancewise-"))
    return f"{shared.rstrip('/')}/stancewise/{uuid.uuid4().hex}"


def landed(df: DataFrame) -> DataFrame:
    """Writes df as Parquet at a new path and reads it again.

    What follows starts from the written rows: nothing before is computed twice, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
