"""Tables in buckets of a key under a path: what is joined or grouped by the key later is not shuffled again."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> str:
    """The name, in this session, of the table of these columns at path, in buckets of ``key``; made if it is not there yet."""
    name = "stage_" + hashlib.md5(f"{path} {buckets}".encode()).hexdigest()[:16]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def columns_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Writes df at path, replacing what is there, a file per bucket, and returns the table."""
    name = bucketed(df.sparkSession, path, columns_of(df), key, buckets)
    df.repartition(buckets, key).write.insertInto(name, overwrite=True)
    return df.sparkSession.table(name)
