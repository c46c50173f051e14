"""Dense ids from the order of keys, without moving what the rows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.landing import landed


def fresh_column(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def key_offsets(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """keys, n (rows with these keys, or the sum of their weights), before (n of all smaller keys). Nulls come first.

    Only keys are written, in ranges as many as the data has partitions: a range begins where the counts of those before end, and
    within it counts are added up. So no task sees more than a range, and one sees a row per range.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    ranged = df.select(*keys, *[weight] * bool(weight)).repartitionByRange(*keys).groupBy(*keys).agg(n.alias("n"))  # the ranges serve the grouping too
    ranged = landed(ranged.withColumn("__part", F.spark_partition_id()))
    bases = ranged.groupBy("__part").agg(F.sum("n").alias("__n"))
    bases = bases.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = ranged.withColumn("__inner", inner).join(F.broadcast(bases), "__part")
    return found.select(*keys, "n", (F.col("__base") + F.col("__inner")).alias("before"))


def dense(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """df with ``name``: the row's place, from 0, in the order of keys; rows of the same keys get neighbouring places in any order.

    The places are found on keys alone and joined to the rows, so other columns move once at most, and only those that are used later.
    df is read three times (to sample its keys, to count them, to join): land it first where it is dear to compute.
    """
    held = landed(key_offsets(df, *keys))
    found = df.join(held.select(*keys, F.col("before").alias(name)), list(keys))
    if held.filter("n > 1").limit(1).count():
        found = found.withColumn(name, F.col(name) + F.row_number().over(W.partitionBy(*keys).orderBy(name)) - 1)
    return found
