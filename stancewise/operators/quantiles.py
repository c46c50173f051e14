"""Exact order statistics of groups of any size, from counts of values in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.landing import landed
from .ids import key_offsets


def value_places(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, value, n, before (values of the group that are smaller), of_group (values of the group): a row per group and value.

    Values are counted, and the counts written, before they are sorted in ranges of (by, value), so neither a large group nor a common
    value meets in a task. Null and NaN values do not count.
    """
    rows = df.select(*by, F.col(column).cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    marks = [f"__null_{c}" for c in by]  # null groups come first, as keys that are not null
    keyed = rows.select(*[F.col(c).isNull().alias(m) for c, m in zip(by, marks, strict=True)], *by, "value")
    cells = landed(keyed.groupBy(*marks, *by, "value").agg(F.count(F.lit(1)).alias("n")))
    placed = key_offsets(cells, *marks, *by, "value", weight="n").drop(*marks)
    first = placed.groupBy(*by).agg(F.min("before").alias("__first"), F.sum("n").alias("of_group"))
    same = F.lit(True)
    for c in by:
        first = first.withColumnRenamed(c, f"__of_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.join(first, same).select(*by, "value", "n", (F.col("before") - F.col("__first")).alias("before"), "of_group")


def exact_quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """by and, per name of shares, the quantile of column by linear interpolation between the two values beside it.

    The two values are those whose places hold the two ranks; a group's other values are not gathered. Groups without values are
    missing; without ``by`` there is one row (nulls for no values).
    """
    picked = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("of_group") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
            picked.append(F.max(F.when(here, F.col("value"))).alias(f"__{side}_{name}"))
    found = value_places(df, by, column).groupBy(*by).agg(F.max("of_group").alias("__n"), *picked)
    out = []
    for name, share in shares.items():
        rank, lo, hi = F.lit(share) * (F.col("__n") - 1), F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return found.select(*by, *out)


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson, spearman of the rows where both are present; ranks are averages over ties.

    Rows are counted by their two values first. A value's average rank follows from the counts of smaller values, found in ranges; the
    mean rank is known beforehand, so one pass over the counted pairs gives the sums.
    """
    pairs = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)")
    cells = landed(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    for c in ("a", "b"):
        places = key_offsets(cells, c, weight="n")
        cells = cells.join(places.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}")), c)
    total = cells.agg(F.sum("n").alias("__n"), F.try_divide(F.sum(F.col("n") * F.col("a")), F.sum("n")).alias("__a"), F.try_divide(F.sum(F.col("n") * F.col("b")), F.sum("n")).alias("__b"))
    mean = (F.col("__n") + 1) / 2
    away = {"a": F.col("a") - F.col("__a"), "b": F.col("b") - F.col("__b"), "ra": F.col("ra") - mean, "rb": F.col("rb") - mean}
    moment = lambda x, y: F.sum(F.col("n") * away[x] * away[y])
    r = lambda x, y: F.try_divide(moment(x, y), F.sqrt(moment(x, x) * moment(y, y)))
    return cells.join(F.broadcast(total)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), r("a", "b").alias("pearson"), r("ra", "rb").alias("spearman"))
