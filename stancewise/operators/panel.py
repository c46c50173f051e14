"""Month series: transition rule, merge, calendar, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import Regimes
from .quantiles import rank_correlation


def resolved(months: DataFrame, signal: str, rename: str, regimes: Regimes) -> DataFrame:
    """One row per month: in a transition month that of the incoming group or none, else the first group by name."""
    incoming = F.create_map(*[F.lit(x) for kv in regimes.transitions.items() for x in kv])
    rows = months.filter(F.col("president").isin(*regimes.kept)).withColumn("__in", F.try_element_at(incoming, "year_month")).filter("__in IS NULL OR president = __in")
    first = F.row_number().over(W.partitionBy("year_month").orderBy("president"))
    return rows.withColumn("__k", first).filter("__k = 1").select("year_month", "president", F.col(signal).alias(rename), "n_fiscal_paras")


def merged(main: DataFrame, robust: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Full outer merge on month and group; n_fiscal_paras is the main series'."""
    keys = ["year_month", "president"]
    return main.join(robust.drop("n_fiscal_paras"), keys, "full").join(dictionary.drop("n_fiscal_paras"), keys, "full")


def calendar_panel(panel: DataFrame, regimes: Regimes, thin: int = 2) -> DataFrame:
    """Every month from the first to the last with its group by rule; months without the main signal get 0 for all three."""
    span = panel.agg(F.min("year_month").alias("lo"), F.max("year_month").alias("hi"))
    months = span.select(F.explode(F.expr("sequence(to_date(lo || '-01'), to_date(hi || '-01'), interval 1 month)")).alias("date")).withColumn("year_month", F.date_format("date", "yyyy-MM"))
    group = F.lit(regimes.kept[0])
    for month, who in sorted(regimes.transitions.items()):
        group = F.when(F.col("year_month") >= month, who).otherwise(group)
    spine = months.withColumn("president", group)
    out = spine.join(panel, ["year_month", "president"], "left").withColumn("is_zero_fill", F.col("signal_main").isNull())
    out = out.withColumns({c: F.when(F.col("is_zero_fill"), 0.0).otherwise(F.col(c)) for c in ("signal_main", "signal_robust", "signal_dictionary")})
    n = F.coalesce("n_fiscal_paras", F.lit(0))
    return out.withColumn("n_fiscal_paras", n.cast("long")).withColumn("is_thin", (F.col("n_fiscal_paras") > 0) & (F.col("n_fiscal_paras") <= thin))


def cross_validated(one: DataFrame, two: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson, spearman of a series of one table and a series of another over the months and groups that both have."""
    keys = ["year_month", "president"]
    return correlations(one.select(*keys, F.col(a).alias("a")).join(two.select(*keys, F.col(b).alias("b")), keys), "a", "b")


def with_other(months: DataFrame, other: DataFrame, suffix: str = "_dict") -> DataFrame:
    """months with the columns of another month table by month and group (null where it has none); clashing names get the suffix."""
    keys = ["year_month", "president"]
    named = other.select(*keys, *[F.col(c).alias(c + suffix if c in months.columns else c) for c in other.columns if c not in keys])
    return months.join(named, keys, "left")


def narrow(months: DataFrame, *columns: str) -> DataFrame:
    """month, group and some columns, in the order of month and group: one small file when written."""
    return months.select("year_month", "president", *columns).orderBy("year_month", "president")


def group_gap(df: DataFrame, column: str, one: str, two: str, group: str = "president") -> DataFrame:
    """The means of two groups and their difference, in one row."""
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(column)))
    return df.agg(mean(one).alias("first"), mean(two).alias("second"), (mean(one) - mean(two)).alias("gap"))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson, spearman of the rows where both are present, for series of any length."""
    return rank_correlation(df, a, b)


def rolling_correlation(df: DataFrame, a: str, b: str, rows: int = 6) -> DataFrame:
    """Pearson over the last ``rows`` rows by month (ties by group): full windows in which both vary. Month-level input."""
    w = W.orderBy("year_month", "president").rowsBetween(-(rows - 1), 0)
    out = df.select("year_month", "president", F.count(F.lit(1)).over(w).alias("n"), F.corr(a, b).over(w).alias("r"), F.stddev_samp(a).over(w).alias("sa"), F.stddev_samp(b).over(w).alias("sb"))
    return out.filter(f"n = {rows} AND sa > 0 AND sb > 0").select("year_month", "president", "r")


def rolling_mean(df: DataFrame, column: str, rows: int = 3, least: int = 2) -> DataFrame:
    w = W.partitionBy("president").orderBy("year_month").rowsBetween(-(rows - 1), 0)
    return df.select("year_month", "president", F.when(F.count(column).over(w) >= least, F.avg(column).over(w)).alias("rolling"))


def local_projection(df: DataFrame, series: str, month: str, value: str, horizon: int = 12) -> DataFrame:
    """value[t + h] - value[t - 1] for h = 0..horizon and the lagged change, per series."""
    w = W.partitionBy(series).orderBy(month)
    ahead = df.select(series, month, F.lag(value).over(w).alias("base"), (F.lag(value).over(w) - F.lag(value, 2).over(w)).alias("lag_change"), F.array(*[F.lead(value, h).over(w) for h in range(horizon + 1)]).alias("ahead"))
    return ahead.select(series, month, "lag_change", "base", F.posexplode("ahead").alias("h", "later")).select(series, month, "h", (F.col("later") - F.col("base")).alias("response"), "lag_change")
