"""Votes to speech counts to the monthly index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import Regimes
from ..sources.landing import landed
from .quantiles import exact_quantiles


def speech_counts(votes: DataFrame) -> DataFrame:
    """One row per speech: paragraph counts, votes of relevant and other paragraphs, hit totals, net share (null if P = 0)."""
    n = lambda c: F.count_if(c).cast("long")
    rel, pos, neg = F.col("is_fiscal"), F.col("has_pos") == 1, F.col("has_neg") == 1
    out = votes.groupBy("speech_id").agg(
        F.min("date").alias("date"), F.min("president").alias("president"), F.min("year_month").alias("year_month"),
        F.count(F.lit(1)).alias("n_paragraphs"), n(rel).alias("n_fiscal_paragraphs"), n(rel & pos).alias("pos_fiscal_paras"), n(rel & neg).alias("neg_fiscal_paras"),
        n(rel & ~(pos | neg)).alias("neutral_fiscal_paras"), n(~rel & pos).alias("pos_nonfiscal_paras"), n(~rel & neg).alias("neg_nonfiscal_paras"),
        *[F.sum(c).cast("long").alias(f"{c}_total") for c in ("pos_hits", "neg_hits", "pos_negated", "neg_negated")],
    )
    return out.withColumn("net_share", F.try_divide(F.col("pos_fiscal_paras") - F.col("neg_fiscal_paras"), F.col("n_fiscal_paragraphs")))


def clipped(c: Column, lo: Column, hi: Column) -> Column:
    """c within lo and hi; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def standardised(df: DataFrame, columns: dict[str, tuple[str, str, str]], quantile: float = 0.025, months: bool = True) -> DataFrame:
    """For each raw column adds its winsorised form, the z-score of that, and the raw z-score (names in columns[raw]).

    Quantiles (linear interpolation), means and sample deviations are over all rows without nulls. A z-score is 0 for every
    row if the deviation is 0 or undefined. The statistics are one-row frames; df is written first, since it is read again and again
    here and what computes it may be dear. With a row per month and group (``months``) one task takes the quantiles; rows of any number
    are counted by value in ranges.
    """
    df = out = landed(df)
    for c, (wins, _, _) in columns.items():
        if months:
            q = df.agg(*[F.expr(f"percentile({c}, {s})").alias(f"__{side}") for side, s in (("lo", quantile), ("hi", 1 - quantile))])
        else:
            q = exact_quantiles(df, [], c, {"lo": quantile, "hi": 1 - quantile}).select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        out = out.join(F.broadcast(q)).withColumn(wins, clipped(F.col(c), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    sources = {z: c for raw, (wins, z_wins, z_raw) in columns.items() for z, c in ((z_wins, wins), (z_raw, raw)) if z}
    stats = out.agg(*[f(c).alias(f"__{k}_{z}") for z, c in sources.items() for k, f in (("mu", F.avg), ("sd", F.stddev_samp))])
    out = out.join(F.broadcast(stats))
    for z, c in sources.items():
        mu, sd = F.col(f"__mu_{z}"), F.col(f"__sd_{z}")
        out = out.withColumn(z, F.when(sd > 0, (F.col(c) - mu) / sd).otherwise(F.lit(0.0))).drop(f"__mu_{z}", f"__sd_{z}")
    return out


def month_signal(counts: DataFrame, regimes: Regimes) -> DataFrame:
    """(H - D) / P and (H - D) / N per month and kept group, winsorised and standardised. Months without relevant
    paragraphs stay, with null."""
    s = lambda c: F.sum(c).cast("long")
    months = counts.filter(F.col("president").isin(*regimes.kept)).groupBy("year_month", "president").agg(F.count(F.lit(1)).alias("n_speeches"), s("n_fiscal_paragraphs").alias("n_fiscal_paras"), s("n_paragraphs").alias("n_total_paras"), s("pos_fiscal_paras").alias("H_t"), s("neg_fiscal_paras").alias("D_t"))
    net = F.col("H_t") - F.col("D_t")
    months = months.withColumns({"net": F.try_divide(net, F.col("n_fiscal_paras")), "net_rob": F.try_divide(net, F.col("n_total_paras"))})
    return standardised(months, {"net": ("net_wins", "net_z", "net_z_raw"), "net_rob": ("net_rob_wins", "net_rob_z", "")})


def scored_month_signal(paras: DataFrame, score: str = "score", regimes: Regimes | None = None) -> DataFrame:
    """The index from paragraph scores of -1, 0 and 1 (relevant paragraphs only, so a month needs one), distinct speeches
    counted; groups are filtered after standardising. Speeches are pre-aggregated, so no group's rows meet in one task."""
    by_speech = paras.groupBy("year_month", "president", "speech_id").agg(F.count(F.lit(1)).alias("p"), F.count_if(F.col(score) == 1).alias("h"), F.count_if(F.col(score) == -1).alias("d"))
    months = by_speech.groupBy("year_month", "president").agg(F.count(F.lit(1)).alias("n_speeches"), *[F.sum(c).cast("long").alias(n) for c, n in (("p", "n_fiscal_paras"), ("h", "H_t"), ("d", "D_t"))])
    months = months.withColumn("net", F.try_divide(F.col("H_t") - F.col("D_t"), F.col("n_fiscal_paras")))
    out = standardised(months, {"net": ("net_wins", "net_z", "net_z_raw")})
    return out.filter(F.col("president").isin(*regimes.kept)) if regimes else out
