"""Agreement of two labels, sampling for labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.landing import landed

CLASSES = (-1, 0, 1)


def clean_labels(df: DataFrame, column: str) -> DataFrame:
    """Numbers, truncated, in {-1, 0, 1}; the rest goes."""
    return df.withColumn(column, F.col(column).try_cast("double").cast("int")).filter(F.col(column).isin(*CLASSES))


def label_report(df: DataFrame, column: str) -> DataFrame:
    """outcome, n: how many labels are kept, blank, no number or out of range."""
    number = F.col(column).try_cast("double").cast("int")
    blank = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""
    outcome = F.when(blank, "blank").when(number.isNull(), "not a number").when(number.isin(*CLASSES), "kept").otherwise("out of range")
    return df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str = "human", model: str = "model") -> DataFrame:
    """truth, n_neg, n_neutral, n_pos and row percentages."""
    names = {-1: "neg", 0: "neutral", 1: "pos"}
    out = df.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(model) == c).alias(f"n_{names[c]}") for c in CLASSES])
    return out.withColumns({f"pct_{x}": F.round(100 * F.col(f"n_{x}") / F.col("n"), 4) for x in names.values()})


def class_metrics(df: DataFrame, by: list[str] | None = None, truth: str = "human", model: str = "model") -> DataFrame:
    """Precision, recall and F1 per class (null where undefined), from one pass over the counts."""
    by = by or []
    cells = df.groupBy(*by, truth, model).agg(F.count(F.lit(1)).alias("n"))
    each = cells.withColumn("cls", F.explode(F.array(*map(F.lit, CLASSES))))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t, m = F.col(truth) == F.col("cls"), F.col(model) == F.col("cls")
    out = each.groupBy(*by, "cls").agg(n(t & m).alias("tp"), n(~t & m).alias("fp"), n(t & ~m).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select(*by, "cls", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_f1(df: DataFrame, by: list[str] | None = None, truth: str = "human", model: str = "model") -> DataFrame:
    """The mean F1 of the classes that have one."""
    return class_metrics(df, by, truth, model).groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"))


def kappa(df: DataFrame, by: list[str] | None = None, truth: str = "human", model: str = "model") -> DataFrame:
    """n, accuracy and Cohen's kappa (0 where chance agreement is total)."""
    shares = [f(F.when(F.col(c) == k, 1.0).otherwise(0.0)).alias(f"{c}_{i}") for c in (truth, model) for i, k in enumerate(CLASSES) for f in (F.avg,)]
    out = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(model)).cast("double")).alias("accuracy"), *shares)
    pe = sum((F.col(f"{truth}_{i}") * F.col(f"{model}_{i}") for i in range(len(CLASSES))), F.lit(0.0))
    return out.select(*(by or []), "n", "accuracy", F.when(1 - pe > 0, (F.col("accuracy") - pe) / (1 - pe)).otherwise(0.0).alias("kappa"))


def severity(df: DataFrame, truth: str = "human", model: str = "model") -> DataFrame:
    gap = F.abs(F.col(truth) - F.col(model))
    return df.groupBy(truth).agg(*[F.count_if(gap == k).alias(x) for k, x in enumerate(("correct", "adjacent", "extreme"))])


def threshold_sweep(df: DataFrame, score: str, flag: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: n, agree, only by score, only by flag, precision, recall, F1. One pass, one row per threshold and task."""
    each = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.col(score) >= F.col("threshold")
    out = each.groupBy("threshold").agg(F.count_if(hit).alias("n"), F.count_if(hit & F.col(flag)).alias("agree"), F.count_if(hit & ~F.col(flag)).alias("only_score"), F.count_if(~hit & F.col(flag)).alias("only_flag"))
    p, r = F.try_divide("agree", F.col("n")), F.try_divide("agree", F.col("agree") + F.col("only_flag"))
    return out.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)})


def quotas(sizes: dict, want: int) -> dict:
    """group -> rows: its share of ``want`` (at least 1, banker's rounding), drift put on the largest or smallest quota, first by name."""
    total = sum(sizes.values())
    quota = {g: max(1, round(want * n / total)) for g, n in sorted(sizes.items(), key=lambda x: str(x[0]))}
    while (drift := want - sum(quota.values())) and quota:
        g = (max if drift < 0 else min)(quota, key=quota.get)
        quota[g] += 1 if drift > 0 else -1
        if quota[g] < 0:
            break
    return quota


def stratified_sample(df: DataFrame, cls: str, group: str, disagrees: str, key: str, per_class: int = 24, first: int = 6, seed: str = "42") -> DataFrame:
    """per_class rows of each class: up to ``first`` that disagree, the rest allotted to groups by share (``quotas``). Rows are picked in
    the order of md5(seed, key).

    df is written once (give it the columns that the sample needs). Of each class the first that disagree and of each class and group
    the first per_class + first rows are all that can be picked; tasks cut their rows to these before the shuffle, so a stratum of any
    size is a few rows a task. Counts per class and group, and then those candidates, are all that is looked at further.
    """
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    pool = landed(df)
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(order, key))
    odd = pool.filter(disagrees).withColumn("__k", rank(cls)).filter(F.col("__k") <= first).withColumn("__odd", F.lit(True))
    near = pool.withColumn("__k", rank(cls, group)).filter(F.col("__k") <= per_class + first).withColumn("__odd", F.lit(False))
    near = landed(odd.unionByName(near))
    odd = near.filter("__odd")
    taken = {(r[cls], r[group]): r["count"] for r in odd.groupBy(cls, group).count().collect()}
    sizes: dict[object, dict[object, int]] = {}
    for r in pool.groupBy(cls, group).count().collect():
        if rest := r["count"] - taken.get((r[cls], r[group]), 0):
            sizes.setdefault(r[cls], {})[r[group]] = rest
    want = {c: per_class - sum(n for (k, _), n in taken.items() if k == c) for c in sizes}
    table = [(c, g, q) for c, groups in sizes.items() for g, q in quotas(groups, want[c]).items()]
    names = T.StructType([*df.select(cls, group).schema.fields, T.StructField("__quota", T.IntegerType())])
    rest = near.filter("NOT __odd").join(F.broadcast(odd.select(key)), key, "left_anti").withColumn("__k", rank(cls, group))
    rest = rest.join(F.broadcast(df.sparkSession.createDataFrame(table, names)), [cls, group]).filter(F.col("__k") <= F.least("__quota", F.lit(per_class)))
    return odd.select(*df.columns).unionByName(rest.select(*df.columns))


def band_rates(df: DataFrame, score: str, flag: str, edges: list[float]) -> DataFrame:
    """lo, hi, n, n_hit, rate of rows whose score lies in [lo, hi), for neighbouring edges. Scores outside every band go."""
    band = F.coalesce(*[F.when((F.col(score) >= lo) & (F.col(score) < hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for lo, hi in zip(edges, edges[1:], strict=False)])
    out = df.select(band.alias("b"), F.col(flag).alias("f")).filter("b IS NOT NULL").groupBy(F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("n_hit"), F.avg(F.col("f").cast("double")).alias("rate"))


def histogram(df: DataFrame, by: str, column: str, bins: int = 40) -> DataFrame:
    """by, bin (from 0), lo, hi, n: equal widths between a group's least and largest value; the last bin holds the largest.

    The bounds are one row per group; values are counted before they meet them, so a group of many rows is many partial counts.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(by, F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.groupBy(F.col(by).alias("__by")).agg(F.min("x").alias("a"), F.max("x").alias("z"))
    joined = counts.join(bounds, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    place = F.when(F.col("z") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) * bins / (F.col("z") - F.col("a"))), F.lit(bins - 1))).otherwise(0).cast("int")
    width = (F.col("z") - F.col("a")) / bins
    out = joined.groupBy(by, place.alias("bin"), "a", width.alias("width")).agg(F.sum("n").alias("n"))
    return out.select(by, "bin", (F.col("a") + F.col("width") * F.col("bin")).alias("lo"), (F.col("a") + F.col("width") * (F.col("bin") + 1)).alias("hi"), "n")


def label_sheet(sample: DataFrame, key: str, text: str, seed: str = "42") -> DataFrame:
    """item_no (from 1, in the order of md5(seed, key)), text, blank score and notes of a sample: nothing tells the model's label."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return sample.select(F.row_number().over(W.orderBy(order, key)).alias("item_no"), F.col(text).alias("text"), F.lit(None).cast("int").alias("score"), F.lit("").alias("notes"))
