"""Readers and writers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import SPANISH, Lexicon, Regimes
from ..functions.text import normalise, spanish_date, word_count
from .markup import BODY, Choice, read_pages

SPEECHES = "speech_id long, date date, url string, president string, president_id int, year int, month int, year_month string, n_words long, text_raw string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def speeches_csv(spark: SparkSession, path: str) -> DataFrame:
    """Speech CSV with embedded line feeds. Land it as Parquet: multi-line CSV does not split."""
    return spark.read.schema(SPEECHES).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """One term per line, # comments; distinct normalised terms, longest first."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    return lines.select(normalise(F.col("line")).alias("term")).distinct().orderBy(F.length("term").desc(), "term")


def lexicon(spark: SparkSession, positive: str, negative: str, base: Lexicon = SPANISH) -> Lexicon:
    """base with the terms of two dictionary files, longest first. Dictionaries are written by hand; both reach the driver."""
    terms = lambda path: tuple(r["term"] for r in dictionary(spark, path).collect())
    return replace(base, positive=terms(positive), negative=terms(negative))


def word_list(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The normalised words of a stopword file, one per line, # comments."""
    return tuple(sorted(r["term"] for r in dictionary(spark, path).collect()))


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """item_no, score, notes of a filled label sheet; scores are text until they are cleaned."""
    return spark.read.schema("item_no int, text string, score string, notes string").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).select("item_no", "score", "notes")


def month_series(spark: SparkSession, path: str, pattern: str = "dd/MM/yyyy") -> DataFrame:
    """month,value files whose month is a date in the given pattern or yyyy-MM."""
    raw = spark.read.option("header", True).csv(path).toDF("month", "value")
    day = F.coalesce(F.to_date(F.try_to_timestamp("month", F.lit(pattern))), F.to_date(F.try_to_timestamp(F.concat("month", F.lit("-01")), F.lit("yyyy-MM-dd"))))
    return raw.select(F.date_format(day, "yyyy-MM").alias("year_month"), F.col("value").try_cast("double").alias("value"))


def with_regime(df: DataFrame, regimes: Regimes, date: str = "date") -> DataFrame:
    """president, president_id of each date: the first closed interval that holds it, else Unknown / 0."""
    name, number = F.lit("Unknown"), F.lit(0)
    for start, end, who, k in reversed(regimes.intervals):
        inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        name, number = F.when(inside, who).otherwise(name), F.when(inside, k).otherwise(number)
    return df.withColumns({"president": name, "president_id": number})


def speeches(docs: DataFrame, regimes: Regimes) -> DataFrame:
    """documents as speeches, with the dates that FIXTURES.md gives them."""
    day = F.expr("date_add(DATE '2015-12-10', CAST((doc_id * 41) % 3700 AS INT))")
    return with_regime(docs.select(F.col("doc_id").alias("speech_id"), day.alias("date"), F.col("text").alias("text_raw"), "source", "lang"), regimes).withColumn("year_month", F.date_format("date", "yyyy-MM"))


def page_speeches(pages: DataFrame, choices: tuple[Choice, ...] = BODY, least_words: int = 50) -> DataFrame:
    """page_id, url, text, n_words, date of stored pages: the text of the chosen element; at least ``least_words`` words.

    The date is the Spanish one of the page's <time> element or, where it has none, of the first 500 characters of its text.
    """
    read = read_pages(pages, choices).filter("body IS NOT NULL")
    date = spanish_date(F.coalesce("time", "head"))
    rows = read.select("page_id", "url", F.trim(F.regexp_replace("body", r"(?U)\s+", " ")).alias("text"), date.alias("date"))
    return rows.withColumn("n_words", word_count(F.col("text")).cast("long")).filter(F.col("n_words") >= least_words)


def since(df: DataFrame, first: str, date: str = "date") -> DataFrame:
    """The rows dated on or after a day; undated ones stay."""
    return df.filter(F.col(date).isNull() | (F.col(date) >= F.lit(first).cast("date")))


def is_short(column: str, most: int = 2500) -> Column:
    """Whether the text has at most ``most`` characters."""
    return F.char_length(column) <= most


def short_enough(df: DataFrame, column: str, most: int = 2500) -> DataFrame:
    """The rows whose text has at most ``most`` characters."""
    return df.filter(is_short(column, most))


def page_links(pages: DataFrame, holding: str, without: str | None, root: str | None = None) -> DataFrame:
    """url: distinct links of index pages that hold one string and not another, absolute (against ``root``, or the page's own url)."""
    links = read_pages(pages, (), root).select(F.explode("links").alias("url")).filter(F.col("url").contains(holding))
    return (links.filter(~F.col("url").contains(without)) if without else links).distinct()


def write_stage(df: DataFrame, path: str, by: str | None = "president") -> None:
    """Writes a stage table, a folder per value of ``by`` if it has that column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in df.columns else writer).parquet(path)
