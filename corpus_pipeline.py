"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stancewise.llm import dedup, langid, mixing, nearcopies, packing
from stancewise.llm.common import fresh, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null text, or no letter in it) go; repeated rows repeat. Columns of docs that are called
    like those of the verdict keep their values."""
    aside = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in langid.VERDICT}
    found = langid.identify(docs.withColumnsRenamed(aside)).filter("lang_pred <> 'und'").drop(*langid.VERDICT)
    return found.withColumnsRenamed({name: c for c, name in aside.items()}).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; null ids lose to any other, of rows that repeat all one stays."""
    return dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, also where ids are null or repeat; texts without words stay."""
    return nearcopies.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: not at all, once or twice. Null sources are one source, last in order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: where it lies in which sequence. A null text is a piece of the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
