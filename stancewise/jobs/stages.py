"""The dictionary index as a job: every stage is written once, in buckets of speeches, and read by what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Lexicon, Regimes
from ..operators import index, paragraphs
from ..sources import tables
from ..sources.store import bucketed, columns_of, write_bucketed


class Stages:
    """The stage tables under a path: paragraphs (with their matches), votes and months.

    paragraphs and votes lie in buckets of speech_id, so what joins them or groups them by speech moves nothing; months are small
    and lie in a folder per group. A session that did not write them can read them: schemas are those of the writer.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build(self, speeches: DataFrame, lexicon: Lexicon, regimes: Regimes, stopwords: tuple[str, ...] = ()) -> None:
        """Runs the job: texts are cut, normalised and searched once, and every later stage reads what the one before has written."""
        cut = paragraphs.with_matches(paragraphs.paragraphs(speeches, lexicon, stopwords=stopwords), lexicon).drop("text_norm")
        self._write(cut, "paragraphs")
        self._write(paragraphs.with_votes(self.paragraphs()).drop("matches", "text_para"), "votes")
        tables.write_stage(index.month_signal(self.speech_counts(), regimes), f"{self.path}/months")

    def _write(self, df: DataFrame, name: str) -> None:
        write_bucketed(df, f"{self.path}/{name}", "speech_id", self.buckets)

    def _read(self, name: str) -> DataFrame:
        written = self.spark.read.parquet(f"{self.path}/{name}")
        return self.spark.table(bucketed(self.spark, f"{self.path}/{name}", columns_of(written), "speech_id", self.buckets))

    def paragraphs(self) -> DataFrame:
        return self._read("paragraphs")

    def matches(self) -> DataFrame:
        """A row per match of the written paragraphs."""
        return paragraphs.one_per_match(self.paragraphs())

    def votes(self) -> DataFrame:
        return self._read("votes")

    def speech_counts(self) -> DataFrame:
        return index.speech_counts(self.votes())

    def months(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/months")

    def texts_with_votes(self) -> DataFrame:
        """speech_id, para_idx, text_para, pos_hits, neg_hits of paragraphs with hits: two stages joined bucket by bucket. Only the bucket's
        key is a join key; with para_idx as another both sides would be shuffled."""
        votes = self.votes().filter("pos_hits + neg_hits > 0").select("speech_id", F.col("para_idx").alias("__of"), "pos_hits", "neg_hits")
        texts = self.paragraphs().select("speech_id", "para_idx", "text_para")
        same = (texts["speech_id"] == votes["speech_id"]) & (texts["para_idx"] - votes["__of"] == 0)
        return texts.join(votes.hint("merge"), same).drop(votes["speech_id"], votes["__of"])
