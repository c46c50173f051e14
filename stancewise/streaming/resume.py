"""Resumable scoring: each run takes the files it has not seen and asks for ids that have no score; what a task has asked stays."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..sources.landing import landed
from ..sources.store import bucketed

SCORES = "para_id long, score int, reason string, scored_at timestamp"


class ScoreStore:
    """Scores under a path: a log, to which tasks add as they end, and a base in buckets of para_id, made from both by ``compact``.

    Generation g is base g and the log kept since it was made. The newest generation of ``commits`` counts, so a compaction that
    breaks off leaves everything as it was. One writer at a time; files of earlier generations can be deleted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        return self._read("commits", "generation int").agg(F.max("generation")).first()[0] or 0

    def base(self) -> DataFrame:
        generation = self.generation()
        if not generation:
            return self.spark.createDataFrame([], SCORES)
        return self.spark.table(bucketed(self.spark, f"{self.path}/base-{generation}", SCORES, "para_id", self.buckets))

    def log(self) -> DataFrame:
        return self._read(f"log-{self.generation()}", SCORES)

    def add(self, scores: DataFrame) -> None:
        """Adds para_id, score, reason. A task's rows are in place when the task ends, whatever becomes of the job: they were paid for."""
        rows = scores.withColumn("scored_at", F.current_timestamp())
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/log-{self.generation()}")

    def without(self, paras: DataFrame) -> DataFrame:
        """The rows of paras whose ids have no score; only they are shuffled to the buckets of the base."""
        return scoring.to_score(scoring.to_score(paras, self.log()), self.base())

    def newest(self) -> DataFrame:
        """para_id, score, reason: the newest row of each id."""
        return self._newest().select("para_id", "score", "reason")

    def _newest(self) -> DataFrame:
        rows = self.log().unionByName(self.base())
        newest = F.max_by(F.struct("score", "reason", "scored_at"), F.struct("scored_at", "reason")).alias("r")
        return rows.groupBy("para_id").agg(newest).select("para_id", "r.*")

    def compact(self) -> None:
        """Makes the next generation: one row per id, a file per bucket, an empty log."""
        generation = self.generation() + 1
        rows = self._newest().repartition(self.buckets, "para_id")
        rows.write.insertInto(bucketed(self.spark, f"{self.path}/base-{generation}", SCORES, "para_id", self.buckets), overwrite=True)
        self.spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def score_missing(store: ScoreStore, paras: DataFrame, scorer: Callable[[str], str], tries: int = 3, wait: float = 1.0, per_task: int = 1, at_once: int | None = None) -> None:
    """Asks for the ids of paras (para_id, text_para) that the store lacks, in rounds; the last round's lacking ids are neutral.

    A task asks for about ``per_task`` batches and adds its answers to the store when it ends, so a broken run loses those at most. With
    ``at_once`` a job has so many tasks and no more, job after job.
    """
    for turn in range(tries):
        left = landed(store.without(paras.dropDuplicates(["para_id"])))
        if not left.limit(1).count():
            return
        batches = landed(scoring.batched(left))
        tasks = max(1, -(-batches.count() // per_task))
        jobs = max(1, -(-tasks // at_once)) if at_once else 1
        for job in range(jobs):
            part = batches.filter(F.pmod("batch_id", F.lit(jobs)) == job).repartition(-(-tasks // jobs))
            rows = scoring.with_answers(scoring.replied(part, scorer))
            last = F.when(F.lit(turn + 1 == tries), F.transform("items", lambda x: F.struct(x["para_id"].alias("para_id"), F.lit(0).alias("score"), F.col("failure").alias("reason"))))
            empty = F.expr("cast(array() as array<struct<para_id:bigint,score:int,reason:string>>)")
            store.add(rows.select(F.inline(F.concat("answers", F.coalesce(last, empty)))))
        if turn + 1 < tries:
            time.sleep(wait * 2**turn)


def score_new(
    spark: SparkSession, source: str, scores: str, checkpoint: str, scorer: Callable[[str], str], schema: str = "para_id long, text_para string", tries: int = 3, wait: float = 1.0, per_task: int = 1,
    at_once: int | None = None,
) -> None:
    """Reads new Parquet files under source and scores their ids into the store at scores. Safe to run again: a micro-batch that broke off
    is replayed, and asks only for what the store lacks."""
    store = ScoreStore(spark, scores)

    def one(batch: DataFrame, _: int) -> None:
        score_missing(store, batch, scorer, tries, wait, per_task, at_once)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
