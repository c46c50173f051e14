"""The job over written stages, and samples from one evaluation of their pool."""

from pyspark.sql import functions as F

from stancewise.functions.config import FIXTURE, Regimes
from stancewise.jobs import registry, stages
from stancewise.operators import agreement, index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_are_read_without_matching_or_shuffling_again(spark, small, tmp_path):
    job = stages.Stages(spark, str(tmp_path / "stages"))
    job.build(registry._speeches(spark, small), FIXTURE, Regimes())
    for df in (job.speech_counts(), job.votes().groupBy("speech_id").agg(F.count(F.lit(1)))):
        assert "Exchange" not in plan(df) and "ArrowEvalPython" not in plan(df)
    assert "Exchange" not in plan(job.texts_with_votes()) and "SortMergeJoin" in plan(job.texts_with_votes())
    want = registry.QUERIES["w1_speech_counts"](spark, small)
    assert sorted(map(tuple, job.speech_counts().select(*want.columns).withColumn("net_share", F.round("net_share", 6)).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert job.matches().count() == registry._hits(spark, small).count()
    assert (tmp_path / "stages" / "months" / "president=Macri").is_dir()
    again = stages.Stages(spark, str(tmp_path / "stages"))
    assert again.months().count() == index.month_signal(again.speech_counts(), Regimes()).count()
    job.build(registry._speeches(spark, small).filter("speech_id % 2 = 0"), FIXTURE, Regimes())
    assert 0 < job.speech_counts().count() < want.count()


def test_the_sample_evaluates_its_pool_once(spark, small):
    for name in ("stratified_sample",):
        text = plan(registry.QUERIES[name](spark, small))
        assert "ArrowEvalPython" not in text and "translate(" not in text


def test_sample_of_a_hot_stratum(spark):
    rows = [(i, 0 if i % 50 else i % 3 - 1, "abc"[i % 7 % 3], i % 11 == 0) for i in range(4000)]
    got = agreement.stratified_sample(spark.createDataFrame(rows, "id long, human int, g string, odd boolean").repartition(4), "human", "g", "odd", "id").collect()
    assert len({r["id"] for r in got}) == len(got)
    for c in (-1, 0, 1):
        assert sum(r["human"] == c for r in got) == 24 and sum(r["human"] == c and r["odd"] for r in got) >= min(6, sum(h == c and o for _, h, _, o in rows))


def test_quotas():
    assert agreement.quotas({"a": 10, "b": 10, "c": 10}, 18) == {"a": 6, "b": 6, "c": 6}
    assert agreement.quotas({"a": 1000, "b": 1, "c": 1}, 18) == {"a": 16, "b": 1, "c": 1}
    assert sum(agreement.quotas({"a": 5, "b": 3, "c": 9}, 20).values()) == 20
