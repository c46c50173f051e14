"""Batches, replies, rounds of asking and the store of scores: what is asked, how often, and what a broken run leaves."""

import collections
import datetime
import json
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from stancewise.jobs import registry, reports  # noqa: F401
from stancewise.operators import ids, scoring
from stancewise.sources import store
from stancewise.streaming import resume
from tests.test_oracle import compare

REPLIES = "batch_id long, items array<struct<para_id: bigint, text: string>>, reply string, failure string"


def asked(prompt):
    return [int(x) for x in re.findall(r"^\d+\. \[id=(\d+)\]", prompt, re.M)]


def answer(some):
    return json.dumps([{"id": i, "score": 1, "reason": "r"} for i in some])


def counted(folder):
    """How often each id was asked, from the files that ``note`` leaves."""
    return collections.Counter(int(i) for f in os.listdir(folder) for i in f.split("_")[0].split("-"))


def note(folder, some):
    open(f"{folder}/{'-'.join(map(str, some))}_{uuid.uuid4().hex}", "w").close()


def paras(spark, n, start=0):
    return spark.range(start, n).select(F.col("id").alias("para_id"), F.lit("some text").alias("text_para"))


def test_malformed_replies(spark):
    rows = [
        ([1, 2, 3], '```json\n[{"id":1,"score":0.7,"reason":"x"},5,{"id":"2","score":true},{"id":1,"score":-1,"reason":"last"},{"score":1},{"id":3}]\n```', None),
        ([4], '{"id":4,"score":9,"reason":"' + "r" * 200 + '"}', None), ([5], 'Sure: [{"id":5,"score":"1"}] done', None), ([6], "no idea", None), ([7], "  ", None), ([8], None, None), ([9], "[]", None), ([10], "17", None),
        ([11], None, "api_error"), ([12], None, "retry_exhausted"), ([], "[]", None), ([13], '[{"id":99,"score":1}]', None),
    ]
    table = spark.createDataFrame([(k, [(i, "t") for i in some], reply, failure) for k, (some, reply, failure) in enumerate(rows)], REPLIES)
    got = {r["para_id"]: (r["score"], r["reason"]) for r in scoring.parsed(table).collect()}
    assert got == {
        1: (-1, "last"), 2: (1, ""), 3: (0, "parse_fallback"), 4: (0, "r" * 120), 5: (1, ""), 6: (0, "parse_fallback"), 7: (0, "no_response"), 8: (0, "no_response"), 9: (0, "parse_fallback"), 10: (0, "parse_fallback"),
        11: (0, "api_error"), 12: (0, "retry_exhausted"), 13: (0, "parse_fallback"),
    }


def test_batches_are_consecutive_at_any_number_of_rows(spark):
    for n, numbered in ((12_345, True), (25_000, False)):
        table = paras(spark, n) if numbered else paras(spark, n).withColumn("para_id", F.col("para_id") * 37 + 5)
        got = scoring.batched(table, numbered=numbered).select("batch_id", F.transform("items", lambda x: x["para_id"]).alias("ids")).orderBy("batch_id").collect()
        every = [i if numbered else i * 37 + 5 for i in range(n)]
        assert [r["ids"] for r in got] == [every[lo : lo + 10] for lo in range(0, n, 10)]


def test_places_move_keys_only(spark):
    rows = [(i * 7919 % 1000, i % 3, "x" * 50) for i in range(3000)] + [(5, 1, "again")] * 4
    table = spark.createDataFrame(rows, "speech_id long, para_idx int, text string").repartition(5)
    got = ids.dense(table, ("speech_id", "para_idx"), "place").collect()
    assert sorted(r["place"] for r in got) == list(range(len(rows)))
    assert [(r["speech_id"], r["para_idx"]) for r in sorted(got, key=lambda r: r["place"])] == sorted((a, b) for a, b, _ in rows)
    assert "text" not in ids.key_offsets(table, "speech_id", "para_idx")._jdf.queryExecution().analyzed().toString()
    assert ids.dense(table.limit(0), ("speech_id",), "place").count() == 0


def test_rounds_ask_again_only_for_what_is_lacking(spark, tmp_path):
    """id 3 comes in the second try, 17 never, batch 20..29 breaks once, 30..39 always, 40..49 is told to wait for ever."""
    folder = str(tmp_path)

    def scorer(prompt):
        some = asked(prompt)
        before = counted(folder)
        note(folder, some)
        if 20 in some and not before[20] or 30 in some:
            raise RuntimeError("down")
        if 40 in some:
            raise scoring.Busy
        return "" if 50 in some else answer(i for i in some if i != 17 and (i != 3 or before[3]))

    got = {r["para_id"]: (r["score"], r["reason"]) for r in scoring.scored(scoring.batched(paras(spark, 60)), scorer, wait=0).collect()}
    fails = {17: "parse_fallback", **dict.fromkeys(range(30, 40), "api_error"), 40: "retry_exhausted", 50: "no_response"}
    times = counted(folder)
    assert len(got) == 60 and got[3] == (1, "r") and got[17] == (0, "parse_fallback")
    assert times[3] == 2 and times[17] == 3 and times[0] == times[16] == times[18] == 1 and times[20] == times[29] == 2 and times[30] == 3
    assert {i: got[i][1] for i in fails} == fails
    reasons = collections.Counter(r for _, r in got.values())
    assert set(reasons) == {"r", "parse_fallback", "api_error", "retry_exhausted", "no_response"}
    rates = spark.createDataFrame([(i, s, r) for i, (s, r) in got.items()], "para_id long, score int, reason string")
    assert {r["outcome"]: r["n"] for r in scoring.fallback_rates(rates).collect()} == {"scored" if k == "r" else k: n for k, n in reasons.items()}


def test_few_tasks_ask_at_a_time(spark, tmp_path):
    table = scoring.batched(paras(spark, 300).repartition(8))
    plan = scoring.scored(table, lambda p: answer(asked(p)), wait=0, at_once=2)
    assert plan.count() == 300 and scoring.replied(table.coalesce(2), len).rdd.getNumPartitions() <= 2


def test_a_broken_run_keeps_what_was_paid_for(spark, tmp_path):
    folder, scores = str(tmp_path / "calls"), str(tmp_path / "scores")
    os.mkdir(folder)
    kept = resume.ScoreStore(spark, scores)

    def breaking(prompt):
        some = asked(prompt)
        note(folder, some)
        if 150 in some:
            import time

            time.sleep(4)
            os._exit(1)
        return answer(some)

    def fine(prompt):
        note(folder, asked(prompt))
        return answer(asked(prompt))

    with pytest.raises(Exception, match="(?i)crash|exit|EOF|lost|fail"):
        resume.score_missing(kept, paras(spark, 200), breaking, wait=0)
    done = {r["para_id"] for r in kept.newest().collect()}
    assert len(done) >= 100 and 150 not in done
    first = counted(folder)
    resume.score_missing(kept, paras(spark, 200), fine, wait=0)
    again = counted(folder) - first
    assert set(again) == set(range(200)) - done and all(n == 1 for n in again.values())
    rows = kept.newest().collect()
    assert sorted(r["para_id"] for r in rows) == list(range(200)) and all(r["score"] == 1 for r in rows)


def test_the_store_compacts_and_joins_by_bucket(spark, tmp_path):
    kept = resume.ScoreStore(spark, str(tmp_path / "scores"), buckets=4)
    assert kept.newest().count() == 0
    kept.add(spark.createDataFrame([(i, 1, "a") for i in range(50)], "para_id long, score int, reason string"))
    kept.compact()
    kept.add(spark.createDataFrame([(7, -1, "b"), (60, 0, "parse_fallback")], "para_id long, score int, reason string"))
    for _ in range(2):
        assert kept.base().count() + kept.log().count() in (52, 51)
        got = {r["para_id"]: (r["score"], r["reason"]) for r in kept.newest().collect()}
        assert len(got) == 51 and got[7] == (-1, "b") and got[60] == (0, "parse_fallback")
        assert sorted(r["para_id"] for r in kept.without(paras(spark, 64)).collect()) == [*range(50, 60), 61, 62, 63]
        kept.compact()
    assert kept.generation() == 3 and resume.ScoreStore(spark, str(tmp_path / "scores"), buckets=4).newest().count() == 51
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scoring.to_score(paras(spark, 64), kept.base())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_resumed_scoring_adds_nothing_twice(spark, tmp_path):
    source, scores, checkpoint, folder = (str(tmp_path / x) for x in ("in", "scores", "checkpoint", "calls"))
    os.mkdir(folder)

    def scorer(prompt):
        note(folder, asked(prompt))
        return answer(i for i in asked(prompt) if i != 5)

    add = lambda lo, hi: paras(spark, hi, lo).write.mode("append").parquet(source)
    add(0, 12)
    for _ in range(2):
        resume.score_new(spark, source, scores, checkpoint, scorer, wait=0, at_once=2)
    add(6, 20)
    resume.score_new(spark, source, scores, checkpoint, scorer, wait=0)
    assert counted(folder) == collections.Counter({i: 1 for i in range(20)}) + collections.Counter({5: 2})
    kept = resume.ScoreStore(spark, scores)
    got = {r["para_id"]: (r["score"], r["reason"]) for r in kept.newest().collect()}
    assert len(got) == 20 and got[5] == (0, "parse_fallback") and got[4] == (1, "r")
    late = spark.createDataFrame([(3, -1, "later", datetime.datetime(2100, 1, 1))], resume.SCORES)
    late.write.mode("append").parquet(f"{scores}/log-0")
    assert {r["para_id"]: r["score"] for r in kept.newest().collect()}[3] == -1


def test_buckets_serve_joins_and_groups(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 50).alias("speech_id"), F.col("id").alias("v"))
    table = store.write_bucketed(rows, str(tmp_path / "t"), "speech_id", 4)
    plan = table.groupBy("speech_id").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and table.count() == 1000
    store.write_bucketed(rows.limit(10), str(tmp_path / "t"), "speech_id", 4)
    assert spark.table(store.bucketed(spark, str(tmp_path / "t"), store.columns_of(rows), "speech_id", 4)).count() == 10


@pytest.mark.parametrize("name", ["scored_paragraphs", "fallback_rates"])
def test_scores_equal_their_sql_beyond_ten_thousand_rows(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.1")
