"""The stages of the pipeline, and all of it, on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stancewise.llm import tokens

CLASHING = {"score": "own", "held_out": "h", "lang_pred": "p", "mark": "m", "kept": "k", "row": "r", "size": "s", "piece": "x", "Lang_Pred_": "y"}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, exact and near copies, repeated rows and extra columns of clashing names."""
    r = random.Random(5)
    words = lambda n: [f"{r.choice('the a some every no'.split())} word{r.randrange(9999)}" for _ in range(n)]
    family, long = words(120), " ".join(words(6000))
    rows = [(1, None, "s"), (2, "", "s"), (3, "12 34", "s"), (4, "one two three", None), (4, "one two three", None), (5, "one  two\tthree", "t"), (None, "one two three", "t"), (None, "quite other words", "t"), (6, long, "t")]
    rows += [(10 + n, " ".join([*family[:60], f"changed{n}", *family[60:]]), "st"[n % 2]) for n in range(4)] + [(20 + n, " ".join(words(80)), "stu"[n % 3]) for n in range(30)]
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return table.withColumns({c: F.lit(v) for c, v in CLASHING.items()})


def test_stages_keep_the_columns_and_their_values(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, ""))
        assert docs.columns == odd.columns, name
        assert docs.select(*CLASHING).distinct().collect() == odd.select(*CLASHING).distinct().collect(), name
        assert docs.exceptAll(odd.unionAll(odd)).count() == 0, name


def test_language_stage_rejects_only_what_has_no_letter(spark, odd):
    stay = corpus_pipeline.language_id(spark, odd, "").collect()
    assert sorted((x["doc_id"] or 0 for x in stay), key=int) == sorted((x["doc_id"] or 0 for x in odd.collect() if any(c.isalpha() for c in x["text"] or "")), key=int)


def test_near_copies_and_copies_leave_one(spark, odd):
    docs = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, odd, ""), "")
    ids = [x["doc_id"] for x in docs.collect()]
    assert sum(10 <= (i or 0) < 20 for i in ids) == 1 and ids.count(4) == 1 and 5 not in ids and ids.count(None) == 1 and set(range(20, 50)) <= set(ids)


def test_run_on_odd_and_on_no_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    tok = tokens.encoder(tokens.default_path()).tok
    texts = {x["doc_id"]: x["text"] for x in odd.collect()}
    assert rows and {x["doc_id"] for x in rows} <= set(texts)
    assert all(x["start"] + x["length"] <= len(tok.encode(texts[x["doc_id"]], add_special_tokens=False).ids) + 1 for x in rows if x["doc_id"] is not None)
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
