"""Readers, writers, dates and matching on small files and rows."""

import datetime

from pyspark.sql import functions as F

from stancewise.functions import text
from stancewise.functions.config import FISCAL_KEYWORDS, FIXTURE
from stancewise.jobs import registry
from stancewise.operators import agreement, index, paragraphs
from stancewise.sources import tables


def test_speech_csv_with_line_feeds_and_quotes(spark, tmp_path):
    (tmp_path / "s.csv").write_text('speech_id,date,url,president,president_id,year,month,year_month,n_words,text_raw\n0,2020-01-02,u,AF,4,2020,1,2020-01,3,"one ""two""\nthree"\n1,,u,AF,4,,,,,\n')
    first, second = tables.speeches_csv(spark, str(tmp_path / "s.csv")).orderBy("speech_id").collect()
    assert first["text_raw"] == 'one "two"\nthree' and first["date"] == datetime.date(2020, 1, 2) and second["date"] is None


def test_dictionaries_become_a_lexicon(spark, tmp_path):
    (tmp_path / "pos.txt").write_text("# comment\n\nAjuste Fiscal\najuste fiscal\nDéficit  cero\nno hay plata\n")
    (tmp_path / "neg.txt").write_text("obra pública\n")
    found = tables.lexicon(spark, str(tmp_path / "pos.txt"), str(tmp_path / "neg.txt"))
    assert found.positive == ("ajuste fiscal", "deficit cero", "no hay plata") and found.negative == ("obra publica",) and found.keywords == FISCAL_KEYWORDS and len(FISCAL_KEYWORDS) == 22
    filler = " palabra" * 20
    rows = [(1, "bueno, no hay plata ni reajuste fiscal" + filler), (2, "nunca vamos a parar la obra pública" + filler), (3, "supuesto déficit cero" + filler)]
    speeches = spark.createDataFrame(rows, "speech_id long, text_raw string").withColumns({"date": F.lit(None).cast("date"), "president": F.lit("x"), "president_id": F.lit(1), "year_month": F.lit("2020-01")})
    hits = paragraphs.one_per_match(paragraphs.with_matches(paragraphs.paragraphs(speeches, found), found))
    got = {(r["speech_id"], r["term"]): r["negated"] for r in hits.collect()}
    assert got == {(1, "no hay plata"): False, (1, "ajuste fiscal"): False, (2, "obra publica"): False, (3, "deficit cero"): True}
    assert tables.word_list(spark, str(tmp_path / "neg.txt")) == ("obra publica",)


def test_month_series_and_stage_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Month,Score\n01/02/2016,1.5\n2016-03,x\n")
    rows = tables.month_series(spark, str(tmp_path / "m.csv"))
    assert [tuple(r) for r in rows.orderBy("year_month").collect()] == [("2016-02", 1.5), ("2016-03", None)]
    tables.write_stage(rows.withColumn("president", F.lit("AF")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "president=AF").is_dir() and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_label_sheet_comes_back(spark, tmp_path):
    sheet = agreement.label_sheet(spark.createDataFrame([(i, f"a,\n{i}") for i in range(6)], "id long, text string"), "id", "text").orderBy("item_no").collect()
    filled = ["1", "", "0.5", "n/a", "7", "-1"]
    (tmp_path / "l.csv").write_text("item_no,text,score,notes\n" + "".join(f'{r["item_no"]},"{r["text"]}",{s},\n' for r, s in zip(sheet, filled, strict=True)))
    labels = tables.labels_csv(spark, str(tmp_path / "l.csv"))
    assert {r["item_no"]: r["score"] for r in agreement.clean_labels(labels, "score").collect()} == {1: 1, 3: 0, 6: -1}
    assert {r["outcome"]: r["n"] for r in agreement.label_report(labels, "score").collect()} == {"kept": 3, "blank": 1, "not a number": 1, "out of range": 1}


def test_sentences(spark):
    rows = [(1, "One. Two; three, four"), (2, ""), (3, "3.5 is no end"), (4, ". ")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i long, t string").select("i", text.sentences(F.col("t"))).collect()}
    assert got == {1: ["One.", "Two;", "three,", "four"], 2: [""], 3: ["3.5 is no end"], 4: ["."]}


def test_ids_are_dense_for_sparse_speeches(spark):
    rows = [(hash(str(i)) % 10**15, i % 3) for i in range(500)]
    got = paragraphs.numbered(spark.createDataFrame(rows, "speech_id long, para_idx int").repartition(5)).orderBy("speech_id", "para_idx").collect()
    assert [r["para_id"] for r in got] == list(range(500))


def test_matching_is_evaluated_once(spark, small):
    """One normalising and one search for terms in the plan of the match table and of the votes."""
    for name in ("w1_matches", "w1_votes", "w1_speech_counts"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 1 and plan.count("ArrowEvalPython") == 1, name


def test_speech_of_no_votes(spark):
    rows = [(1, False, 0, 0, 0, 0, 0, 0)]
    votes = spark.createDataFrame(rows, "speech_id long, is_fiscal boolean, has_pos int, has_neg int, pos_hits int, neg_hits int, pos_negated int, neg_negated int")
    got = index.speech_counts(votes.withColumns({"date": F.lit(None).cast("date"), "president": F.lit("AF"), "year_month": F.lit("2020-01")})).first()
    assert got["net_share"] is None and got["n_paragraphs"] == 1 and FIXTURE.weak_window == 3
