"""Further registered queries: scores against the dictionary, samples and labels, filters, pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import FISCAL_KEYWORDS, FIXTURE, SPANISH
from ..functions.patterns import keyword_pattern
from ..functions.text import sentences, tokens
from ..operators import agreement, index, panel, paragraphs, scoring
from ..sources import tables
from ..sources.landing import landed, new_path
from . import registry
from .stages import Stages
from .registry import COUNTS, KEPT, MATCH, MONTH, OMONTH, PAIRS, PANEL, PARA, REGIMES, SIMS, SPEECH, _hits, _order_months, _pairs, _panel, _paras, _r, _similar, _speeches, _votes, query, z_sql

# text
SPLIT = "list_filter(string_split(regexp_replace(text, '([.!?,;:])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, text, {SPLIT} AS parts FROM documents) SELECT doc_id, CAST(greatest(len(parts), 1) AS INTEGER) AS n, md5(CASE WHEN len(parts) > 0 THEN array_to_string(parts, '|') ELSE text END) AS parts_md5 FROM s")
def sentence_split(spark, sf):
    parts = sentences(F.col("text"))
    return tables.table(spark, sf, "documents").select("doc_id", parts.alias("parts")).select("doc_id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("parts_md5"))


STOPWORDS = ("with", "from", "pour", "nicht", "dans", "sich")


@query(
    f"WITH {PARA} SELECT president, CAST(sum(len(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 4))) AS BIGINT) AS n_all,"
    f" CAST(sum(len(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 4 AND w NOT IN {STOPWORDS}))) AS BIGINT) AS n_kept FROM para GROUP BY president"
)
def words_without_stopwords(spark, sf):
    n = lambda stop: F.sum(F.size(tokens(F.col("text_norm"), 4, stop)))
    return _paras(spark, sf).groupBy("president").agg(n(()).alias("n_all"), n(STOPWORDS).alias("n_kept"))


SPANISH_PARA = PARA.replace(keyword_pattern(FIXTURE.keywords), keyword_pattern(FISCAL_KEYWORDS))


@query(f"WITH {SPANISH_PARA} SELECT lang, count(*) AS n, count(*) FILTER (is_fiscal) AS n_fiscal FROM para GROUP BY lang")
def spanish_relevance(spark, sf):
    """Paragraphs that the shipped Spanish keywords pick, by language."""
    return paragraphs.paragraphs(_speeches(spark, sf), SPANISH).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fiscal").alias("n_fiscal"))


# scores of paragraphs against the dictionary: the stub's score of a relevant paragraph follows from its ids
STUB = f"sc AS (SELECT *, CAST((speech_id * 7 + para_idx * 3) % 3 - 1 AS INTEGER) AS score FROM vote WHERE is_fiscal AND {KEPT})"
LLM = MONTH + f""", {STUB}, lm AS (SELECT year_month, president, count(DISTINCT speech_id) AS n_speeches, count(*) AS n_fiscal_paras, count(*) FILTER (score = 1) AS H_t, count(*) FILTER (score = -1) AS D_t FROM sc GROUP BY ALL),
ln AS (SELECT *, (H_t - D_t) / CAST(n_fiscal_paras AS DOUBLE) AS net FROM lm), ls AS (SELECT *, {z_sql('ln', 'net', 'net_wins', 'net_z', 'net_z_raw')} FROM ln)"""


def _scored(votes):
    rows = votes.filter("is_fiscal").filter(F.col("president").isin(*REGIMES.kept))
    return rows.withColumn("score", (F.col("speech_id") * 7 + F.col("para_idx") * 3) % 3 - 1)


def _both_months(spark, sf):
    """The month tables of the scores and of the dictionary, from votes that are written once."""
    votes = landed(_votes(spark, sf).drop("text_para", "text_norm", "matches"))
    return index.scored_month_signal(_scored(votes)), index.month_signal(index.speech_counts(votes), REGIMES)


@query(f"WITH {LLM} SELECT a.year_month, a.president, a.n_speeches, a.n_fiscal_paras, round(a.net_z, 6) AS net_z, b.n_speeches AS n_speeches_dict, b.n_fiscal_paras AS n_fiscal_paras_dict, round(b.net_z, 6) AS net_z_dict FROM ls a LEFT JOIN sig b USING (year_month, president)")
def scores_with_dictionary(spark, sf):
    ours, theirs = _both_months(spark, sf)
    both = panel.with_other(ours.select("year_month", "president", "n_speeches", "n_fiscal_paras", "net_z"), theirs.select("year_month", "president", "n_speeches", "n_fiscal_paras", "net_z"))
    return _r(both, "net_z", "net_z_dict")


@query(
    f"WITH {LLM}, j AS (SELECT round(a.net_z, 9) AS a, round(b.net_z, 9) AS b FROM ls a JOIN sig b USING (year_month, president)), k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,"
    " rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 4) AS pearson, round(corr(ra, rb), 4) AS spearman FROM k"
)
def cross_validation(spark, sf):
    ours, theirs = (x.withColumn("net_z", F.round("net_z", 9)) for x in _both_months(spark, sf))
    return panel.cross_validated(ours, theirs, "net_z", "net_z").withColumns({c: F.round(c, 4) for c in ("pearson", "spearman")})


@query(
    f"WITH {PARA}, i AS (SELECT *, row_number() OVER (ORDER BY speech_id, para_idx) - 1 AS para_id FROM para)"
    " SELECT para_id, is_fiscal, CASE WHEN is_fiscal THEN CAST(para_id % 3 - 1 AS INTEGER) ELSE 0 END AS score, CASE WHEN is_fiscal THEN 'r' || para_id ELSE '' END AS reason FROM i"
)
def paragraphs_with_scores(spark, sf):
    """Scores of the relevant paragraphs joined back to all of them."""
    paras = paragraphs.numbered(landed(_paras(spark, sf).select("speech_id", "para_idx", "is_fiscal")))
    scores = paras.filter("is_fiscal").select("para_id", (F.col("para_id") % 3 - 1).cast("int").alias("score"), F.concat(F.lit("r"), F.col("para_id").cast("string")).alias("reason"))
    return scoring.joined_scores(paras, scores).select("para_id", "is_fiscal", "score", "reason")


@query(f"WITH {PARA} SELECT speech_id, para_idx FROM para WHERE is_fiscal AND speech_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def paragraphs_without_examples(spark, sf):
    examples = tables.table(spark, sf, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("speech_id"))
    return scoring.without_examples(_paras(spark, sf).filter("is_fiscal"), examples, "speech_id").select("speech_id", "para_idx")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 100")
def simple_sample(spark, sf):
    return scoring.simple_sample(tables.table(spark, sf, "documents").select("doc_id", "source"), 100, "doc_id")


# stub replies in SQL: batches of ten by place in the bucket; at one bucket that is the place in order of the id
ASKED = PARA + """, ask AS (SELECT row_number() OVER (ORDER BY speech_id, para_idx) - 1 AS para_id FROM para WHERE is_fiscal), bat AS (SELECT para_id, para_id // 10 AS batch FROM ask),
bad AS (SELECT batch, CAST(sum(para_id) AS BIGINT) % 7 = 0 AS broken FROM bat GROUP BY batch),
rep AS (SELECT para_id, CASE WHEN broken THEN 0 WHEN abs(para_id % 5 - 2) = 2 THEN 0 ELSE CAST(para_id % 5 - 2 AS INTEGER) END AS score, CASE WHEN broken THEN 'parse_fallback' ELSE 'r' || para_id END AS reason FROM bat JOIN bad USING (batch))"""

registry.ORACLES["scored_paragraphs"] = f"WITH {ASKED} SELECT para_id, CAST(score AS INTEGER) AS score, reason FROM rep"
registry.ORACLES["fallback_rates"] = f"WITH {ASKED} SELECT CASE WHEN reason = 'parse_fallback' THEN reason ELSE 'scored' END AS outcome, count(*) AS n FROM rep GROUP BY 1"


# samples and labels
SAMPLE = PAIRS + """, sp0 AS (SELECT doc_id AS speech_id, human, model, president, human * model = -1 AS disagrees, md5('42' || doc_id) AS h FROM pr),
odd AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY human ORDER BY h, speech_id) AS k FROM sp0 WHERE disagrees) WHERE k <= 6),
rest AS (SELECT * FROM sp0 WHERE speech_id NOT IN (SELECT speech_id FROM odd)),
grp AS (SELECT human, president, count(*) AS n FROM rest GROUP BY ALL),
wnt AS (SELECT human, 24 - (SELECT count(*) FROM odd o WHERE o.human = g.human) AS want, sum(n) AS total FROM grp g GROUP BY human),
lst AS (SELECT human, any_value(want) AS want, list(president ORDER BY president) AS gs, list(CAST(greatest(1, round_even(CAST(want AS DOUBLE) * n / total, 0)) AS INTEGER) ORDER BY president) AS qs FROM grp JOIN wnt USING (human) GROUP BY human),
rec AS (SELECT human, gs, qs, CAST(want - list_sum(qs) AS INTEGER) AS drift FROM lst UNION ALL
  SELECT human, gs, list_transform(qs, lambda x, i: CASE WHEN i = list_position(qs, CASE WHEN drift < 0 THEN list_max(qs) ELSE list_min(qs) END) THEN CAST(x + sign(drift) AS INTEGER) ELSE x END), CAST(drift - sign(drift) AS INTEGER) FROM rec WHERE drift <> 0),
quo AS (SELECT human, unnest(gs) AS president, unnest(qs) AS quota FROM rec WHERE drift = 0),
smp AS (SELECT speech_id, human, model, president, disagrees, h FROM odd UNION ALL
  SELECT speech_id, human, model, president, disagrees, h FROM (SELECT *, row_number() OVER (PARTITION BY human, president ORDER BY h, speech_id) AS k FROM rest) JOIN quo USING (human, president) WHERE k <= least(quota, 24))"""
registry.ORACLES["stratified_sample"] = f"WITH RECURSIVE {SAMPLE} SELECT * EXCLUDE (h) FROM smp"
registry.ORACLES["label_sheet"] = f"WITH RECURSIVE {SAMPLE} SELECT CAST(row_number() OVER (ORDER BY h, speech_id) AS INTEGER) AS item_no, d.text, CAST(NULL AS INTEGER) AS score, '' AS notes FROM smp JOIN documents d ON d.doc_id = speech_id"

RAW = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'n/a' WHEN 3 THEN CAST(3 * quality AS VARCHAR) WHEN 4 THEN CAST(quality - toxic AS VARCHAR) ELSE '0.5' END"


@query(
    f"WITH r AS (SELECT trim(coalesce({RAW}, '')) AS s FROM labels), c AS (SELECT s, CAST(trunc(TRY_CAST(s AS DOUBLE)) AS INTEGER) AS v FROM r)"
    " SELECT CASE WHEN s = '' THEN 'blank' WHEN v IS NULL THEN 'not a number' WHEN v IN (-1, 0, 1) THEN 'kept' ELSE 'out of range' END AS outcome, count(*) AS n FROM c GROUP BY 1"
)
def label_report(spark, sf):
    return agreement.label_report(_raw_labels(spark, sf), "score")


def _raw_labels(spark, sf):
    return tables.table(spark, sf, "labels").select("doc_id", "quality", "toxic", F.expr(RAW.replace("VARCHAR", "STRING")).alias("score"))


@query(
    f"WITH r AS (SELECT CAST(trunc(TRY_CAST({RAW} AS DOUBLE)) AS INTEGER) AS human, quality - toxic AS model FROM labels), p AS (SELECT * FROM r WHERE human IN (-1, 0, 1)),"
    f" g AS (SELECT count(*) AS n, avg(CAST(human = model AS DOUBLE)) AS accuracy, {' + '.join(f'avg(CAST(human = {c} AS DOUBLE)) * avg(CAST(model = {c} AS DOUBLE))' for c in (-1, 0, 1))} AS pe FROM p)"
    " SELECT n, round(accuracy, 6) AS accuracy, round(CASE WHEN 1 - pe > 0 THEN (accuracy - pe) / (1 - pe) ELSE 0.0 END, 6) AS kappa FROM g"
)
def cleaned_label_agreement(spark, sf):
    """Labels as people type them, cleaned, against those of the table."""
    rows = agreement.clean_labels(_raw_labels(spark, sf), "score").select(F.col("score").alias("human"), (F.col("quality") - F.col("toxic")).alias("model"))
    return _r(agreement.kappa(rows), "accuracy", "kappa")


METRIC = "c AS (SELECT president, cls, count(*) FILTER (human = cls AND model = cls) AS tp, count(*) FILTER (human <> cls AND model = cls) AS fp, count(*) FILTER (human = cls AND model <> cls) AS fn FROM pr, (SELECT unnest([-1, 0, 1]) AS cls) GROUP BY ALL), q AS (SELECT *, tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS p, tp / CAST(nullif(tp + fn, 0) AS DOUBLE) AS r FROM c)"


@query(f"WITH {PAIRS}, {METRIC} SELECT president, CAST(cls AS INTEGER) AS cls, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, tp + fn AS support FROM q")
def class_metrics_by_group(spark, sf):
    return _r(agreement.class_metrics(_pairs(spark, sf), ["president"]), "precision", "recall", "f1")


@query(f"WITH {PAIRS}, {METRIC} SELECT president, round(avg(2 * p * r / nullif(p + r, 0)), 6) AS macro_f1 FROM q GROUP BY president")
def macro_f1_by_group(spark, sf):
    return _r(agreement.macro_f1(_pairs(spark, sf), ["president"]), "macro_f1")


# audits and filters
@query(
    f"WITH {MATCH}, c AS (SELECT direction, term, negated, count(*) AS n FROM hit GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY direction, negated ORDER BY n DESC, term) AS INTEGER) AS k FROM c)"
    " SELECT * FROM r WHERE k <= CASE WHEN NOT negated THEN 15 WHEN direction = 'neg' THEN 12 ELSE 10 END"
)
def top_accepted_and_negated(spark, sf):
    counts = _hits(spark, sf).groupBy("direction", "term", "negated").agg(F.count(F.lit(1)).alias("n"))
    most = F.when(~F.col("negated"), 15).when(F.col("direction") == "neg", 12).otherwise(10)
    return counts.withColumn("k", F.row_number().over(W.partitionBy("direction", "negated").orderBy(F.desc("n"), "term"))).filter(F.col("k") <= most)


@query(f"WITH {SIMS} SELECT vec_id, label, round(similarity, 5) AS similarity FROM e WHERE label <> 0 AND similarity >= 0.1 ORDER BY round(similarity, 5) DESC, vec_id LIMIT 10")
def caught_by_similarity_only(spark, sf):
    rows = _similar(spark, sf).filter("label <> 0 AND similarity >= 0.1").withColumn("similarity", F.round("similarity", 5))
    return rows.orderBy(F.desc("similarity"), "vec_id").limit(10)


@query(f"WITH {PARA} SELECT president, count(*) AS n, count(*) FILTER (length(line) <= 2500) AS n_short FROM para GROUP BY president")
def short_paragraphs(spark, sf):
    short = tables.is_short("text_para")
    return _paras(spark, sf).groupBy("president").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("n_short"))


@query(f"WITH {SPEECH} SELECT speech_id, date FROM sp WHERE date IS NULL OR date >= DATE '2020-01-01'")
def speeches_since(spark, sf):
    return tables.since(_speeches(spark, sf).select("speech_id", "date"), "2020-01-01")


@query(f"WITH {OMONTH} SELECT round(avg(net) FILTER (president = '1-URGENT'), 6) AS first, round(avg(net) FILTER (president = '5-LOW'), 6) AS second, round(avg(net) FILTER (president = '1-URGENT') - avg(net) FILTER (president = '5-LOW'), 6) AS gap FROM os")
def group_gap(spark, sf):
    return _r(panel.group_gap(_order_months(spark, sf), "net", "1-URGENT", "5-LOW"), "first", "second", "gap")


IDEOLOGY = ("pour", "with", "dans")


@query(
    f"WITH {PARA}, i AS (SELECT president, is_fiscal, regexp_matches(text_norm, '{keyword_pattern(IDEOLOGY)}') AS is_ideology FROM para)"
    " SELECT president, count(*) FILTER (is_fiscal) AS fiscal, count(*) FILTER (is_ideology) AS ideology, count(*) AS total, round(avg(CAST(is_fiscal AS DOUBLE)), 6) AS share, round(avg(CAST(is_ideology AS DOUBLE)), 6) AS ideology_share FROM i GROUP BY president"
)
def topic_shares(spark, sf):
    rows = _paras(spark, sf).select("president", "is_fiscal", F.col("text_norm").rlike(keyword_pattern(IDEOLOGY)).alias("is_ideology"))
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return rows.groupBy("president").agg(F.count_if("is_fiscal").alias("fiscal"), F.count_if("is_ideology").alias("ideology"), F.count(F.lit(1)).alias("total"), share("is_fiscal").alias("share"), share("is_ideology").alias("ideology_share"))


@query(
    f"WITH {OMONTH} SELECT coalesce(president, 'all') AS president, round(max(net_z_raw), 6) AS raw_hi, round(min(net_z_raw), 6) AS raw_lo, round(max(net_z), 6) AS wins_hi, round(min(net_z), 6) AS wins_lo, round(corr(net_z_raw, net_z), 6) AS r FROM os GROUP BY GROUPING SETS ((president), ())"
)
def winsor_audit(spark, sf):
    rows = _order_months(spark, sf).rollup("president").agg(F.max("net_z_raw").alias("raw_hi"), F.min("net_z_raw").alias("raw_lo"), F.max("net_z").alias("wins_hi"), F.min("net_z").alias("wins_lo"), F.corr("net_z_raw", "net_z").alias("r"))
    return _r(rows.na.fill("all", ["president"]), "raw_hi", "raw_lo", "wins_hi", "wins_lo", "r")


@query(f"WITH {PANEL} SELECT year_month, president, CASE WHEN is_zero_fill THEN 'zero-filled' ELSE 'thin' END AS quality FROM pan WHERE is_zero_fill OR (n_fiscal_paras > 0 AND n_fiscal_paras <= 2)")
def panel_quality(spark, sf):
    return _panel(spark, sf).filter("is_zero_fill OR is_thin").select("year_month", "president", F.when(F.col("is_zero_fill"), "zero-filled").otherwise("thin").alias("quality"))


@query(f"WITH {MONTH} SELECT year_month, president, round(net_z, 6) AS net_z, n_fiscal_paras FROM sig ORDER BY year_month, president")
def narrow_months(spark, sf):
    months = _r(index.month_signal(index.speech_counts(_votes(spark, sf)), REGIMES), "net_z")
    return panel.narrow(months, "net_z", "n_fiscal_paras")


@query(f"WITH {MONTH} SELECT year_month, president, n_fiscal_paras FROM sig WHERE n_fiscal_paras < 6")
def thin_months(spark, sf):
    """Months with fewer than six relevant paragraphs, the looser of the two thin rules."""
    months = index.month_signal(index.speech_counts(_votes(spark, sf)), REGIMES)
    return months.filter("n_fiscal_paras < 6").select("year_month", "president", "n_fiscal_paras")


@query(f"WITH {MONTH} SELECT year_month, president, n_speeches, n_fiscal_paras, round(net, 6) AS net, round(net_z, 6) AS net_z FROM sig")
def staged_months(spark, sf):
    """The whole index as a job over written stages."""
    stages = Stages(spark, new_path(spark))
    stages.build(_speeches(spark, sf), FIXTURE, REGIMES)
    return _r(stages.months().select("year_month", "president", "n_speeches", "n_fiscal_paras", "net", "net_z"), "net", "net_z")


@query(f"WITH {COUNTS} SELECT year_month, president, count(*) AS n_speeches, CAST(sum(n_fiscal_paragraphs) AS BIGINT) AS n_fiscal_paras FROM cnt WHERE n_fiscal_paragraphs < 6 AND {KEPT} GROUP BY ALL")
def small_speeches(spark, sf):
    """Speeches with fewer than six relevant paragraphs, by month."""
    few = index.speech_counts(_votes(spark, sf)).filter("n_fiscal_paragraphs < 6").filter(F.col("president").isin(*REGIMES.kept))
    return few.groupBy("year_month", "president").agg(F.count(F.lit(1)).alias("n_speeches"), F.sum("n_fiscal_paragraphs").cast("long").alias("n_fiscal_paras"))


# pages
CLEANED = "regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?s)<[^>]+>', ' ', 'g')"
HEADED = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]+>', '', 'g')"


def _decoded(sql: str) -> str:
    """The entities of the fixture's pages; the ampersand last, so that nothing is decoded twice."""
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        sql = f"replace({sql}, '{name}', '{c}')"
    return sql


MONTHS = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"
DATED = r"'(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})'"
registry.ORACLES["page_speeches"] = f"""
    WITH t AS (SELECT page_id, url, html, trim(regexp_replace({_decoded(CLEANED)}, '\\s+', ' ', 'g')) AS text, regexp_extract(html, '(?is)<time[^>]*>(.*?)</time>', 1) AS time, {_decoded(HEADED)} AS head FROM pages),
    d AS (SELECT *, lower(CASE WHEN contains(html, '<time') THEN time ELSE substr(head, 1, 500) END) AS near,
      len(list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '[^a-z\\s]', '', 'g'), '\\s+'), lambda w: w <> '')) AS n_words FROM t)
    SELECT page_id, url, text, CAST(n_words AS BIGINT) AS n_words,
      CAST(TRY_STRPTIME(regexp_extract(near, {DATED}, 3) || '-' || list_position({MONTHS}, regexp_extract(near, {DATED}, 2)) || '-' || regexp_extract(near, {DATED}, 1), '%Y-%m-%d') AS DATE) AS date FROM d WHERE n_words >= 50"""
