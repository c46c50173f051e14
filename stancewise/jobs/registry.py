"""All registered queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import FIXTURE, Regimes
from ..functions.patterns import cue_pattern, keyword_pattern, term_pattern
from ..functions.text import normalise, tokens, truncated
from ..operators import agreement, index, panel, paragraphs, quantiles, scoring, similarity, topics
from ..sources import tables
from ..sources.landing import landed

REGIMES = Regimes()
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _speeches(spark: SparkSession, sf: str) -> DataFrame:
    return tables.speeches(tables.table(spark, sf, "documents"), REGIMES)


def _paras(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.paragraphs(_speeches(spark, sf), FIXTURE)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.one_per_match(paragraphs.with_matches(_paras(spark, sf), FIXTURE))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.with_votes(paragraphs.with_matches(_paras(spark, sf), FIXTURE))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# SQL building blocks
NORM = "trim(regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^a-z]+', ' ', 'g'))"
DATE = "CAST(DATE '2015-12-10' + CAST((doc_id * 41) % 3700 AS INTEGER) AS DATE)"
CASE = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN {{}}" for a, b, _, _ in REGIMES.intervals) + " ELSE {} END"
WHO = CASE.format(*[f"'{n}'" for *_, n, _ in REGIMES.intervals], "'Unknown'")
WHO_ID = CASE.format(*[str(k) for *_, k in REGIMES.intervals], "0")
SPEECH = f"d0 AS (SELECT doc_id AS speech_id, {DATE} AS date, text, source, lang FROM documents), sp AS (SELECT *, {WHO} AS president, {WHO_ID} AS president_id, strftime(date, '%Y-%m') AS year_month FROM d0)"
PARA = SPEECH + f""", l0 AS (SELECT speech_id, date, president, year_month, source, lang, string_split(text, chr(10)) AS ls FROM sp),
l1 AS (SELECT * EXCLUDE (ls), unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS para_idx FROM l0),
l2 AS (SELECT *, {NORM.format("line")} AS text_norm FROM l1),
l3 AS (SELECT *, CAST(len(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 3)) AS INTEGER) AS n_tokens FROM l2),
para AS (SELECT *, regexp_matches(text_norm, '{keyword_pattern(FIXTURE.keywords)}') AS is_fiscal FROM l3 WHERE n_tokens >= 20)"""
TERMS = ", ".join(f"('{d}', '{t}', '{term_pattern(t)}')" for d, ts in (("pos", FIXTURE.positive), ("neg", FIXTURE.negative)) for t in ts)
MATCH = PARA + f""", terms(direction, term, pattern) AS (VALUES {TERMS}),
m0 AS (SELECT p.speech_id, p.para_idx, p.text_norm, t.* FROM para p, terms t WHERE regexp_matches(p.text_norm, t.pattern)),
m1 AS (""" + " UNION ALL ".join(
    f"SELECT speech_id, para_idx, direction, term, regexp_extract_all(text_norm, '{term_pattern(t)}') AS hits, string_split_regex(text_norm, '{term_pattern(t)}') AS gaps FROM m0 WHERE term = '{t}'" for t in (*FIXTURE.positive, *FIXTURE.negative)
) + f"""), m2 AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM m1),
m3 AS (SELECT speech_id, para_idx, direction, term, array_to_string(list_transform(range(1, k + 1), lambda i: CASE WHEN i > 1 THEN hits[i - 1] ELSE '' END || gaps[i]), '') AS before FROM m2),
m4 AS (SELECT *, list_filter(string_split(before, ' '), lambda w: w <> '') AS ws FROM m3),
hit AS (SELECT speech_id, para_idx, direction, term,
  regexp_matches(array_to_string(ws[-10:], ' '), '{cue_pattern(FIXTURE.strong)}') OR (direction = 'neg' AND regexp_matches(array_to_string(ws[-10:], ' '), '{cue_pattern(FIXTURE.gated)}'))
  OR regexp_matches(array_to_string(ws[-3:], ' '), '{cue_pattern(FIXTURE.weak)}') AS negated FROM m4)"""
VOTE = MATCH + """, v0 AS (SELECT speech_id, para_idx, count(*) FILTER (direction = 'pos' AND NOT negated) AS ph, count(*) FILTER (direction = 'neg' AND NOT negated) AS nh,
  count(*) FILTER (direction = 'pos' AND negated) AS pn, count(*) FILTER (direction = 'neg' AND negated) AS nn FROM hit GROUP BY ALL),
vote AS (SELECT p.*, CAST(coalesce(ph, 0) AS INTEGER) AS pos_hits, CAST(coalesce(nh, 0) AS INTEGER) AS neg_hits, CAST(coalesce(pn, 0) AS INTEGER) AS pos_negated, CAST(coalesce(nn, 0) AS INTEGER) AS neg_negated,
  CAST(coalesce(ph, 0) > 0 AS INTEGER) AS has_pos, CAST(coalesce(nh, 0) > 0 AS INTEGER) AS has_neg FROM para p LEFT JOIN v0 USING (speech_id, para_idx))"""
COUNTS = VOTE + """, cnt AS (SELECT speech_id, min(date) AS date, min(president) AS president, min(year_month) AS year_month, count(*) AS n_paragraphs, count(*) FILTER (is_fiscal) AS n_fiscal_paragraphs,
  count(*) FILTER (is_fiscal AND has_pos = 1) AS pos_fiscal_paras, count(*) FILTER (is_fiscal AND has_neg = 1) AS neg_fiscal_paras,
  count(*) FILTER (is_fiscal AND has_pos = 0 AND has_neg = 0) AS neutral_fiscal_paras, count(*) FILTER (NOT is_fiscal AND has_pos = 1) AS pos_nonfiscal_paras,
  count(*) FILTER (NOT is_fiscal AND has_neg = 1) AS neg_nonfiscal_paras, CAST(sum(pos_hits) AS BIGINT) AS pos_hits_total, CAST(sum(neg_hits) AS BIGINT) AS neg_hits_total,
  CAST(sum(pos_negated) AS BIGINT) AS pos_negated_total, CAST(sum(neg_negated) AS BIGINT) AS neg_negated_total FROM vote GROUP BY speech_id)"""
KEPT = "president IN ('Macri', 'AF', 'Milei')"


def z_sql(source: str, raw: str, wins: str, z: str, z_raw: str | None) -> str:
    """Columns of a winsorised and standardised series of a CTE."""
    clip = f"CASE WHEN {raw} IS NOT NULL THEN least(greatest({raw}, (SELECT quantile_cont({raw}, 0.025) FROM {source})), (SELECT quantile_cont({raw}, 0.975) FROM {source})) END"
    score = lambda c, src: f"CASE WHEN (SELECT stddev_samp({c}) FROM {src}) > 0 THEN ({c} - (SELECT avg({c}) FROM {src})) / (SELECT stddev_samp({c}) FROM {src}) ELSE 0.0 END"
    inner = f"(SELECT {clip} AS w FROM {source})"
    out = f"{clip} AS {wins}, " + score("w", inner).replace("(w -", f"({clip} -") + f" AS {z}"
    return out + (f", {score(raw, source)} AS {z_raw}" if z_raw else "")


MONTH = COUNTS + f""", mo AS (SELECT year_month, president, count(*) AS n_speeches, CAST(sum(n_fiscal_paragraphs) AS BIGINT) AS n_fiscal_paras, CAST(sum(n_paragraphs) AS BIGINT) AS n_total_paras,
  CAST(sum(pos_fiscal_paras) AS BIGINT) AS H_t, CAST(sum(neg_fiscal_paras) AS BIGINT) AS D_t FROM cnt WHERE {KEPT} GROUP BY ALL),
mn AS (SELECT *, CASE WHEN n_fiscal_paras > 0 THEN (H_t - D_t) / CAST(n_fiscal_paras AS DOUBLE) END AS net, CASE WHEN n_total_paras > 0 THEN (H_t - D_t) / CAST(n_total_paras AS DOUBLE) END AS net_rob FROM mo),
sig AS (SELECT *, {z_sql("mn", "net", "net_wins", "net_z", "net_z_raw")}, {z_sql("mn", "net_rob", "net_rob_wins", "net_rob_z", None)} FROM mn)"""


# the flagship, stage by stage
@query(f"WITH {SPEECH} SELECT speech_id, date, president, president_id, year_month FROM sp")
def w1_speeches(spark, sf):
    return _speeches(spark, sf).select("speech_id", "date", "president", "president_id", "year_month")


@query(f"WITH {PARA} SELECT speech_id, para_idx, n_tokens, is_fiscal, md5(text_norm) AS norm_md5 FROM para")
def w1_paragraphs(spark, sf):
    return _paras(spark, sf).select("speech_id", "para_idx", "n_tokens", "is_fiscal", F.md5("text_norm").alias("norm_md5"))


@query(f"WITH {MATCH} SELECT speech_id, para_idx, direction, term, negated, count(*) AS n FROM hit GROUP BY ALL")
def w1_matches(spark, sf):
    return _hits(spark, sf).groupBy("speech_id", "para_idx", "direction", "term", "negated").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VOTE} SELECT speech_id, para_idx, is_fiscal, pos_hits, neg_hits, pos_negated, neg_negated, has_pos, has_neg FROM vote")
def w1_votes(spark, sf):
    return _votes(spark, sf).select("speech_id", "para_idx", "is_fiscal", "pos_hits", "neg_hits", "pos_negated", "neg_negated", "has_pos", "has_neg")


@query(f"WITH {COUNTS} SELECT *, round(CASE WHEN n_fiscal_paragraphs > 0 THEN (pos_fiscal_paras - neg_fiscal_paras) / CAST(n_fiscal_paragraphs AS DOUBLE) END, 6) AS net_share FROM cnt")
def w1_speech_counts(spark, sf):
    return _r(index.speech_counts(_votes(spark, sf)), "net_share")


@query(f"WITH {MONTH} SELECT year_month, president, n_speeches, n_fiscal_paras, n_total_paras, H_t, D_t, round(net, 6) AS net, round(net_rob, 6) AS net_rob, round(net_wins, 6) AS net_wins, round(net_z, 6) AS net_z, round(net_z_raw, 6) AS net_z_raw, round(net_rob_wins, 6) AS net_rob_wins, round(net_rob_z, 6) AS net_rob_z FROM sig")
def w1_month_signal(spark, sf):
    return _r(index.month_signal(index.speech_counts(_votes(spark, sf)), REGIMES), "net", "net_rob", "net_wins", "net_z", "net_z_raw", "net_rob_wins", "net_rob_z")


# audit and exploration
@query(f"WITH {MATCH} SELECT president, direction, count(*) FILTER (NOT negated) AS accepted, count(*) FILTER (negated) AS negated_n, round(100.0 * count(*) FILTER (negated) / count(*), 6) AS pct FROM hit JOIN sp USING (speech_id) GROUP BY ALL")
def negation_report(spark, sf):
    out = _hits(spark, sf).groupBy("president", "direction").agg(F.count_if(~F.col("negated")).alias("accepted"), F.count_if("negated").alias("negated_n"))
    return out.withColumn("pct", F.round(100.0 * F.col("negated_n") / (F.col("accepted") + F.col("negated_n")), 6))


@query(f"WITH {VOTE} SELECT president, count(*) FILTER (is_fiscal) AS p, count(*) FILTER (is_fiscal AND has_pos = 1) AS h, count(*) FILTER (is_fiscal AND has_neg = 1) AS d, round((count(*) FILTER (is_fiscal AND has_pos = 1) - count(*) FILTER (is_fiscal AND has_neg = 1)) / CAST(nullif(count(*) FILTER (is_fiscal), 0) AS DOUBLE), 6) AS net FROM vote GROUP BY president")
def vote_table(spark, sf):
    rel = F.col("is_fiscal")
    out = _votes(spark, sf).groupBy("president").agg(F.count_if(rel).alias("p"), F.count_if(rel & (F.col("has_pos") == 1)).alias("h"), F.count_if(rel & (F.col("has_neg") == 1)).alias("d"))
    return out.withColumn("net", F.round(F.try_divide(F.col("h") - F.col("d"), F.col("p")), 6))


@query(f"WITH {VOTE} SELECT president, CASE WHEN NOT is_fiscal THEN 'other' WHEN has_pos + has_neg = 0 THEN 'no hit' WHEN has_neg = 0 THEN 'positive' WHEN has_pos = 0 THEN 'negative' ELSE 'both' END AS composition, count(*) AS n FROM vote GROUP BY ALL")
def composition(spark, sf):
    kind = F.when(~F.col("is_fiscal"), "other").when(F.col("has_pos") + F.col("has_neg") == 0, "no hit").when(F.col("has_neg") == 0, "positive").when(F.col("has_pos") == 0, "negative").otherwise("both")
    return _votes(spark, sf).groupBy("president", kind.alias("composition")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VOTE} SELECT count(*) AS n, count(*) FILTER (pos_hits + neg_hits > 0) AS n_hit, round(avg(CAST(pos_hits + neg_hits > 0 AS DOUBLE)), 6) AS share FROM vote WHERE is_fiscal")
def hit_rate(spark, sf):
    hit = F.col("pos_hits") + F.col("neg_hits") > 0
    return _votes(spark, sf).filter("is_fiscal").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"), F.round(F.avg(hit.cast("double")), 6).alias("share"))


@query(f"WITH {MATCH} SELECT term, {', '.join(f'''count(*) FILTER (president = '{g}') AS {g}''' for g in REGIMES.kept)} FROM hit JOIN sp USING (speech_id) WHERE NOT negated GROUP BY term ORDER BY count(*) DESC, term LIMIT 20")
def term_pivot(spark, sf):
    terms = _hits(spark, sf).filter("NOT negated").groupBy("term").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("president") == g).alias(g) for g in REGIMES.kept])
    return terms.orderBy(F.desc("n"), "term").limit(20).drop("n")


@query(f"WITH {MATCH}, c AS (SELECT president, term, count(*) AS n FROM hit JOIN sp USING (speech_id) WHERE NOT negated GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY president ORDER BY n DESC, term) AS INTEGER) AS k FROM c) SELECT president, term, n, k FROM r WHERE k <= 3")
def top_terms(spark, sf):
    counts = _hits(spark, sf).filter("NOT negated").groupBy("president", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", F.row_number().over(W.partitionBy("president").orderBy(F.desc("n"), "term"))).filter("k <= 3")


@query(f"WITH {MATCH} SELECT direction, term FROM terms EXCEPT SELECT direction, term FROM hit WHERE NOT negated")
def zero_hit_terms(spark, sf):
    terms = spark.createDataFrame([("pos", t) for t in FIXTURE.positive] + [("neg", t) for t in FIXTURE.negative], "direction string, term string")
    seen = _hits(spark, sf).filter("NOT negated").select("direction", "term").distinct()
    return terms.join(seen, ["direction", "term"], "left_anti")


@query(f"WITH {PARA}, w AS (SELECT president, unnest(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 4)) AS word FROM para WHERE is_fiscal), c AS (SELECT president, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY president ORDER BY n DESC, word) AS INTEGER) AS k FROM c) SELECT president, word, n, k FROM r WHERE k <= 120")
def word_frequencies(spark, sf):
    words = _paras(spark, sf).filter("is_fiscal").select("president", F.explode(tokens(F.col("text_norm"), 4)).alias("word"))
    counts = words.groupBy("president", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", F.row_number().over(W.partitionBy("president").orderBy(F.desc("n"), "word"))).filter("k <= 120")


@query(f"WITH {PARA} SELECT president, year_month, count(*) FILTER (is_fiscal) AS fiscal, count(*) AS total, round(avg(CAST(is_fiscal AS DOUBLE)), 6) AS share FROM para GROUP BY ALL")
def fiscal_share(spark, sf):
    return _paras(spark, sf).groupBy("president", "year_month").agg(F.count_if("is_fiscal").alias("fiscal"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("is_fiscal").cast("double")), 6).alias("share"))


WORDS = f"len(string_split({NORM.format('text')}, ' '))"


def _sized(spark, sf):
    return _speeches(spark, sf).withColumn("n_words", F.size(F.split(normalise(F.col("text_raw")), " ")).cast("long"))


@query(f"WITH {SPEECH}, s AS (SELECT *, CAST({WORDS} AS BIGINT) AS n_words FROM sp) SELECT president, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words, round(avg(n_words), 6) AS mean, median(n_words) AS median, round(stddev_samp(n_words), 6) AS sd, min(n_words) AS lo, max(n_words) AS hi, min(date) AS first, max(date) AS last FROM s GROUP BY president")
def corpus_summary(spark, sf):
    n, rows = "n_words", landed(_sized(spark, sf).select("president", "n_words", "date"))
    sums = rows.groupBy("president").agg(
        F.count(F.lit(1)).alias("n"), F.sum(n).alias("words"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("sd"), F.min(n).alias("lo"), F.max(n).alias("hi"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )
    return sums.join(quantiles.exact_quantiles(rows, ["president"], n, {"median": 0.5}), "president")


@query(f"WITH {SPEECH}, s AS (SELECT *, CAST({WORDS} AS BIGINT) AS n_words FROM sp) SELECT president, year_month, count(*) AS n, round(avg(n_words), 6) AS mean_words FROM s GROUP BY ALL")
def month_volume(spark, sf):
    return _sized(spark, sf).groupBy("president", "year_month").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_words"), 6).alias("mean_words"))


@query(f"WITH {SPEECH}, s AS (SELECT *, CAST({WORDS} AS BIGINT) AS n_words FROM sp), t AS (SELECT speech_id, n_words, 'long' AS side FROM s ORDER BY n_words DESC, speech_id LIMIT 10), u AS (SELECT speech_id, n_words, 'short' AS side FROM s ORDER BY n_words, speech_id LIMIT 10) SELECT * FROM t UNION ALL SELECT * FROM u")
def extremes(spark, sf):
    s = _sized(spark, sf).select("speech_id", "n_words")
    return s.orderBy(F.desc("n_words"), "speech_id").limit(10).withColumn("side", F.lit("long")).unionByName(s.orderBy("n_words", "speech_id").limit(10).withColumn("side", F.lit("short")))


@query(f"WITH {SPEECH}, m AS (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS d FROM sp), c AS (SELECT year_month, count(*) AS n FROM sp GROUP BY 1) SELECT strftime(d, '%Y-%m') AS year_month, coalesce(n, 0) AS n, n IS NULL AS missing FROM m LEFT JOIN c ON c.year_month = strftime(d, '%Y-%m')")
def missing_months(spark, sf):
    s = _speeches(spark, sf)
    spine = s.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(F.explode(F.expr("sequence(trunc(lo, 'month'), trunc(hi, 'month'), interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("year_month"))
    return spine.join(s.groupBy("year_month").agg(F.count(F.lit(1)).alias("k")), "year_month", "left").select("year_month", F.coalesce("k", F.lit(0)).alias("n"), F.col("k").isNull().alias("missing"))


@query("SELECT 'doc_id' AS name, count(*) FILTER (doc_id IS NULL) AS nulls FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents")
def null_counts(spark, sf):
    docs, names = tables.table(spark, sf, "documents"), ["doc_id", "text", "lang", "source"]
    one = docs.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.unpivot([], names, "name", "nulls")


@query(f"WITH {SPEECH} SELECT speech_id, president FROM sp WHERE president IN ('Unknown', 'CFK') OR date IS NULL")
def anomalies(spark, sf):
    return _speeches(spark, sf).filter(F.col("president").isin("Unknown", "CFK") | F.col("date").isNull()).select("speech_id", "president")


@query(f"WITH {SPEECH}, o AS (SELECT speech_id, row_number() OVER (ORDER BY date DESC, speech_id) - 1 AS rank FROM sp) SELECT speech_id, rank FROM o")
def speech_ranks(spark, sf):
    s = _speeches(spark, sf).select("speech_id", "date")
    days = s.groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy(F.desc_nulls_last("date")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(W.partitionBy("date").orderBy("speech_id")) - 1
    ranked = s.withColumn("k", inner)
    days = days.withColumnRenamed("date", "day")
    return ranked.join(days, ranked["date"].eqNullSafe(days["day"])).select("speech_id", (F.col("base") + F.col("k")).alias("rank"))


@query(f"WITH {PARA} SELECT speech_id, para_idx, row_number() OVER (ORDER BY speech_id, para_idx) - 1 AS para_id FROM para")
def paragraph_ids(spark, sf):
    return paragraphs.numbered(landed(_paras(spark, sf).select("speech_id", "para_idx")))


# month series on the dense orders table
ORDERS = "o AS (SELECT strftime(o_orderdate, '%Y-%m') AS year_month, o_orderpriority AS president, o_custkey AS speech_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS score FROM orders)"
OMONTH = ORDERS + f", om AS (SELECT year_month, president, count(DISTINCT speech_id) AS n_speeches, count(*) AS n_fiscal_paras, count(*) FILTER (score = 1) AS H_t, count(*) FILTER (score = -1) AS D_t FROM o GROUP BY ALL), on_ AS (SELECT *, (H_t - D_t) / CAST(n_fiscal_paras AS DOUBLE) AS net FROM om), os AS (SELECT *, {z_sql('on_', 'net', 'net_wins', 'net_z', 'net_z_raw')} FROM on_)"


def _order_scores(spark, sf):
    o = tables.table(spark, sf, "orders")
    score = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"), F.col("o_orderpriority").alias("president"), F.col("o_custkey").alias("speech_id"), score.alias("score"))


def _order_months(spark, sf):
    return index.scored_month_signal(_order_scores(spark, sf))


@query(f"WITH {OMONTH} SELECT year_month, president, n_speeches, n_fiscal_paras, H_t, D_t, round(net, 6) AS net, round(net_wins, 6) AS net_wins, round(net_z, 6) AS net_z, round(net_z_raw, 6) AS net_z_raw FROM os")
def scored_months(spark, sf):
    return _r(_order_months(spark, sf), "net", "net_wins", "net_z", "net_z_raw")


@query(f"WITH {OMONTH} SELECT president, count(net) AS n, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS sd, round(min(net), 6) AS lo, round(max(net), 6) AS hi, round(corr(net, net_wins), 6) AS r, round(max(net_z_raw), 6) AS z_hi, round(max(net_z), 6) AS z_wins_hi FROM os GROUP BY president")
def series_summary(spark, sf):
    return _r(_order_months(spark, sf).groupBy("president").agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd"), F.min("net").alias("lo"), F.max("net").alias("hi"), F.corr("net", "net_wins").alias("r"), F.max("net_z_raw").alias("z_hi"), F.max("net_z").alias("z_wins_hi")), "mean", "sd", "lo", "hi", "r", "z_hi", "z_wins_hi")


ROLLED = "window w AS (ORDER BY year_month, president ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query(f"WITH {OMONTH}, x AS (SELECT year_month, president, count(*) OVER w AS n, corr(net, n_fiscal_paras) OVER w AS r, stddev_samp(net) OVER w AS sa, stddev_samp(n_fiscal_paras) OVER w AS sb FROM os {ROLLED}) SELECT year_month, president, round(r, 4) AS r FROM x WHERE n = 6 AND sa > 0 AND sb > 0")
def rolling_correlation(spark, sf):
    return panel.rolling_correlation(_order_months(spark, sf), "net", "n_fiscal_paras").withColumn("r", F.round("r", 4))


@query(f"WITH {OMONTH} SELECT year_month, president, round(CASE WHEN count(net) OVER w >= 2 THEN avg(net) OVER w END, 6) AS rolling FROM os WINDOW w AS (PARTITION BY president ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark, sf):
    return _r(panel.rolling_mean(_order_months(spark, sf), "net"), "rolling")


@query(f"WITH {OMONTH}, k AS (SELECT net, n_fiscal_paras AS p, rank() OVER (ORDER BY net) + (count(*) OVER (PARTITION BY net) - 1) / 2.0 AS ra, rank() OVER (ORDER BY n_fiscal_paras) + (count(*) OVER (PARTITION BY n_fiscal_paras) - 1) / 2.0 AS rb FROM os) SELECT count(*) AS n, round(corr(net, p), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k")
def correlations(spark, sf):
    return _r(panel.correlations(_order_months(spark, sf), "net", "n_fiscal_paras"), "pearson", "spearman")


@query(f"WITH {OMONTH} SELECT year_month, president, round(abs(net_z - net_z_raw), 6) AS gap FROM os ORDER BY round(abs(net_z - net_z_raw), 6) DESC, year_month, president LIMIT 15")
def divergences(spark, sf):
    gap = F.round(F.abs(F.col("net_z") - F.col("net_z_raw")), 6)
    return _order_months(spark, sf).select("year_month", "president", gap.alias("gap")).orderBy(F.desc("gap"), "year_month", "president").limit(15)


@query(f"WITH {OMONTH}, h AS (SELECT unnest(range(0, 13)) AS h), x AS (SELECT president, year_month, net, lag(net) OVER w AS base, lag(net) OVER w - lag(net, 2) OVER w AS lag_change, row_number() OVER w AS k FROM os WINDOW w AS (PARTITION BY president ORDER BY year_month)) SELECT x.president, x.year_month, CAST(h.h AS INTEGER) AS h, round(y.net - x.base, 6) AS response, round(x.lag_change, 6) AS lag_change FROM x CROSS JOIN h LEFT JOIN x y ON y.president = x.president AND y.k = x.k + h.h")
def local_projection(spark, sf):
    return _r(panel.local_projection(_order_months(spark, sf), "president", "year_month", "net"), "response", "lag_change")


# the compiled panel
PANEL = MONTH + f""", res AS (SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY president) AS k FROM sig WHERE {KEPT} AND (year_month NOT IN ('2019-12', '2023-12') OR (year_month = '2019-12' AND president = 'AF') OR (year_month = '2023-12' AND president = 'Milei'))),
one AS (SELECT year_month, president, net_z AS signal_main, net_rob_z AS signal_robust, net_z_raw AS signal_dictionary, n_fiscal_paras FROM res WHERE k = 1),
spine AS (SELECT strftime(d, '%Y-%m') AS year_month, CAST(d AS DATE) AS date, CASE WHEN strftime(d, '%Y-%m') >= '2023-12' THEN 'Milei' WHEN strftime(d, '%Y-%m') >= '2019-12' THEN 'AF' ELSE 'Macri' END AS president
  FROM (SELECT unnest(generate_series(strptime(min(year_month) || '-01', '%Y-%m-%d'), strptime(max(year_month) || '-01', '%Y-%m-%d'), INTERVAL 1 MONTH)) AS d FROM one)),
pan AS (SELECT year_month, president, date, signal_main IS NULL AS is_zero_fill, CASE WHEN signal_main IS NULL THEN 0.0 ELSE signal_main END AS signal_main, CASE WHEN signal_main IS NULL THEN 0.0 ELSE signal_robust END AS signal_robust,
  CASE WHEN signal_main IS NULL THEN 0.0 ELSE signal_dictionary END AS signal_dictionary, coalesce(n_fiscal_paras, 0) AS n_fiscal_paras FROM spine LEFT JOIN one USING (year_month, president))"""


def _panel(spark, sf):
    months = index.month_signal(index.speech_counts(_votes(spark, sf)), REGIMES)
    each = [panel.resolved(months, c, n, REGIMES) for c, n in (("net_z", "signal_main"), ("net_rob_z", "signal_robust"), ("net_z_raw", "signal_dictionary"))]
    return panel.calendar_panel(panel.merged(*each), REGIMES)


@query(f"WITH {PANEL} SELECT year_month, president, date, round(signal_main, 6) AS signal_main, round(signal_robust, 6) AS signal_robust, round(signal_dictionary, 6) AS signal_dictionary, n_fiscal_paras, is_zero_fill, n_fiscal_paras > 0 AND n_fiscal_paras <= 2 AS is_thin FROM pan")
def compiled_panel(spark, sf):
    return _r(_panel(spark, sf), "signal_main", "signal_robust", "signal_dictionary").select("year_month", "president", "date", "signal_main", "signal_robust", "signal_dictionary", "n_fiscal_paras", "is_zero_fill", "is_thin")


@query(f"WITH {PANEL} SELECT president, count(*) AS n, round(avg(signal_main), 6) AS main, round(avg(signal_robust), 6) AS robust, round(avg(signal_main - signal_robust), 6) AS gap FROM pan WHERE NOT is_zero_fill GROUP BY president")
def panel_means(spark, sf):
    rows = _panel(spark, sf).filter("NOT is_zero_fill").groupBy("president")
    return _r(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("signal_main").alias("main"), F.avg("signal_robust").alias("robust"), F.avg(F.col("signal_main") - F.col("signal_robust")).alias("gap")), "main", "robust", "gap")


@query(f"WITH {COUNTS} SELECT year_month, count(DISTINCT president) AS groups FROM cnt WHERE year_month NOT IN ('2019-12', '2023-12') GROUP BY 1 HAVING count(DISTINCT president) > 1")
def mixed_months(spark, sf):
    s = _paras(spark, sf).select("year_month", "president").filter(~F.col("year_month").isin(*REGIMES.transitions)).distinct()
    return s.groupBy("year_month").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")


# agreement of labels
PAIRS = COUNTS + ", pr AS (SELECT l.doc_id, CAST(l.quality - l.toxic AS INTEGER) AS human, CAST(sign(coalesce(c.pos_fiscal_paras, 0) - coalesce(c.neg_fiscal_paras, 0)) AS INTEGER) AS model, sp.president FROM labels l JOIN sp ON sp.speech_id = l.doc_id LEFT JOIN cnt c ON c.speech_id = l.doc_id)"


def _pairs(spark, sf):
    labels = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("speech_id"), (F.col("quality") - F.col("toxic")).cast("int").alias("human"))
    counts = index.speech_counts(_votes(spark, sf)).select("speech_id", "pos_fiscal_paras", "neg_fiscal_paras")
    joined = labels.join(_speeches(spark, sf).select("speech_id", "president"), "speech_id").join(counts, "speech_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("speech_id", "human", F.signum(zero("pos_fiscal_paras") - zero("neg_fiscal_paras")).cast("int").alias("model"), "president")


@query(f"WITH {PAIRS} SELECT human, count(*) AS n, count(*) FILTER (model = -1) AS n_neg, count(*) FILTER (model = 0) AS n_neutral, count(*) FILTER (model = 1) AS n_pos, round(100.0 * count(*) FILTER (model = -1) / count(*), 4) AS pct_neg, round(100.0 * count(*) FILTER (model = 0) / count(*), 4) AS pct_neutral, round(100.0 * count(*) FILTER (model = 1) / count(*), 4) AS pct_pos FROM pr GROUP BY human")
def confusion(spark, sf):
    return agreement.confusion(_pairs(spark, sf))


@query(f"WITH {PAIRS}, c AS (SELECT cls, count(*) FILTER (human = cls AND model = cls) AS tp, count(*) FILTER (human <> cls AND model = cls) AS fp, count(*) FILTER (human = cls AND model <> cls) AS fn FROM pr, (SELECT unnest([-1, 0, 1]) AS cls) GROUP BY cls), q AS (SELECT *, tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS p, tp / CAST(nullif(tp + fn, 0) AS DOUBLE) AS r FROM c) SELECT CAST(cls AS INTEGER) AS cls, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, tp + fn AS support FROM q")
def class_metrics(spark, sf):
    return _r(agreement.class_metrics(_pairs(spark, sf)), "precision", "recall", "f1")


@query(f"WITH {PAIRS}, g AS (SELECT president, count(*) AS n, avg(CAST(human = model AS DOUBLE)) AS accuracy, {' + '.join(f'avg(CAST(human = {c} AS DOUBLE)) * avg(CAST(model = {c} AS DOUBLE))' for c in (-1, 0, 1))} AS pe FROM pr GROUP BY president) SELECT president, n, round(accuracy, 6) AS accuracy, round(CASE WHEN 1 - pe > 0 THEN (accuracy - pe) / (1 - pe) ELSE 0.0 END, 6) AS kappa FROM g")
def kappa_by_group(spark, sf):
    return _r(agreement.kappa(_pairs(spark, sf), ["president"]), "accuracy", "kappa")


@query(f"WITH {PAIRS} SELECT human, count(*) FILTER (abs(human - model) = 0) AS correct, count(*) FILTER (abs(human - model) = 1) AS adjacent, count(*) FILTER (abs(human - model) = 2) AS extreme FROM pr GROUP BY human")
def error_severity(spark, sf):
    return agreement.severity(_pairs(spark, sf))


@query(None)
def stratified_sample(spark, sf):
    return agreement.stratified_sample(_pairs(spark, sf).withColumn("disagrees", F.col("human") * F.col("model") == -1), "human", "president", "disagrees", "speech_id")


# embeddings
NORMED = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * x)))"
SIMS = f"s AS (SELECT embedding AS se FROM embeddings WHERE vec_id < 20), e AS (SELECT vec_id, label, max(list_sum(list_transform(list_zip(embedding, se), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / ({NORMED.format('embedding')} * {NORMED.format('se')})) AS similarity FROM embeddings, s GROUP BY ALL)"


def _similar(spark, sf):
    v = tables.table(spark, sf, "embeddings")
    return similarity.seed_similarity(v, v.filter("vec_id < 20"))


@query(f"WITH {SIMS} SELECT vec_id, round(similarity, 5) AS similarity FROM e")
def seed_similarity(spark, sf):
    return _similar(spark, sf).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(f"WITH {SIMS}, t AS (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4]) AS DOUBLE) AS threshold), c AS (SELECT threshold, count(*) FILTER (similarity >= threshold) AS n, count(*) FILTER (similarity >= threshold AND label = 0) AS agree, count(*) FILTER (similarity >= threshold AND label <> 0) AS only_score, count(*) FILTER (similarity < threshold AND label = 0) AS only_flag FROM e, t GROUP BY threshold) SELECT *, round(agree / CAST(nullif(n, 0) AS DOUBLE), 6) AS precision, round(agree / CAST(nullif(agree + only_flag, 0) AS DOUBLE), 6) AS recall, round(2.0 * agree / nullif(n + agree + only_flag, 0), 6) AS f1 FROM c")
def threshold_sweep(spark, sf):
    return _r(agreement.threshold_sweep(_similar(spark, sf).withColumn("flag", F.col("label") == 0), "similarity", "flag", [0.1, 0.2, 0.3, 0.4]), "precision", "recall", "f1")


# pages and prompts
@query(
    "WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS url FROM pages), a AS (SELECT CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://pages.example' || url END AS url FROM l)"
    " SELECT DISTINCT url FROM a WHERE contains(url, '.example/') AND NOT contains(url, 'the')"
)
def page_links(spark, sf):
    return tables.page_links(tables.table(spark, sf, "pages"), ".example/", "the", "https://pages.example")


@query(None)
def page_speeches(spark, sf):
    return tables.page_speeches(tables.table(spark, sf, "pages"), (("article", None, None),))


@query("SELECT doc_id, CASE WHEN length(text) <= 800 THEN text WHEN length(regexp_extract(substr(text, 1, 800), '(?s)^(.*[.?!]) ', 1)) > 400 THEN regexp_extract(substr(text, 1, 800), '(?s)^(.*[.?!]) ', 1) || ' [...]' ELSE regexp_replace(substr(text, 1, 800), '\\s+$', '') || ' [...]' END AS short FROM documents")
def truncated_texts(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", truncated(F.col("text")).alias("short"))


def _asked(spark, sf):
    """The relevant paragraphs, as much of them as a prompt shows, written once; numbered by their keys."""
    shown = _paras(spark, sf).filter("is_fiscal").select("speech_id", "para_idx", truncated(F.col("text_para")).alias("text"))
    return paragraphs.numbered(landed(shown))


def _stub(prompt: str) -> str:
    """A deterministic local scorer: scores -2..2 by id (2 and -2 test the range rule), one batch in seven without brackets."""
    import json
    import re

    ids = [int(x) for x in re.findall(r"^\d+\. \[id=(\d+)\]", prompt, re.M)]
    items = [{"id": i, "score": i % 5 - 2, "reason": f"r{i}"} for i in ids]
    return "no idea" if sum(ids) % 7 == 0 else "```json\n" + json.dumps(items) + "\n```"


@query(None)
def scored_paragraphs(spark, sf):
    return scoring.scored(scoring.batched(_asked(spark, sf), numbered=True), _stub, wait=0)


@query(f"WITH {PARA} SELECT count(*) AS n, count(*) // 10 AS calls, count(*) // 10 * 350 + count(*) * 120 AS tokens_in, count(*) * 30 AS tokens_out, round((count(*) // 10 * 350 + count(*) * 120) * 0.15 / 1e6 + count(*) * 30 * 0.6 / 1e6, 6) AS usd FROM para WHERE is_fiscal")
def cost_estimate(spark, sf):
    return scoring.cost(_paras(spark, sf).filter("is_fiscal"))


@query(ORACLES["w1_matches"])
def matches_by_helper(spark, sf):
    hits = paragraphs.matches_by_helper(_paras(spark, sf), FIXTURE)
    return hits.groupBy("speech_id", "para_idx", "direction", "term", "negated").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def fallback_rates(spark, sf):
    return scoring.fallback_rates(scored_paragraphs(spark, sf))


# distributions
@query(f"WITH {SPEECH}, s AS (SELECT president, CAST({WORDS} AS DOUBLE) AS x FROM sp), b AS (SELECT president, min(x) AS a, max(x) AS z FROM s GROUP BY 1), p AS (SELECT president, a, (z - a) / 40 AS width, CAST(CASE WHEN z > a THEN least(floor((x - a) * 40 / (z - a)), 39) ELSE 0 END AS INTEGER) AS bin FROM s JOIN b USING (president)) SELECT president, bin, round(a + width * bin, 6) AS lo, round(a + width * (bin + 1), 6) AS hi, count(*) AS n FROM p GROUP BY president, bin, a, width")
def word_histogram(spark, sf):
    return _r(agreement.histogram(_sized(spark, sf), "president", "n_words", 40), "lo", "hi")


@query(f"WITH {SPEECH}, s AS (SELECT president, CAST({WORDS} AS DOUBLE) AS n_words FROM sp) SELECT president, round(quantile_cont(n_words, 0.25), 6) AS q1, round(quantile_cont(n_words, 0.5), 6) AS q2, round(quantile_cont(n_words, 0.75), 6) AS q3 FROM s GROUP BY president")
def word_quartiles(spark, sf):
    found = quantiles.exact_quantiles(_sized(spark, sf), ["president"], "n_words", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return _r(found, "q1", "q2", "q3")


@query(
    f"WITH {SPEECH}, s AS (SELECT speech_id, CAST({WORDS} AS DOUBLE) AS n_words FROM sp), w AS (SELECT *, {z_sql('s', 'n_words', 'wins', 'z', 'z_raw')} FROM s)"
    " SELECT speech_id, round(wins, 6) AS wins, round(z, 6) AS z, round(z_raw, 6) AS z_raw FROM w"
)
def word_scores(spark, sf):
    """Lengths of speeches, winsorised and standardised over all of them: the month rule on rows of any number."""
    rows = _sized(spark, sf).select("speech_id", F.col("n_words").cast("double").alias("n_words"))
    return _r(index.standardised(rows, {"n_words": ("wins", "z", "z_raw")}, months=False), "wins", "z", "z_raw").drop("n_words")


BANDS = [-1.0, 0.0, 0.1, 0.2, 0.3, 0.5, 1.1]
BAND_ROWS = ", ".join(f"(CAST({a} AS DOUBLE), CAST({z} AS DOUBLE))" for a, z in zip(BANDS, BANDS[1:], strict=False))


@query(f"WITH {SIMS}, b(lo, hi) AS (VALUES {BAND_ROWS}) SELECT lo, hi, count(*) AS n, count(*) FILTER (label = 0) AS n_hit, round(avg(CAST(label = 0 AS DOUBLE)), 6) AS rate FROM e JOIN b ON similarity >= lo AND similarity < hi GROUP BY lo, hi")
def band_rates(spark, sf):
    return _r(agreement.band_rates(_similar(spark, sf).withColumn("flag", F.col("label") == 0), "similarity", "flag", BANDS), "rate")


@query(f"WITH {ORDERS} SELECT president, count(*) AS n, count(*) FILTER (score = 1) AS pos, count(*) FILTER (score = 0) AS neutral, count(*) FILTER (score = -1) AS neg, round(100.0 * count(*) FILTER (score = 1) / count(*), 6) AS pct_pos, round(100.0 * count(*) FILTER (score = -1) / count(*), 6) AS pct_neg FROM o GROUP BY president")
def score_distribution(spark, sf):
    at = lambda k: F.count_if(F.col("score") == k)
    out = _order_scores(spark, sf).groupBy("president").agg(F.count(F.lit(1)).alias("n"), at(1).alias("pos"), at(0).alias("neutral"), at(-1).alias("neg"))
    return _r(out.withColumns({f"pct_{c}": 100.0 * F.col(c) / F.col("n") for c in ("pos", "neg")}), "pct_pos", "pct_neg")


@query(f"WITH {OMONTH} SELECT year_month, president, round(H_t / CAST(n_fiscal_paras AS DOUBLE), 6) AS pos_share, round(-D_t / CAST(n_fiscal_paras AS DOUBLE), 6) AS neg_share FROM os WHERE n_fiscal_paras > 0")
def vote_shares(spark, sf):
    share = lambda c: F.col(c) / F.col("n_fiscal_paras")
    return _r(_order_months(spark, sf).filter("n_fiscal_paras > 0").select("year_month", "president", share("H_t").alias("pos_share"), (-share("D_t")).alias("neg_share")), "pos_share", "neg_share")


@query(f"WITH {PANEL}, q AS (SELECT round(signal_main, 9) AS a, round(signal_dictionary, 9) AS b FROM pan WHERE NOT is_zero_fill), k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM q WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 4) AS pearson, round(corr(ra, rb), 4) AS spearman FROM k")
def panel_correlations(spark, sf):
    rows = _panel(spark, sf).filter("NOT is_zero_fill").select(*[F.round(c, 9).alias(c) for c in ("signal_main", "signal_dictionary")])
    return panel.correlations(rows, "signal_main", "signal_dictionary").withColumns({c: F.round(c, 4) for c in ("pearson", "spearman")})


@query(f"WITH {PAIRS} SELECT human * model = -1 AS disagrees, count(*) AS n, round(avg(CAST(human = model AS DOUBLE)), 6) AS accuracy FROM pr GROUP BY 1")
def accuracy_by_disagreement(spark, sf):
    p = _pairs(spark, sf).groupBy((F.col("human") * F.col("model") == -1).alias("disagrees"))
    return _r(p.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("human") == F.col("model")).cast("double")).alias("accuracy")), "accuracy")


@query(f"WITH {PAIRS} SELECT human, " + ", ".join(f"count(*) FILTER (president = '{g}') AS {g}" for g in REGIMES.kept) + " FROM pr GROUP BY human")
def sampling_pool(spark, sf):
    return _pairs(spark, sf).groupBy("human").agg(*[F.count_if(F.col("president") == g).alias(g) for g in REGIMES.kept])


@query(None)
def label_sheet(spark, sf):
    """The sheet of the sample; its text is looked up for the sampled ids only."""
    texts = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("speech_id"), "text")
    return agreement.label_sheet(texts.join(stratified_sample(spark, sf), "speech_id"), "speech_id", "text")


# topics
def _token_paras(spark, sf):
    return _paras(spark, sf).select("speech_id", "para_idx", "president", "is_fiscal", tokens(F.col("text_norm"), 3).alias("tokens"))


def _bags(spark, sf):
    """The paragraphs' tokens, written once, with their bags of words; the vocabulary."""
    paras = landed(_token_paras(spark, sf))
    bag = topics.vectorizer(topics.vocabulary(paras))
    return bag.transform(paras), bag.vocabulary


def _topic_model(spark, sf, k=8):
    bags, words = _bags(spark, sf)
    bags = landed(bags.drop("tokens"))
    return topics.train(bags, k), bags, words


@query(f"WITH {PARA}, t AS (SELECT unnest(list_distinct(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 3))) AS word FROM para) SELECT word, count(*) AS df FROM t GROUP BY word HAVING count(*) >= 5 AND count(*) <= 0.55 * (SELECT count(*) FROM para)")
def vocabulary(spark, sf):
    return topics.vocabulary(_token_paras(spark, sf))


@query(None)
def topic_words(spark, sf):
    model, _, words = _topic_model(spark, sf)
    return topics.top_words(model, words)


@query(None)
def topic_overlap(spark, sf):
    model, bags, _ = _topic_model(spark, sf)
    return topics.overlap(topics.with_topics(model, bags, {"fiscal_topic_prob": [0, 1]}))


@query(None)
def topic_grid(spark, sf):
    bags, words = _bags(spark, sf)
    return topics.grid(bags, words, list(range(8, 31)))
