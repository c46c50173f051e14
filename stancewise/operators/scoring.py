"""Batch scoring by a pluggable model: prompts, replies, fallbacks, resume."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..sources.landing import landed
from .ids import dense

FALLBACKS = ("parse_fallback", "api_error", "retry_exhausted", "no_response")


class Busy(Exception):
    """What a scorer raises when the model asks to wait: after the last try the reason is retry_exhausted, after others api_error."""


def batched(paras: DataFrame, size: int = 10, numbered: bool = False) -> DataFrame:
    """batch_id, items (para_id, text): consecutive groups of ``size`` paragraphs in the order of para_id.

    The batch of a paragraph is its place div ``size``; where ids are dense from 0 already (``numbered``) they are the places, else
    places are found on the ids alone. No window, at any number of rows. The text is the column ``text``, or text_para as far as a prompt
    shows it.
    """
    rows = paras.select("para_id", "text" if "text" in paras.columns else truncated(F.col("text_para")).alias("text"))
    rows = rows.withColumn("place", F.col("para_id")) if numbered else dense(rows, ("para_id",), "place")
    return rows.groupBy(F.expr(f"place div {size}").alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("para_id", "text"))).alias("items"))


def prompt(items: Column) -> Column:
    line = lambda x, i: F.format_string("%d. [id=%d] %s", i + 1, x["para_id"], x["text"])
    return F.array_join(F.transform(items, line), "\n")


def replied(batches: DataFrame, scorer: Callable[[str], str]) -> DataFrame:
    """batch_id, items, reply, failure: scorer(prompt) once per batch; failure is null, api_error or (Busy) retry_exhausted."""
    asked = batches.select("batch_id", "items", prompt(F.col("items")).alias("prompt"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            replies, failures = [], []
            for text in b.column(2).to_pylist():
                reply, failure = None, None
                try:
                    reply = scorer(text)
                except Busy:
                    failure = "retry_exhausted"
                except Exception:  # noqa: BLE001  the scorer is the user's: any failure counts as a try
                    failure = "api_error"
                replies.append(reply)
                failures.append(failure)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(replies, pa.string()), pa.array(failures, pa.string())], ["batch_id", "items", "reply", "failure"])

    return asked.mapInArrow(run, f"batch_id long, items {batches.schema['items'].dataType.simpleString()}, reply string, failure string")


def with_answers(replies: DataFrame) -> DataFrame:
    """replies with answers (para_id, score, reason per answered id, the last of repeated ids), items (those that the reply lacks) and
    failure (why: as it was, or no_response to a blank reply, else parse_fallback)."""
    reply = F.coalesce(F.col("reply"), F.lit(""))
    found = F.coalesce(_items(reply), F.expr("cast(array() as array<struct<para_id:bigint,score:int,reason:string>>)"))
    own = lambda x, found: F.element_at(F.filter(found, lambda f: f["para_id"] == x["para_id"]), -1)
    each = F.flatten(F.transform(F.array(found), lambda f: F.transform("items", lambda x: F.struct(x.alias("item"), F.when(F.exists(f, lambda y: y["para_id"] == x["para_id"]), own(x, f)).alias("answer")))))
    why = F.coalesce("failure", F.when(F.trim(reply) == "", "no_response").otherwise("parse_fallback"))
    rows = replies.select("batch_id", each.alias("each"), why.alias("failure"))
    answers = F.transform(F.filter("each", lambda e: e["answer"].isNotNull()), lambda e: e["answer"])
    lacking = F.transform(F.filter("each", lambda e: e["answer"].isNull()), lambda e: e["item"])
    return rows.select("batch_id", answers.alias("answers"), lacking.alias("items"), "failure")


def answered(rows: DataFrame) -> DataFrame:
    """para_id, score, reason of the ids that replies answered."""
    return rows.select(F.inline("answers"))


def neutral(rows: DataFrame) -> DataFrame:
    """para_id, score 0 and the kind of failure of the ids that replies lacked."""
    return rows.select(F.explode("items").alias("x"), "failure").select("x.para_id", F.lit(0).alias("score"), F.col("failure").alias("reason"))


def scored(batches: DataFrame, scorer: Callable[[str], str], tries: int = 3, wait: float = 1.0, at_once: int | None = None) -> DataFrame:
    """para_id, score, reason of all ids of batches, asked in up to ``tries`` rounds.

    A round asks for what replies have lacked so far, batch by batch and nothing else; its replies are written, so no batch
    is asked twice in a round. Between rounds it waits ``wait`` seconds, twice as long each time. Ids without an answer in the end are neutral,
    with the kind of their last failure. At most ``at_once`` tasks ask at a time.
    """
    left, done = batches, []
    for turn in range(tries):
        asking = left.coalesce(at_once) if at_once else left
        rows = landed(with_answers(replied(asking, scorer)))
        done.append(answered(rows))
        left = rows.filter(F.size("items") > 0)
        if not left.limit(1).count():
            break
        if turn + 1 < tries:
            time.sleep(wait * 2**turn)
    found = neutral(left)
    for part in done:
        found = found.unionByName(part)
    return found


def _items(reply: Column) -> Column:
    """The objects of a reply: fences off; if that does not parse, its outermost brackets; a bare object is wrapped. Scores out of
    -1..1 become 0, reasons keep 120 characters; what is no object or lacks an id or a whole score goes."""
    bare = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    listed = F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1)))
    each = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array(listed))
    get = lambda v: F.struct(F.try_variant_get(v, "$.id", "long").alias("para_id"), F.try_variant_get(v, "$.score", "int").alias("score"), F.substring(F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")), 1, 120).alias("reason"))
    whole = F.filter(F.transform(each, get), lambda x: x["para_id"].isNotNull() & x["score"].isNotNull())
    return F.transform(whole, lambda x: F.struct(x["para_id"].alias("para_id"), F.when(x["score"].isin(-1, 0, 1), x["score"]).otherwise(0).alias("score"), x["reason"].alias("reason")))


def parsed(replies: DataFrame) -> DataFrame:
    """para_id, score, reason for every id of replies (batch_id, items, reply, failure); ids without an answer are neutral with a
    reason from FALLBACKS."""
    rows = with_answers(replies)
    return answered(rows).unionByName(neutral(rows))


def joined_scores(paras: DataFrame, scores: DataFrame) -> DataFrame:
    """paras with score and reason; without a score 0 and an empty reason."""
    known = scores.select("para_id", "score", "reason")
    return paras.join(known, "para_id", "left").na.fill({"score": 0, "reason": ""})


def without_examples(paras: DataFrame, examples: DataFrame, key: str = "para_id") -> DataFrame:
    """The rows that do not serve as examples in the prompt."""
    return paras.join(examples.select(key).distinct(), key, "left_anti")


def simple_sample(df: DataFrame, n: int, key: str, seed: str = "42") -> DataFrame:
    """n rows (all, if fewer), those of least md5(seed, key): the same ones in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def to_score(paras: DataFrame, done: DataFrame) -> DataFrame:
    return paras.join(done.select("para_id"), "para_id", "left_anti")


def fallback_rates(scores: DataFrame) -> DataFrame:
    bad = F.col("reason").isin(*FALLBACKS)
    return scores.groupBy(F.when(bad, F.col("reason")).otherwise("scored").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def cost(paras: DataFrame, batch: int = 10, system_tokens: int = 350, per_para_in: int = 120, per_para_out: int = 30, usd_in: float = 0.15, usd_out: float = 0.6) -> DataFrame:
    """calls (whole batches), tokens in and out, USD (prices per million tokens)."""
    n = paras.agg(F.count(F.lit(1)).alias("n")).withColumn("calls", F.expr(f"n div {batch}"))
    n = n.withColumns({"tokens_in": F.col("calls") * system_tokens + F.col("n") * per_para_in, "tokens_out": F.col("n") * per_para_out})
    return n.withColumn("usd", F.round(F.col("tokens_in") * usd_in / 1e6 + F.col("tokens_out") * usd_out / 1e6, 6))
