"""Speeches to paragraphs to term matches to votes. Nothing here shuffles but the numbering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import Lexicon
from ..functions.patterns import cue_pattern, keyword_pattern, term_pattern
from ..functions.terms import TermIndex
from ..functions.text import normalise, tokens
from .ids import dense

META = ("speech_id", "date", "president", "president_id", "year_month")


def paragraphs(speeches: DataFrame, lexicon: Lexicon, least: int = 20, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """A row per line of at least ``least`` tokens: para_idx (its line number from 0), text_para, text_norm, n_tokens, is_fiscal.

    Lines are normalised inside the generator, so that no later filter or projection repeats it.
    """
    line = lambda x, i: F.struct(i.alias("para_idx"), x.alias("text_para"), normalise(x).alias("text_norm"))
    sized = lambda x: F.struct(x["para_idx"].alias("para_idx"), x["text_para"].alias("text_para"), x["text_norm"].alias("text_norm"), F.size(tokens(x["text_norm"], 3, stopwords)).alias("n_tokens"))
    lines = F.transform(F.transform(F.split("text_raw", "\n"), line), sized)
    kept = speeches.select(*[c for c in (*META, "source", "lang") if c in speeches.columns], F.inline(lines)).filter(F.col("n_tokens") >= least)
    return kept.withColumn("is_fiscal", F.col("text_norm").rlike(keyword_pattern(lexicon.keywords)))


_indexes: dict[Lexicon, TermIndex] = {}


def _index(lexicon: Lexicon) -> TermIndex:
    """One per Python worker."""
    if lexicon not in _indexes:
        _indexes.clear()
        _indexes[lexicon] = TermIndex(lexicon)
    return _indexes[lexicon]


def with_matches(paras: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds matches: array<struct<direction, term, negated>>, one per non-overlapping match of each term, by place.

    Terms are found by an index over words (``TermIndex``) in Arrow batches of the normalised text alone, which costs the same for a
    hundred and for thousands of terms; one regular expression per term does not. A null text has none.
    """

    @F.arrow_udf("array<struct<direction: string, term: string, negated: boolean>>")
    def found(texts: pa.Array) -> pa.Array:
        index = _index(lexicon)
        rows = [index.matches(t) if t else [] for t in texts.to_pylist()]
        flat = [m for row in rows for m in row]
        columns = [pa.array([m[i] for m in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
        places = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays(columns, ["direction", "term", "negated"]))

    return paras.withColumn("matches", found("text_norm"))


def one_per_match(matched: DataFrame) -> DataFrame:
    """A row per match: direction, term, negated beside the columns of its paragraph.

    The outer form keeps Spark from filtering by the size of the array first, for which it would match every text twice.
    """
    rows = matched.select(*[c for c in matched.columns if c != "matches"], F.explode_outer("matches").alias("m")).filter("m IS NOT NULL")
    return rows.select(*[c for c in rows.columns if c != "m"], "m.direction", "m.term", "m.negated")


def matches_by_helper(paras: DataFrame, lexicon: Lexicon) -> DataFrame:
    """speech_id, para_idx, direction, term, negated: the matches of with_matches from an Arrow helper, to check it against."""
    terms = [(d, t, re.compile(term_pattern(t), re.A)) for d, ts in (("pos", lexicon.positive), ("neg", lexicon.negative)) for t in ts]
    strong, gated, weak = (re.compile(cue_pattern(c), re.A) for c in (lexicon.strong, lexicon.gated, lexicon.weak))

    def negated(before: str, direction: str) -> bool:
        words = before.split()
        far, near = " ".join(words[-lexicon.strong_window :]), " ".join(words[-lexicon.weak_window :])
        return bool(strong.search(far) or (direction == "neg" and gated.search(far)) or weak.search(near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                (sid, k, d, t, negated(text[: m.start()], d))
                for sid, k, text in zip(*(c.to_pylist() for c in b.columns), strict=True)
                for d, t, pattern in terms
                for m in pattern.finditer(text)
            ]
            names = ["speech_id", "para_idx", "direction", "term", "negated"]
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names)

    return paras.select("speech_id", "para_idx", "text_norm").mapInArrow(run, "speech_id long, para_idx int, direction string, term string, negated boolean")


def with_votes(matched: DataFrame) -> DataFrame:
    """Adds pos_hits, neg_hits, pos_negated, neg_negated, has_pos, has_neg and the distinct accepted and negated terms."""
    one = lambda d, n: F.filter("matches", lambda m: (m["direction"] == d) & (m["negated"] == F.lit(n)))
    out = matched
    for d in ("pos", "neg"):
        out = out.withColumns({f"{d}_hits": F.size(one(d, False)), f"{d}_negated": F.size(one(d, True)), f"{d}_terms": F.array_distinct(F.transform(one(d, False), lambda m: m["term"])), f"{d}_terms_negated": F.array_distinct(F.transform(one(d, True), lambda m: m["term"]))})
    return out.withColumns({"has_pos": (F.col("pos_hits") > 0).cast("int"), "has_neg": (F.col("neg_hits") > 0).cast("int")})


def numbered(paras: DataFrame) -> DataFrame:
    """Adds para_id, dense from 0 in (speech, line) order. Only the keys are sorted and written; ids may be as sparse as they like."""
    return dense(paras, ("speech_id", "para_idx"), "para_id")
