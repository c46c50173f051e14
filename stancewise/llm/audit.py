"""What five quality filters do to each other in every order, from a relational pipeline over words."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, handed_back, settle

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Labelled ids (17 bytes each) that are broadcast; more meet the rows by shuffle.
LABELS = 500_000


def word_totals(rows: DataFrame) -> DataFrame:
    """row, words, distinct_words of every text that has words. rows: row (unique), text.

    Rows are dealt by ``row``, once; that one shuffle of the texts also serves the grouping by (row, word) and the one by row.
    """
    plain = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    words = rows.select("row", plain.alias("text")).repartition("row").select("row", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return words.groupBy("row", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("row").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, part, mask (bit i: it fails FILTERS[i]), good, toxic.

    A: under 200 words. B: under half of the words are distinct. C: over 2 % of the characters are A to Z. D: one of ``#$%&*|``.
    E: the text of a smaller doc_id is identical. Null text is empty, a null source the part ''; a null id is no smaller
    id and has none, and no labels. Of repeated rows each counts, and they do not fail E by each other. An id that is labelled
    twice is good or toxic if any label says so.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    shouting = 100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > 2 * F.length("text")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    base = settle(base.select("row", "doc_id", "part", "text", shouting.alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"), digest.alias("digest")))
    rows = base.drop("text")
    groups = settle(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    copies = handed_back(rows, groups, "digest", "n").drop("digest", "n")
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marks = settle(marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("deal"), "good", "toxic"))
    deal = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(0)  # rows without an id spread over the tasks
    flagged = copies.withColumn("deal", deal).join(broadcast_if(marks, marks.count(), LABELS), ["doc_id", "deal"], "left")
    joined = flagged.join(word_totals(base.select("row", "text")), "row", "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < 200, 100 * distinct < 50 * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return joined.select("doc_id", "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _passing(of: Column | None) -> Column:
    """SUBSETS conditional counts as an array: element S + 1 counts the documents (``of``, if given) that fail no filter of the set S."""
    kept = [F.coalesce(F.sum(F.when((F.col("mask").bitwiseAND(s) == 0) & (F.lit(True) if of is None else of), F.col("n"))), F.lit(0)) for s in range(SUBSETS)]
    return F.array(*kept)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Documents are counted by part, mask and labels before anything is shuffled, so a part with a third of all rows is
    a few partial counts. From the 32 counts of a part, one per set of filters, follow all steps of all orders: what is kept
    after a step is the count of the filters so far. An empty table gives no rows; see ``failures`` for nulls and repeated rows.
    """
    cells = failures(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.groupBy("part").agg(_passing(None).alias("every"), _passing(F.col("good")).alias("good"), _passing(F.col("toxic")).alias("bad"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    place = F.instr(F.lit(FILTERS), letter)
    before = sum((F.when(F.instr(F.col("filter_order"), x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("place", place).withColumn("before", before).withColumn("bit", F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("place")))

    def at(counts_of: str, subset: Column | int) -> Column:
        return F.element_at(counts_of, subset + 1 if isinstance(subset, Column) else F.lit(subset + 1))

    def lost(counts_of: str) -> Column:
        return at(counts_of, F.col("before")) - at(counts_of, F.col("before") + F.col("bit"))

    factorial = [1, 1, 2, 6, 24]
    shares = []  # of the 120 orders, |S|! (4 - |S|)! have just the set S before a filter
    for i in range(len(FILTERS)):
        sets = [s for s in range(SUBSETS) if not s >> i & 1]
        shares.append(sum(((at("every", s) - at("every", s | 1 << i)) * factorial[s.bit_count()] * factorial[4 - s.bit_count()] for s in sets), F.lit(0)))
    fails = at("every", 0) - at("every", F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", at("every", F.col("before") + F.col("bit")).alias("kept"), lost("every").alias("removed"), (fails - lost("every")).alias("redundant"),
        (at("every", SUBSETS - 1 - F.col("bit")) - at("every", SUBSETS - 1)).alias("unique_fails"), lost("good").alias("good_lost"), lost("bad").alias("toxic_lost"),
        F.element_at(F.array(*shares), F.col("place")).cast("long").alias("shapley"),
    )
