"""Exact duplicates by progressive refinement (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if, handed_back, settle, without_copies

#: Up to so many suspect groups (24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Three passes, each over what the last left open: groups by length of the normalised text; within lengths that
    occur more than once, by a hash of the first ``prefix_chars`` characters; within prefixes that do, by SHA-256 of the
    whole text. Only rows of the third pass are ever grouped by content. Counts are combined before each shuffle, so
    a group with a third of all rows is a few partial counts; the result of such a group is broadcast to its rows and only small
    groups meet theirs by shuffle.

    Null text counts as empty; empty texts equal each other. Among equal texts the smallest id stays; a null id loses
    to any other; of rows that repeat the same id and text exactly one is kept. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).select(
        "doc_id", "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix")
    )
    light = rows.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n"))
    light = settle(light)
    lengths = light.groupBy("len").agg(F.sum("n").alias("of_len")).filter("of_len > 1").select("len")
    suspects = settle(light.filter("n > 1").join(lengths, "len", "left_semi").select("len", "prefix"))
    near = broadcast_if(suspects, suspects.count(), BROADCAST_GROUPS)
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")

    full = settle(rows.join(near, ["len", "prefix"], "left_semi").select(F.monotonically_increasing_id().alias("row"), "doc_id", digest))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = settle(full.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size")))
    members = handed_back(full, groups, "text_sha256", "group_size").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )
    alone = rows.join(near, ["len", "prefix"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    return members.unionByName(alone)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    A row is known by its id and normalised text: with null or repeated ids each text still keeps one row. Of rows that
    repeat both (their other columns may differ) one stays. Null text counts as empty; an empty table stays empty.
    """
    found = exact_duplicates(docs).filter("group_size > 1").groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = settle(found.filter("n > 1 OR NOT kept"))
    return without_copies(docs, found, F.sha2(normalised(F.col("text")).cast("binary"), 256), BROADCAST_GROUPS)
