"""Mixing sources to target weights (native: DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, null_safe_join, release, settle

#: Tokens in a block, slots in an output shard, cells of the unit interval by which slots find their source.
BLOCK, SHARD, CELLS = 128, 65_536, 4096
#: Least slots of a run, within which one task numbers draws.
RUN = 1024


def _targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds weight and target to one row per source: weights repeat in code-point order, null last, and share
    ``share`` times all sizes; a target stops at ``most`` times its source's size and its excess goes to the others.

    Water-filling in closed form: in ascending order of cap / weight, a source is capped while
    cap_i / w_i <= (budget - caps before) / (weights from i on). The windows run over one row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    t = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("budget", share * F.sum("source_size").over(W.partitionBy())).withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    #: the level only falls below a ratio once, and then stays what the first uncapped source sees
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(W.partitionBy())
    return t.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * first["level"]), F.col("cap"))).select("source", "source_size", "weight", "target")


def _permuted(j: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at j. Three rounds of two exact bijections of Z_n: an affine step whose
    stride is a prime above any n, and an exclusive-or with a keyed mask inside each full aligned group of 1024 (or
    of the largest power of two below n)."""
    stride, x = 2_305_843_009_213_693_951, j  # 2^61 - 1
    bits = F.least(F.lit(10), F.floor(F.log2(n.cast("double")))).cast("int")
    group = F.pow(F.lit(2.0), bits).cast("long")
    big = lambda c: c.cast("decimal(19,0)")
    for r in range(3):
        shift = F.pmod(F.xxhash64(key, F.lit(r)), n)
        x = F.pmod(big(x) * big(F.pmod(F.lit(stride), n)) + big(shift), big(n)).cast("long")
        cell = F.floor(x / group).cast("long")
        mask = F.pmod(F.xxhash64(key, F.lit(10 + r), cell), group)
        x = F.when(x < n - n % group, cell * group + (x % group).bitwiseXOR(mask)).otherwise(x)
    return x


def _laid(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str, text: bool, mark: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with the index of their first word in their source, and the slots that read a block (see mixed_blocks)."""
    sizes = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *([F.col(text_col).alias("text")] if text else []), *([F.xxhash64(text_col).alias("mark")] if mark else [])))
    buckets = math.isqrt(sizes.count()) + 1  # as many buckets as rows in a bucket, at any size
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(buckets))
    sizes = sizes.withColumn("bucket", spread)

    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = settle(per_bucket.withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0))))
    totals = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = _targets(totals, weights, share, most).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    #: the last block is short, so a quota counts blocks of their mean length
    targets = targets.withColumn("quota", F.when(F.col("blocks") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.floor(most * F.col("blocks"))).cast("long")).otherwise(F.lit(0).cast("long")))
    targets = settle(targets.withColumn("upto", F.sum("target").over(W.orderBy(F.col("source").asc_nulls_last())) / F.nullif(F.sum("target").over(W.partitionBy()), F.lit(0.0))))
    slots = targets.agg(F.sum("quota")).first()[0] or 0

    held = [*["text"] * text, *["mark"] * mark]
    inside = W.partitionBy("source", "bucket").orderBy("doc_id", "size", *([F.xxhash64("text")] if text else [])).rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = null_safe_join(placed, per_bucket.select("source", "bucket", "base"), ["source", "bucket"]).select("doc_id", "source", "size", *held, (F.col("base") + F.col("inner")).alias("first"))
    placed = null_safe_join(placed, targets.select("source", "source_size", "target"), ["source"]).select("doc_id", "source", "size", *held, "source_size", "target", "first")
    placed = settle(placed)
    release(docs.sparkSession)
    return placed, _slots(targets, int(slots), seed)


def _slots(targets: DataFrame, slots: int, seed: int) -> DataFrame:
    """shard, slot, source, block: a row per slot, in the shard that drew it."""
    drawn = _drawn(targets, slots, seed).withColumn("run", F.expr(f"slot div {max(RUN, math.isqrt(slots))}"))
    counts = settle(drawn.groupBy("run", "source").agg(F.count(F.lit(1)).alias("n")))
    running = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    nth = F.row_number().over(W.partitionBy("run", "source").orderBy("slot")) - 1
    numbered = null_safe_join(drawn.withColumn("nth", nth), starts, ["run", "source"]).select("slot", "source", (F.col("start") + F.col("nth")).alias("j"))
    quotas = targets.select("source", "quota", "blocks")
    held = null_safe_join(numbered, quotas, ["source"]).filter("j < quota").select("slot", "source", "blocks", "j")
    closing = null_safe_join(quotas, counts.groupBy("source").agg(F.sum("n").alias("start")), ["source"], "left").withColumn("start", F.coalesce("start", F.lit(0))).filter("quota > start")
    ahead = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    closing = closing.withColumn("at", F.lit(-(-slots // SHARD) * SHARD) + F.coalesce(F.sum(F.col("quota") - F.col("start")).over(ahead), F.lit(0)))
    #: runs of at most SHARD slots, so that no row unfolds without bound
    closing = closing.withColumn("from", F.explode(F.sequence(F.col("start"), F.col("quota") - 1, F.lit(SHARD).cast("long"))))
    closing = closing.withColumn("j", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SHARD, F.col("quota")) - 1)))
    slot = held.unionByName(closing.select((F.col("at") + F.col("j") - F.col("start")).alias("slot"), "source", "blocks", "j"))
    key = F.xxhash64(F.coalesce("source", F.lit("\0null")), F.lit(seed), F.floor(F.col("j") / F.col("blocks")))
    return slot.select(F.expr(f"slot div {SHARD}").alias("shard"), "slot", "source", _permuted(F.col("j") % F.col("blocks"), F.col("blocks"), key).alias("block"))


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: shard, slot, source, block, doc_id, start, words, text; a row per piece of a document in the block of a slot.

    A piece is ``words`` words of its document from word ``start`` on, with one space between; the pieces of a slot, joined by the
    index of its block, are a block of BLOCK words (fewer in the last one of a source). See ``mix`` for how slots are dealt.
    """
    placed, slots = _laid(docs, weights, share, most, seed, id_col, text_col, source_col, True)
    at = lambda b: F.greatest("first", b * BLOCK)
    size = lambda b: F.least(F.col("first") + F.col("size"), (b + 1) * BLOCK) - at(b)
    piece = lambda w, b: F.struct(b.alias("block"), (at(b) - F.col("first")).alias("start"), size(b).alias("words"), F.array_join(F.slice(w, (at(b) - F.col("first") + 1).cast("int"), size(b).cast("int")), " ").alias("text"))
    blocks = F.expr(f"sequence(first div {BLOCK}, (first + size - 1) div {BLOCK})")
    #: the words are bound by the outer lambda, so that a text is split once and not for each piece
    pieces = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda w: F.transform(blocks, lambda b: piece(w, b)))
    parts = placed.filter("size > 0").select("doc_id", "source", F.explode(F.element_at(pieces, 1)).alias("p")).select("doc_id", "source", "p.*")
    return null_safe_join(slots, parts, ["source", "block"]).select("shard", "slot", "source", "block", "doc_id", "start", "words", "text")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, taken, slots (how many read it), first_slot (null: none).

    Each source's words, laid end to end, are cut into blocks of BLOCK words. The output is shards of SHARD slots of one
    block; each slot draws its source (so a shard's counts are multinomial), the running count of a source over the shards
    is its slot index, and slot j of a source reads block perm(j mod n) of its n blocks, epoch j div n. Blocks beyond
    a source's quota (its target in blocks) are left out and what is missing fills a closing shard, so a source's taken
    words meet its target within a block and no block is read more than ``most`` times. Blocks are joined by index. ``mixed_blocks``
    gives the mix itself; here the words of the dealt slots are summed per document.

    A hot source is numbered in buckets and its blocks spread by (source, block). All draws are
    hashes of the seed, so reruns agree. Null or empty text has size 0 and is never taken; null sources are one
    source, last in order; repeated rows count each; extra columns are ignored; an empty table gives an empty result.
    """
    return _taken(*_laid(docs, weights, share, most, seed, id_col, text_col, source_col, False)).drop("first")


def _taken(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """placed with taken, the words that the slots read of each document, how many slots that are, and the first of them."""
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + size - 1) div {BLOCK})")))
    parts = parts.withColumn("words", F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("first", F.col("block") * BLOCK))
    read = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("long")
    taken = null_safe_join(parts, slots, ["source", "block"], "left").groupBy(*placed.columns)
    taken = taken.agg(read.alias("taken"), F.count("slot").alias("slots"), F.min("slot").alias("first_slot"))
    none = {"taken": F.lit(0).cast("long"), "slots": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}
    return taken.unionByName(placed.filter("size = 0").withColumns(none))


def _drawn(targets: DataFrame, slots: int, seed: int) -> DataFrame:
    """slot, source: the source that each slot drew."""
    spark = targets.sparkSession
    u = (F.pmod(F.xxhash64("slot", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    slot = spark.range(slots).select(F.col("id").alias("slot")).select("slot", u).withColumn("cell", F.floor(F.col("u") * CELLS))
    lower = F.coalesce(F.lag("upto").over(W.orderBy(F.col("source").asc_nulls_last())), F.lit(0.0))
    last = F.lead("upto").over(W.orderBy(F.col("source").asc_nulls_last())).isNull()
    pieces = targets.filter("upto is not null").withColumn("lower", lower).withColumn("upper", F.when(last, 2.0).otherwise(F.col("upto")))
    pieces = pieces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * CELLS), F.least(F.floor(F.col("upper") * CELLS), F.lit(CELLS - 1)))))
    return slot.join(pieces.select("source", "lower", "upper", "cell"), "cell").filter("u >= lower AND u < upper").select("slot", "source")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with each document repeated as often as the mix takes it: taken / size copies, the fraction settled by a
    hash of the row, so that the expected words of each source meet its target. Columns of docs.

    A row is known by its id, source and text, so rows with null or repeated ids come as often as they are taken themselves; rows
    that repeat all three share their copies evenly. Null and empty texts are never taken; an empty table stays empty.
    """
    counts = _taken(*_laid(docs, weights, share, most, seed, "doc_id", "text", "source", False, True))
    draw = F.pmod(F.xxhash64("doc_id", "mark", "first", F.lit(seed), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(F.lit(0)).cast("int")
    copy, rows, nth = (fresh(docs, c) for c in ("copy", "rows", "nth"))
    mark = fresh(docs, "mark")
    counts = counts.groupBy("doc_id", "source", F.col("mark").alias(mark)).agg(F.sum(copies).cast("int").alias(copy), F.count(F.lit(1)).alias(rows)).filter(F.col(copy) > 0)
    counts = settle(counts)  # keys only; read by both branches below
    found = null_safe_join(docs.withColumn(mark, F.xxhash64("text")), counts, ["doc_id", "source", mark])
    alone = found.filter(F.col(rows) == 1)
    #: rows that repeat: the first ones take what does not divide; rows equal in all columns are one like the other
    told = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    several = found.filter(F.col(rows) > 1).withColumn(nth, F.row_number().over(W.partitionBy("doc_id", "source", mark).orderBy(F.xxhash64(*told))))
    several = several.withColumn(copy, (F.floor(F.col(copy) / F.col(rows)) + (F.col(nth) <= F.col(copy) % F.col(rows)).cast("int")).cast("int")).filter(F.col(copy) > 0).drop(nth)
    both = alone.unionByName(several)
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1), copy))).drop(copy, rows, nth, mark)
