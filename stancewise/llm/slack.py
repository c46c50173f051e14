"""Packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import batches_of, broadcast_if, lean, settle

#: Tokens of a sequence.
CAPACITY = 2048
#: Runs of a plan (some 60 bytes each) and cut pieces (some 80 bytes each) that are broadcast; more meet by shuffle.
RUNS, CUTS = 1_000_000, 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids (little-endian unsigned 32-bit): whole documents (their ids and end_id), and of those longer
    than capacity pieces of capacity tokens and a last, shorter one. Null text is empty and gives a piece of one id."""
    path = path or default_path()
    batches_of(docs.sparkSession, 1000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {"doc_id": pa.int64(), "doc_tokens": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist(), path), strict=True):
                raw = np.append(ids, [end_id]).astype("<u4").tobytes()
                for lo in range(0, len(raw), 4 * capacity):
                    part = raw[lo : lo + 4 * capacity]
                    out.append((doc, len(raw) // 4, lo // 4, len(part) // 4, part))
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True) if out else [[]] * 5, kinds.values(), strict=True)], list(kinds))

    return rows.mapInArrow(lean(run), "doc_id long, doc_tokens long, start long, length long, ids binary")


def closest_fill(stock: dict[int, int], room: int) -> dict[int, int]:
    """length -> count: the multiset of at most stock's counts whose sum comes closest to room from below.

    Bit s of ``reach`` says that some multiset sums up to s. Lengths come longest first, each in portions of 1, 2, 4, ... copies, so
    that a portion is a shift and an OR; the state before each portion is kept to walk the counts back.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in stock if n <= room), reverse=True):
        copies, portion = min(stock[length], room // length), 1
        while copies:
            k = min(portion, copies)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & mask
            copies, portion = copies - k, 2 * portion
        if reach >> room:
            break
    total, fill = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            fill[length] = fill.get(length, 0) + k
            total -= length * k
    return fill


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, begin, part, first sequence, offset) that place every token of every piece: of the
    pieces of this length and these ranks, the ``part`` tokens from ``begin`` lie in sequences of their own at this offset.

    Window by window: the longest length left begins it, and the multiset of lengths left that comes closest to its capacity fills
    it; the same window is repeated while its lengths last. A window with slack left (then every length left is longer than the slack) is
    filled by the front of a longest piece left, whose rest goes back into stock. What remains in the end is cut into sequences
    of powers of two, which need no padding. So no sequence has any. The work is bounded by the capacity, whatever the corpus.
    """
    stock = {n: deque([(n, 0, c, 0)]) for n, c in histogram.items() if c}  # by length left: (length, first rank, how many, begin)
    left = {n: c for n, c in histogram.items() if c}
    runs: list[tuple[int, int, int, int, int, int, int]] = []
    sequence = 0

    def take(n: int, times: int) -> list[tuple[int, int, int, int]]:
        got, queue = [], stock[n]
        left[n] -= times
        while times:
            length, rank, have, begin = queue.popleft()
            k = min(have, times)
            got.append((length, rank, k, begin))
            if have > k:
                queue.appendleft((length, rank + k, have - k, begin))
            times -= k
        if not left[n]:
            del left[n], stock[n]
        return got

    def place(n: int, times: int, offset: int, part: int) -> None:
        """Puts the first ``part`` tokens of so many pieces at offset in the next sequences; what is left of them goes back."""
        first = sequence
        for length, rank, k, begin in take(n, times):
            runs.append((length, rank, rank + k, begin, part, first, offset))
            first += k
            if n > part:
                stock.setdefault(n - part, deque()).append((length, rank, k, begin + part))
                left[n - part] = left.get(n - part, 0) + k

    while sum(n * c for n, c in left.items()) >= capacity:
        seed = max(left)
        fill = closest_fill({n: c - (n == seed) for n, c in left.items() if c > (n == seed)}, capacity - seed)
        fill[seed] = fill.get(seed, 0) + 1
        slack = capacity - sum(n * k for n, k in fill.items())
        donor = max((n for n, c in left.items() if c > fill.get(n, 0)), default=None) if slack else None
        times = min(left[n] // (k + (n == donor)) for n, k in fill.items())
        if donor is not None and donor not in fill:
            times = min(times, left[donor])
        offset = 0
        for n in sorted(fill, reverse=True):
            for _ in range(fill[n]):
                place(n, times, offset, n)
                offset += n
        if donor is not None:
            place(donor, times, offset, slack)
        sequence += times
    rest = sum(n * c for n, c in left.items())
    while rest:
        size, offset = 1 << (rest.bit_length() - 1), 0
        while offset < size:
            n = max(left)
            part = min(n, size - offset)
            place(n, 1, offset, part)
            offset += part
        sequence, rest = sequence + 1, rest - size
    return runs


def pack_with_least_slack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if keep_ids) of every piece.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, and the plan is bounded like it. Pieces of a
    length are numbered in buckets, so one very common length spreads, and find their places in the plan by length and rank. Token
    ids are written once; only pieces that the plan cuts further read them again. Null text is empty (a piece of the end id alone);
    repeated rows are packed each, ties among equal pieces in any order; texts are taken whole, however long; extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = pieces_of(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    held = settle(cut.withColumn("key", F.monotonically_increasing_id()))
    pieces = held.drop("ids")
    spread = math.isqrt(pieces.count()) + 1  # as many buckets as rows in a bucket, at any size
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(spread)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = settle(sizes.withColumn("base", F.coalesce(before, F.lit(0))))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity)
    table = spark.createDataFrame([tuple(map(int, r)) for r in runs], "length long, lo long, hi long, begin long, part long, first long, offset long")
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("key")) - 1
    numbered = keyed.withColumn("k", rank).join(sizes.drop("n"), ["length", "bucket"]).withColumn("k", F.col("k") + F.col("base")).drop("bucket", "base")
    placed = numbered.join(broadcast_if(table, len(runs), RUNS), "length").filter("k >= lo AND k < hi")
    placed = placed.select("key", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "begin", "part", (F.col("first") + F.col("k") - F.col("lo")).alias("sequence_id"), "offset")
    placed = settle(placed)
    whole, again = placed.filter("part = length"), placed.filter("part < length")
    names = [F.col("doc_id"), (F.col("start") + F.col("begin")).alias("start"), F.col("part").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = held.select("key", "ids")
    again = ids.join(broadcast_if(again.drop("ids_crc32"), again.count(), CUTS), "key")
    again = again.withColumn("ids", F.expr("substring(ids, int(4 * begin + 1), int(4 * part))")).withColumn("ids_crc32", F.crc32("ids"))
    if keep_ids:
        whole = whole.join(ids, "key")
    return whole.select(*names, *["ids"] * keep_ids).unionByName(again.select(*names, *["ids"] * keep_ids))
