"""Token-id files: Re-Pair grammars per shard, with random access by document."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import batches_of, lean, shared_folder

#: Ids of a grammar block, characters of a shard (at least, while cores would idle, and at most), the least count of a pair that becomes a rule.
BLOCK_IDS, LEAST_CHARS, SHARD_CHARS, LEAST = 1_000_000, 4_000_000, 32_000_000, 4


def _chosen(at: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Which of the overlapping pairs that begin at ``at`` are taken: those worth more than their neighbours, then what is left."""
    state = np.zeros(len(at), np.int8)  # 1 taken, -1 overlaps a taken one
    near = np.concatenate([[False], np.diff(at) == 1, [False]])
    for _ in range(3):
        value = np.where(state == 0, worth, -1)
        before, after = np.where(near[:-1], np.append(-1, value[:-1]), -1), np.where(near[1:], np.append(value[1:], -1), -1)
        new = (value > before) & (value > after)
        state[new] = 1
        i = np.flatnonzero(new)
        state[i[near[i]] - 1] = -1
        state[i[near[i + 1]] + 1] = -1
        if state.all():
            break
    return state == 1


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> dict[str, np.ndarray]:
    """Re-Pair grammar of ids: terminals (block symbol -> id), rules (pairs of symbols), rounds (rules of each round), sizes (ids
    each rule stands for), symbols (the sequence left) and docs (where each document begins in it).

    The most frequent pairs are replaced until none occurs ``least`` times without overlap. A round takes all pairs that occur
    ``limit`` times, the more frequent of two that overlap; the limit halves from the greatest count to ``least``. Of a run
    of one symbol every other position begins a pair. A hash count spares most pairs the sort. Rules of a round refer to symbols
    of earlier ones. Pairs never cross the end of a document, whose last position ``ends`` marks.
    """
    terminals, seq = np.unique(ids, return_inverse=True)
    seq = seq.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends] = True
    sizes, rules, n, limit, least = [np.ones(len(terminals), np.int64)], [], len(terminals), None, max(least, 2)
    while len(seq) > 1:
        free = ~last[:-1]
        same = np.flatnonzero((seq[:-1] == seq[1:]) & free)
        if len(same):
            run = np.flatnonzero(np.diff(same, prepend=-2) != 1)
            nth = np.arange(len(same)) - np.repeat(run, np.diff(np.append(run, len(same))))
            free[same[nth % 2 == 1]] = False
        bits = max(8, min(20, len(seq).bit_length()))
        cell = ((seq[:-1] * np.uint32(2654435761)) ^ (seq[1:] * np.uint32(2246822519))) >> np.uint32(32 - bits)
        often = np.bincount(cell[free], minlength=1 << bits)
        limit = max(least, min(limit or len(seq), int(often.max()) // 2))
        at = np.flatnonzero(free & (often >= limit)[cell])
        pairs = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        found, which, count = np.unique(pairs, return_inverse=True, return_counts=True)
        some = count[which] >= limit
        at, which = at[some], which[some]
        rank = np.empty(len(found), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(found))
        taken = _chosen(at, rank[which])
        at, which = at[taken], which[taken]
        held = np.bincount(which, minlength=len(found))
        good = held >= least
        done, limit = limit == least and not good.any(), max(least, limit // 2)
        if done:
            break
        at, which = at[good[which]], which[good[which]]
        name = np.cumsum(good) - 1
        a, b = (found[good] >> np.uint64(32)).astype(np.int64), (found[good] & np.uint64((1 << 32) - 1)).astype(np.int64)
        seq[at] = n + name[which]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        known = np.concatenate(sizes)
        sizes = [known, known[a] + known[b]]
        rules.append(np.stack([a, b], 1))
        n += len(a)
    kind, made = "<u2" if n < 1 << 16 else "<u4", np.concatenate(sizes)[len(terminals) :]
    return {
        "terminals": terminals.astype("<u4"), "rules": (np.concatenate(rules) if rules else np.zeros((0, 2))).astype(kind), "rounds": np.array([len(r) for r in rules], "<u4"),
        "sizes": made.astype("<u4"), "symbols": seq.astype(kind), "docs": np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u4"),
    }


def all_sizes(terminals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids that each symbol stands for: one for a terminal, the stored size of a rule."""
    return np.concatenate([np.ones(len(terminals), np.int64), sizes.astype(np.int64)])


def expansions(terminals: np.ndarray, rules: np.ndarray, rounds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every symbol, end to end, and where each symbol's begin, round by round."""
    begin = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.uint32)
    flat[: len(terminals)] = terminals
    n, lo = len(terminals), 0
    for k in rounds.tolist():
        both = rules[lo : lo + k].ravel()
        ids = expand(both, sizes, flat, begin)
        flat[begin[n] : begin[n] + len(ids)] = ids
        n, lo = n + k, lo + k
    return flat, begin


def expand(symbols: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    n = sizes[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(begin[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_FIELDS = "shard int, block int, doc_ids array<long>, terminals binary, rules binary, rounds binary, sizes binary, symbols binary, wide boolean, docs binary, n_ids long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None) -> None:
    """Writes the ids of all texts, in ascending doc_id order, as Re-Pair blocks (one Parquet row each) under path.

    Documents are range-partitioned by doc_id (ties by text; null ids first), each shard is tokenised and compressed in blocks
    of about BLOCK_IDS ids, so memory is bounded by a block and the longest document. A null text is empty and holds the end
    id alone. Spark's committed Parquet write survives lost executors.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_path()
    batches_of(spark, 2000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not shards:
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 1
        shards = max(-(-chars // SHARD_CHARS), min(-(-chars // LEAST_CHARS), 2 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            g = compress(ids, np.cumsum([len(h) for h in held]) - 1)
            row = {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([names], pa.list_(pa.int64()))}
            row |= {k: [g[k].tobytes()] for k in ("terminals", "rules", "rounds", "sizes", "symbols")}
            return pa.RecordBatch.from_pydict(row | {"wide": [g["symbols"].itemsize == 4], "docs": [g["docs"].tobytes()], "n_ids": pa.array([len(ids)], pa.int64())})

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist(), tokenizer), strict=True):
                held.append(np.append(ids, [end_id]).astype(np.uint32))
                names.append(doc)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield close()
                    block, held, names, size = block + 1, [], [], 0
        if held:
            yield close()

    rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(lean(run), _FIELDS).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit) of every
    document, decoded block by block.

    The expansion sizes give each document's length without decoding its neighbours. Starts add up shard totals (one row per
    shard), block totals within a shard and lengths within a block.
    """
    batches_of(spark, 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    blocks = spark.read.schema(_FIELDS).parquet(path)
    totals = blocks.select("shard", "block", "n_ids")
    shards = totals.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = totals.withColumn("inner", inner).join(shards.select("shard", before.alias("before")), "shard").select("shard", "block", (F.col("before") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                kind = "<u4" if r["wide"] else "<u2"
                terminals, rules, symbols = np.frombuffer(r["terminals"], "<u4"), np.frombuffer(r["rules"], kind).reshape(-1, 2), np.frombuffer(r["symbols"], kind)
                sizes, docs = all_sizes(terminals, np.frombuffer(r["sizes"], "<u4")), np.frombuffer(r["docs"], "<u4")
                at = np.concatenate([[0], np.cumsum(sizes[symbols])])[docs]
                flat, begin = expansions(terminals, rules, np.frombuffer(r["rounds"], "<u4"), sizes)
                for lo in range(0, len(r["doc_ids"]), 200):
                    hi = min(lo + 200, len(r["doc_ids"]))
                    ids = expand(symbols[docs[lo] : docs[hi]], sizes, flat, begin).astype("<u4")
                    cuts = at[lo : hi + 1] - at[lo]
                    raws = [ids[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                    n = hi - lo
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"]] * n, pa.int32()), "block": pa.array([r["block"]] * n, pa.int32()), "doc_id": pa.array(r["doc_ids"][lo:hi], pa.int64()), "within": pa.array(at[lo:hi], pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in raws], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in raws], pa.int64()), "ids": pa.array(raws, pa.binary())})

    read = blocks.mapInArrow(lean(run), "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    return read.join(bases, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")


def file_sizes(spark, path: str) -> DataFrame:
    """ids, rules, symbols and bytes of all blocks under path: what the grammars take, before Parquet's own compression."""
    blocks = spark.read.schema(_FIELDS).parquet(path)
    held = sum((F.octet_length(c) for c in ("terminals", "rules", "rounds", "sizes", "symbols", "docs")), F.lit(0))
    return blocks.agg(F.sum("n_ids").alias("ids"), F.sum(F.octet_length("sizes") / 4).cast("long").alias("rules"), F.sum(F.octet_length("symbols") / F.when(F.col("wide"), 4).otherwise(2)).cast("long").alias("symbols"), F.sum(held).cast("long").alias("bytes"))


def store_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs into the shared folder and reads them back.

    Null text is empty and holds the end id alone; equal ids are ordered by a hash of the text, null ids come first; repeated rows
    repeat; an empty table gives an empty result; extra columns are ignored.
    """
    path = f"{shared_folder(docs.sparkSession)}/stancewise/{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)
