"""Exact top-k inner products by norm order, SVD rotation and Cauchy-Schwarz bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, broadcast_if, lean, settle

#: Vectors in a tile, queries in a block, coordinates of the partial sums.
TILE, QUERIES, HEADS = 2048, 256, (8, 24)
#: Bytes of queries that are broadcast together; a block holds fewer queries where vectors are so long that QUERIES of them exceed it.
BROADCAST_BYTES = 32 << 20
#: A wave of tiles holds so many times the tiles of the one before; bounds tighten between waves.
GROWTH = 4


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v (array<long> of floor(scale * x)), len2, row (a number of its own); one row per row.

    Rows with a null id, a null or empty vector, or a null, NaN or infinite component take no part. Vectors shorter than the
    longest are padded with zeros, so that two vectors multiply over the dimensions that both have.
    """
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
    return rows.withColumn("v", padded).withColumn("len2", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))


def _rows(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            x = _rows(b).astype(np.float64)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "g": total.ravel()})


def _rotation(rows: DataFrame) -> np.ndarray:
    """Right singular vectors of all rows, from their d x d moment matrix (the only thing that reaches the driver)."""
    g = rows.select("v").mapInArrow(lean(_gram), "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
    d = round(g.num_rows**0.5)
    m = np.zeros(d * d)
    m[g["i"].to_numpy()] = g["g"].to_numpy()
    return np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]


def _packer(size: int):
    """Packs the sorted rows of a partition into tiles of at most size vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, ids, vs = TaskContext.get().partitionId(), 0, [], []

        def tile(i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max()))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "longest": [longest], "ids": [i.astype("<i8").tobytes()], "vs": [v.astype("<i8").tobytes()]})

        for b in batches:
            if b.num_rows:
                ids.append(b.column(b.schema.get_field_index("vec_id")).to_numpy())
                vs.append(_rows(b))
            while sum(map(len, ids)) >= size:
                i, v = np.concatenate(ids), np.concatenate(vs)
                yield tile(i[:size], v[:size])
                ids, vs, k = [i[size:]], [v[size:]], k + 1
        if sum(map(len, ids)):
            yield tile(np.concatenate(ids), np.concatenate(vs))

    return pack


def _packed(rows: DataFrame, size: int, n: int, name: str) -> DataFrame:
    """name (0, 1, ... in descending order of length), longest, ids, vs: rows in packs of size vectors, nearly all full."""
    order = (F.desc("len2"), F.asc("vec_id"), F.asc("row"))
    parts = rows.repartitionByRange(max(1, -(-n // (4 * size))), *order).sortWithinPartitions(*order)
    packs = settle(parts.select("vec_id", "v").mapInArrow(lean(_packer(size)), "part int, k int, longest double, ids binary, vs binary"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    counts = packs.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = settle(counts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")))
    return packs.join(broadcast_if(base, base.count(), 100_000), "part").select((F.col("base") + F.col("k")).alias(name), "longest", "ids", "vs")


def _dealt(dim: int) -> tuple[int, int]:
    """Queries in a block, and blocks that are broadcast together, of vectors of dim components: BROADCAST_BYTES at most (but one query
    at least)."""
    queries = min(QUERIES, max(1, BROADCAST_BYTES // (8 * dim)))
    return queries, max(1, BROADCAST_BYTES // (8 * dim * queries))


def top_k_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with all other vectors.

    Queries are the rows whose id is divisible by ``every``; rows of one query id rank together, and no row of that id is a
    candidate. Vectors are range-partitioned by descending length (ties by id and row, so one very common vector still spreads)
    and packed into tiles, queries into blocks. Tiles come in waves of growing number, the longest first. In a wave a tile meets
    only those blocks for which |q||v| of its longest vector can still reach some query's bound, its k-th score so far; a
    task goes through its tiles in order and raises the bounds as it finds more, and after the wave the results of all tasks give
    the bounds of the next. When no bound can be reached the later, shorter tiles are not read. Inside a tile both sides are
    rotated by the right singular vectors of the table; partial products over the first HEADS coordinates plus the
    product of the residual lengths bound the rest, and only what survives gets its exact integer product.

    No vector is shuffled after packing: as many blocks as BROADCAST_BYTES hold are broadcast to the tiles at a time, so that what is
    broadcast grows neither with the queries nor with the dimension.

    Ties go to the smaller id. With fewer than k candidates all are returned. See ``quantised`` for the rows that take
    part. An empty table or one without queries gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    batches_of(spark, 1000)
    rows = settle(quantised(vectors, id_col, vector_col, scale))
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    turn = _rotation(rows)
    queries, together = _dealt(len(turn))
    wave = F.floor(F.log((GROWTH - 1.0) * F.col("tile") + 1.000001) / math.log(GROWTH)).cast("int")
    tiles = settle(_packed(rows, TILE, n, "tile").withColumn("wave", wave), "wave")
    blocks = settle(_packed(rows.filter(F.col("vec_id") % every == 0), queries, -(-n // every), "block").withColumn("group", F.expr(f"cast(block div {together} as int)")), "group")
    longest = [r["longest"] for r in tiles.groupBy("wave").agg(F.max("longest").alias("longest")).orderBy("wave").collect()]  # a row per wave
    groups = blocks.agg(F.max("group")).first()[0]
    if groups is None:
        return empty
    batches_of(spark, 8)
    found = None
    for group in range(groups + 1):
        asked = blocks.filter(F.col("group") == group).select("block", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
        best = _searched(asked, tiles, longest, turn, k)
        found = best if found is None else found.unionByName(best)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(asked: DataFrame, tiles: DataFrame, longest: list[float], turn: np.ndarray, k: int) -> DataFrame:
    """block, at, query_id, vec_id, score: the k best of the query at each place of some blocks, wave by wave."""
    best, order = None, W.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    for wave, most in enumerate(longest):
        if best is None:
            bounded = asked.withColumn("floors", F.expr("cast(array() as array<struct<at:int,bound:long>>)"))
        else:
            kth = best.groupBy("block", "at").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
            floors = kth.groupBy("block").agg(F.collect_list(F.struct("at", "bound")).alias("floors"))  # at most the queries of a block
            bounded = asked.join(floors, "block", "left")
        bounded = settle(bounded.mapInArrow(lean(_bounds), "block long, q_ids binary, q_vs binary, bounds binary, need double").filter(F.col("need") <= most))
        if not bounded.limit(1).count():
            break
        #: BROADCAST_BYTES of queries at most; the stated queries against all rows, in blocks
        pairs = tiles.filter(F.col("wave") == wave).join(F.broadcast(bounded), F.col("longest") >= F.col("need"))
        new = pairs.select("tile", "ids", "vs", "block", "q_ids", "q_vs", "bounds").mapInArrow(lean(_search(k, turn)), "block long, at int, query_id long, vec_id long, score long")
        both = new if best is None else best.unionByName(new)
        best = settle(both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place"))
    return best


def _unpacked(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vs, "<i8").reshape(len(i), -1)


def _at_most(x: int) -> float:
    """The largest double that is not above x."""
    f = float(x)
    return f if int(f) <= x else float(np.nextafter(f, -np.inf))


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bounds: the k-th score so far of each query (-inf without one); need: the least vector length that can reach some bound."""
    for b in batches:
        for r in b.to_pylist():
            ids, q = _unpacked(r["q_ids"], r["q_vs"])
            bound = np.full(len(ids), -np.inf)
            for f in r["floors"] or ():
                bound[f["at"]] = _at_most(f["bound"])
            length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            need = np.where(length > 0, bound / np.maximum(length, 1e-300), np.where(bound > 0, np.inf, -np.inf)).min()
            need = float(need) - abs(float(need)) * 1e-9 if np.isfinite(need) else float(need)
            yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int64()), "q_ids": [r["q_ids"]], "q_vs": [r["q_vs"]], "bounds": [bound.astype("<f8").tobytes()], "need": [need]})


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they cannot exceed 2^53, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


class _Side:
    """Vectors with their rotated form, lengths and residual lengths after each of HEADS."""

    def __init__(self, ids: bytes, vs: bytes, turn: np.ndarray):
        self.ids, self.v = _unpacked(ids, vs)
        self.turned = self.v @ turn
        self.length = np.sqrt((self.turned**2).sum(1))
        self.rest = [np.sqrt((self.turned[:, h:] ** 2).sum(1)) for h in HEADS]


def _search(k: int, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, _Side] = {}
        bounds: dict[int, np.ndarray] = {}
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        none = np.zeros(0, np.int64)
        at_hand: tuple[int, _Side] | None = None
        for b in batches:
            for i in range(b.num_rows):
                tile, ids, vs, block, q_ids, q_vs, floors = (b.column(c)[i].as_py() for c in range(7))
                if at_hand is None or at_hand[0] != tile:
                    at_hand = (tile, _Side(ids, vs, turn))
                v = at_hand[1]
                if block not in sides:
                    sides[block] = _Side(q_ids, q_vs, turn)
                    bounds[block] = np.frombuffer(floors, "<f8").copy()
                    best[block] = [(none, none)] * len(sides[block].ids)
                _meet(sides[block], v, bounds[block], best[block], k)
        for block, held in best.items():
            at = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
            if len(at):
                score, ids = (np.concatenate([h[j] for h in held]) for j in range(2))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(at), pa.int64()), "at": at.astype(np.int32), "query_id": sides[block].ids[at], "vec_id": ids, "score": score})

    return run


def _meet(q: _Side, v: _Side, bound: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Takes into best (score, id of the k best of each query) what a tile holds above the bounds, and raises these."""
    live = q.ids[:, None] != v.ids[None, :]
    rows, columns = np.arange(len(q.ids)), np.arange(len(v.ids))
    for head, rest_q, rest_v in zip(HEADS, q.rest, v.rest, strict=True):
        some = live.any(1)
        rows, live = rows[some], live[some]
        some = live.any(0)
        columns, live = columns[some], live[:, some]
        if not live.size:
            return
        slack = 1e-9 * q.length[rows][:, None] * v.length[columns][None, :] + 1e-6
        most = q.turned[rows, :head] @ v.turned[columns, :head].T + rest_q[rows][:, None] * rest_v[columns][None, :] + slack
        live = live & (most >= bound[rows][:, None])
    for r, hits in zip(rows, live, strict=True):
        at = columns[hits]
        if not len(at):
            continue
        score = _products(q.v[r : r + 1], v.v[at])[0]
        near = score >= bound[r]
        score, ids = np.concatenate([best[r][0], score[near]]), np.concatenate([best[r][1], v.ids[at[near]]])
        order = np.lexsort((ids, -score))[:k]
        best[r] = (score[order], ids[order])
        if len(order) == k:
            bound[r] = max(bound[r], _at_most(int(score[order[-1]])))
