"""Relevance by cosine to seed vectors, as a block product."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landing import landed

#: Bytes of the seed vectors that are broadcast at a time; more seeds take further passes over the vectors.
SEED_BYTES = 32 << 20


def unit_rows(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of this size as rows of length 1; NaN rows for those that are null, of another size, of length 0 or not finite."""
    flat = vectors.flatten()
    if not vectors.null_count and not flat.null_count and len(flat) == size * len(vectors) and (np.diff(vectors.offsets.to_numpy()) == size).all():
        out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size)
    else:
        out = np.full((len(vectors), size), np.nan)
        for i, v in enumerate(vectors.to_pylist()):
            if v is not None and len(v) == size and None not in v:
                out[i] = v
    norm = np.sqrt((out * out).sum(1))
    with np.errstate(invalid="ignore"):
        return out / np.where(np.isfinite(norm) & (norm > 0), norm, np.nan)[:, None]


def _best(seeds: Broadcast, size: int) -> Callable[[Column], Column]:
    @F.arrow_udf("double")
    def best(vectors: pa.Array) -> pa.Array:
        if not seeds.value.shape[1]:
            return pa.nulls(len(vectors), pa.float64())
        top = (unit_rows(vectors, size) @ seeds.value).max(1)
        return pa.array(top, mask=np.isnan(top))

    return best


def seed_similarity(vectors: DataFrame, seeds: DataFrame, block_bytes: int = SEED_BYTES) -> DataFrame:
    """vec_id, label, similarity: the largest cosine to a seed; null without one (null, zero or non-finite vectors, no seeds of its size).

    Vectors come in Arrow batches and are multiplied with a broadcast block of seeds. Seeds are dealt into blocks by hash, as many as it
    takes for every block's counted size to be within ``block_bytes``; each block is a pass over the vectors, whose best is written. The
    size of a vector is that of most seeds.
    """
    spark = vectors.sparkSession
    usable = landed(seeds.filter("embedding IS NOT NULL").select("embedding").distinct())
    found = vectors.select("vec_id", "label", "embedding", F.lit(None).cast("double").alias("similarity"))
    sizes = usable.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None or not sizes["size"]:
        return found.drop("embedding")
    size, most = sizes["size"], max(1, block_bytes // (8 * sizes["size"]))
    usable = usable.filter(F.size("embedding") == size)
    blocks = -(-sizes["n"] // most)
    deal = lambda: F.pmod(F.xxhash64("embedding"), F.lit(blocks))
    while blocks > 1 and usable.groupBy(deal()).count().agg(F.max("count")).first()[0] > most:
        blocks *= 2
    for block in range(blocks):
        matrix = unit_rows(usable.filter(deal() == block).toArrow().column(0).combine_chunks(), size)
        shared = spark.sparkContext.broadcast(matrix[~np.isnan(matrix[:, :1]).any(1)].T.copy())
        found = found.withColumn("similarity", F.greatest("similarity", _best(shared, size)("embedding")))
        if blocks > 1:
            found = landed(found)
    return found.drop("embedding")
