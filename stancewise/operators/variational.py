"""Online variational training of topic models, of one or of many side by side: the steps, the values and the draws of Spark's own LDA.

Each step draws its share of the texts. All draws are written once, a folder per step, so that a step reads its own texts and not all of
them. A step is one job for all models of a group: tasks settle their texts in blocks and sum per word, the sums are added by ranges of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landing import new_path

#: Fixed values, those of Spark's LDA: the share of a step's draw, offset and decay of its weight, shape of the first values, the mean change of a settled text.
SHARE, OFFSET, DECAY, SHAPE, CLOSE = 0.05, 1024, 0.51, 100.0, 1e-3
#: Added to what topics expect of a word, so that nothing is divided by 0.
LEAST = 1e-30
#: Texts and entries (texts x words) that a task settles at a time: the last ones take hundreds of rounds, whatever the number of the others.
TEXTS, MOST = 1 << 15, 1 << 22
#: Entries of a block and rounds of its first turn: what is not settled by then goes on in new blocks, for as many rounds as it has had.
BLOCK, TURN = 1 << 15, 8
#: Entries of a word that are added in single precision.
PIECE = 1 << 9
#: exp(digamma(z + 1/2)) / z in powers of 1 / z².
POWERS = (1.0, 1 / 24, -37 / 5760, 10313 / 2903040, -5509121 / 1393459200)
#: Words whose sums make a row, topics at most of the models (if more than one) of a job.
RANGE, TOPICS = 256, 128


@dataclass
class Model:
    """weights: words x topics, as learned; prior: per topic."""

    weights: np.ndarray
    prior: np.ndarray

    def top(self, n: int) -> list[list[tuple[int, float]]]:
        """Of each topic the n heaviest words and their shares."""
        shares = self.weights / self.weights.sum(axis=0)
        order = np.argsort(-shares, axis=0, kind="stable")[:n]
        return [[(int(w), float(shares[w, t])) for w in order[:, t]] for t in range(shares.shape[1])]


def _tail(x: np.ndarray) -> np.ndarray:
    """Sum of 1 / (x + i) for i below 6."""
    u = x * (x + 5)
    return (2 * x + 5) * (1 / u + 1 / (u + 4) + 1 / (u + 6))


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r / 252)) - _tail(x)


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    r = 1 / (y * y)
    return sum(1 / (x + i) ** 2 for i in range(6)) + (1 + 0.5 / y + r * (1 / 6 - r * (1 / 30 - r / 42))) / y


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) to 2e-8 of itself, without a logarithm."""
    u = x + 3
    u *= x
    tail = x * -4 - 6
    tail *= u + 1
    below = u + 2
    below *= u
    tail /= below  # minus the sum of 1 / (x + i) for i below 4
    np.exp(tail, out=tail)
    z = x + 3.5
    w = np.reciprocal(z * z)
    out = w * POWERS[-1]
    for c in POWERS[-2:0:-1]:
        out += c
        out *= w
    out += POWERS[0]
    out *= z
    out *= tail
    return out


def expected(x: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet distributions along the last axis."""
    return digamma(x) - digamma(x @ np.ones((x.shape[-1], 1), x.dtype))


def word_weights(model: Model) -> np.ndarray:
    """In single precision, in which texts are settled."""
    return (exp_digamma(model.weights) / exp_digamma(model.weights.sum(axis=0))).astype(np.float32)


def entries(bag: str = "bag") -> tuple[Column, Column]:
    """Word ids and counts of a column of vectors."""
    held = F.unwrap_udt(F.col(bag))
    ids = F.when(held["type"] == 0, held["indices"]).otherwise(F.sequence(F.lit(0), F.size(held["values"]) - 1))
    return ids.alias("ids"), held["values"].alias("counts")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, together as far as TEXTS and MOST allow."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TEXTS or sum(len(b.column(0).flatten()) for b in held) >= MOST:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def padded(sizes: np.ndarray, starts: np.ndarray, rows: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of lists of like sizes, at most ``most`` entries together: rows, the places of their entries, and which of those are no padding."""
    order = rows[np.argsort(-sizes[rows], kind="stable")][: np.count_nonzero(sizes[rows])]
    while len(order):
        rows, order = np.split(order, [max(most // sizes[order[0]], 1)])
        place = np.arange(sizes[rows[0]])
        inside = place < sizes[rows][:, None]
        yield rows, np.where(inside, starts[rows][:, None] + place, 0), inside


class Texts:
    """Texts as word ids and counts."""

    def __init__(self, ids: pa.Array, counts: pa.Array):
        self.sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids, self.counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, counts))

    def blocks(self, rows: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """rows, ids, counts of texts of like sizes, padded with counts of 0; texts without words are in no block."""
        for rows, at, inside in padded(self.sizes, self.starts, rows, most):
            yield rows, np.where(inside, self.ids[at], 0), np.where(inside, self.counts[at], 0).astype(np.float32)


class Words:
    """The entries of blocks of texts by word, in pieces."""

    def __init__(self, small: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        ids, counts = (np.concatenate([b[i].ravel() for b in small]) for i in (1, 2))
        texts = np.concatenate([np.repeat(rows, ids.shape[1]) for rows, ids, _ in small])
        entries = np.flatnonzero(counts)
        entries = entries[np.argsort(ids[entries], kind="stable")]
        own, first = np.unique(ids[entries], return_index=True)
        since = np.arange(len(entries)) - np.repeat(first, np.diff(first, append=len(entries)))
        starts = np.flatnonzero(since % PIECE == 0)
        sizes = np.diff(starts, append=len(entries))
        self.own, self.first, self.pieces = own, np.searchsorted(starts, first), len(starts)
        self.blocks = [(rows, np.where(inside, entries[at], len(ids)), texts[entries[at]]) for rows, at, inside in padded(sizes, starts, np.arange(len(starts)), BLOCK)]

    def sums(self, found: list[np.ndarray], theta: np.ndarray) -> np.ndarray:
        """Of each own word the sum of its texts' rows of theta, by the ratios found for the blocks of texts."""
        parts, values = np.empty((self.pieces, theta.shape[1])), np.concatenate([*[f.ravel() for f in found], np.zeros(1, theta.dtype)])
        for rows, at, texts in self.blocks:
            parts[rows] = (values[at][:, None, :] @ np.take(theta, texts, axis=0))[:, 0]
        return np.add.reduceat(parts, self.first, axis=0)


def ratios(near: np.ndarray, counts: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Counts by what the topics expect of each word."""
    return counts / ((near @ theta[:, :, None])[:, :, 0] + LEAST)


def improve(beta: np.ndarray, prior: np.ndarray, block: tuple[np.ndarray, np.ndarray, np.ndarray], gamma: np.ndarray, rounds: int) -> np.ndarray:
    """Sets the rows of gamma to what they are when they have changed by CLOSE at most in the mean; returns those that have not within the rounds."""
    row, ids, counts = block
    near, now, goes_on, share = np.take(beta, ids, axis=0), gamma[row], np.ones(len(row), bool), np.full(len(prior), 1 / len(prior), beta.dtype)
    for _ in range(rounds):
        theta = exp_digamma(now)  # by a factor a text, which has no effect
        last, now = now, theta * (ratios(near, counts, theta)[:, None, :] @ near)[:, 0] + prior
        ends = goes_on & ~(np.abs(now - last) @ share > CLOSE)
        if ends.any():
            gamma[row[ends]] = now[ends]
            goes_on &= ~ends
            if not goes_on.any():
                break
            if np.count_nonzero(goes_on) < 0.75 * len(row):
                near, counts, now, row = (x[goes_on] for x in (near, counts, now, row))
                goes_on = np.ones(len(row), bool)
    gamma[row[goes_on]] = now[goes_on]
    return row[goes_on]


def settle(beta: np.ndarray, prior: np.ndarray, texts: Texts, small: list, chance: np.random.Generator) -> np.ndarray:
    """gamma (texts x topics) in the precision of beta; rows of texts without words mean nothing."""
    gamma = chance.gamma(SHAPE, 1 / SHAPE, (len(texts.sizes), len(prior))).astype(beta.dtype)
    left, blocks, done = np.arange(len(gamma)), small, 0
    while len(left):
        rounds = max(done, TURN)
        left = np.concatenate([left[:0], *[improve(beta, prior.astype(beta.dtype), block, gamma, rounds) for block in blocks]])
        blocks, done = texts.blocks(left), done + rounds
    return gamma


def _summed(rows: DataFrame, betas: list[np.ndarray], priors: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Over the drawn texts: sums per word and topic, sums of expected logarithms per topic, texts with words."""
    shared = rows.sparkSession.sparkContext.broadcast((betas, priors))
    edges = np.cumsum([0, *map(len, priors)])
    words, width = len(betas[0]), int(edges[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        betas, priors = shared.value
        sums, logs, texts = np.zeros((words, width)), np.zeros(width), 0
        chance = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for table in gathered(batches):
            held = Texts(*(c.combine_chunks() for c in table.columns))
            small = list(held.blocks(np.arange(table.num_rows)))
            if not small:
                continue
            by_word, some = Words(small), held.sizes > 0
            texts += np.count_nonzero(some)
            for beta, prior, lo, hi in zip(betas, priors, edges, edges[1:], strict=False):
                log = expected(settle(beta, prior, held, small, chance))
                theta = np.exp(log)
                sums[by_word.own, lo:hi] += by_word.sums([ratios(np.take(beta, ids, axis=0), counts, theta[rows]) for rows, ids, counts in small], theta)
                logs[lo:hi] += log[some].sum(axis=0, dtype=np.float64)
        if texts:
            found = [(lo, part.tobytes()) for lo in range(0, words, RANGE) if (part := sums[lo : lo + RANGE]).any()]
            for lo, data in [*found, (-1, np.append(logs, texts).tobytes())]:
                yield pa.RecordBatch.from_pydict({"lo": pa.array([lo], pa.int32()), "sums": pa.array([data], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"lo": table.column("lo").slice(0, 1), "sums": pa.array([out.tobytes()], pa.binary())})

    schema = "lo int, sums binary"
    got = rows.mapInArrow(run, schema).groupBy("lo").applyInArrow(total, schema).toArrow().to_pylist()
    shared.destroy()
    sums, tail = np.zeros((words, width)), np.zeros(width + 1)
    for r in got:
        part = np.frombuffer(r["sums"])
        if r["lo"] < 0:
            tail = part
        else:
            sums[r["lo"] : r["lo"] + RANGE] = part.reshape(-1, width)
    return sums, tail[:-1], int(tail[-1])


def _learned_prior(prior: np.ndarray, logs: np.ndarray, texts: int, weight: float) -> np.ndarray:
    """A Newton step; the old one if the new one is not positive."""
    gradient = texts * (logs / texts - expected(prior))
    c, q = texts * trigamma(prior.sum()), -texts * trigamma(prior)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    new = prior - weight * (gradient - b) / q
    return new if (new > 0).all() else prior


def groups(ks: list[int]) -> list[list[int]]:
    """Sizes dealt in turn to as few groups as TOPICS allows (i, i + n, i + 2 n, ... to group i of n), so that groups have like work."""
    fits = (n for n in range(1, len(ks)) if max(sum(ks[i::n]) for i in range(n)) <= TOPICS)
    n = next(fits, len(ks))
    return [ks[i::n] for i in range(n)]


def train(bags: DataFrame, ks: list[int], passes: int = 20, seed: int = 42, at_once: int = 4) -> list[Model]:
    """Models of each size from the vectors in ``bag``, with a learned prior; ``at_once`` groups of at most TOPICS topics side by side."""
    spark, held = bags.sparkSession, F.unwrap_udt(F.col("bag"))
    texts, words = bags.agg(F.count(F.lit(1)), F.max(F.coalesce(held["size"], F.size(held["values"])))).first()
    if not words:
        raise ValueError("topics need texts with words")
    path, drawn_in = new_path(spark), [F.when(F.rand(seed * 1000 + i) < SHARE, i) for i in range(passes)]
    drawn = bags.select(*entries()).withColumn("step", F.explode(F.array_compact(F.array(*drawn_in))))
    drawn.write.partitionBy("step").parquet(path)
    drawn = spark.read.schema("ids array<int>, counts array<double>, step int").parquet(path)

    parted = groups(ks)
    tasks = max(math.ceil(SHARE * texts / TEXTS), spark.sparkContext.defaultParallelism // min(at_once, len(parted)), 1)

    def group(sizes: list[int]) -> list[Model]:
        chance = np.random.default_rng([seed, *sizes])
        models = [Model(chance.gamma(SHAPE, 1 / SHAPE, (words, k)), np.full(k, 1 / k)) for k in sizes]
        edges, done = np.cumsum([0, *sizes]), 0
        for step in range(passes):
            betas = [word_weights(m) for m in models]
            rows = drawn.filter(F.col("step") == step).drop("step").coalesce(tasks)
            sums, logs, n = _summed(rows, betas, [m.prior for m in models], seed * 1000 + step)
            if not n:
                continue
            done += 1
            weight, scale = (OFFSET + done) ** -DECAY, texts / math.ceil(SHARE * texts)
            for m, beta, lo, hi, k in zip(models, betas, edges, edges[1:], sizes, strict=False):
                m.weights = (1 - weight) * m.weights + weight * (sums[:, lo:hi] * beta * scale + 1 / k)
                m.prior = _learned_prior(m.prior, logs[lo:hi], n, weight)
        return models

    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(group, parted))
    return [found[i % len(found)][i // len(found)] for i in range(len(ks))]


def probabilities(bags: DataFrame, model: Model, seed: int = 42) -> Column:
    """array<double>: the topics' shares of each vector in ``bag``; zeros for one without words."""
    shared = bags.sparkSession.sparkContext.broadcast((word_weights(model), model.prior))

    @F.arrow_udf("array<double>")
    def shares(ids: pa.Array, counts: pa.Array) -> pa.Array:
        beta, prior = shared.value
        held = Texts(ids, counts)
        small = list(held.blocks(np.arange(len(ids))))
        gamma = settle(beta, prior, held, small, np.random.default_rng(seed)).astype(np.float64)
        out = np.where(held.sizes[:, None] > 0, gamma / gamma.sum(axis=1, keepdims=True), 0.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(prior)), pa.array(out.ravel()))

    return shares(*entries())
