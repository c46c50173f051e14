"""Topic model of paragraphs: vocabulary, training, shares, coherence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import variational
from .variational import Model

#: Words of the vocabulary at most (the model holds topics x words on the driver), words a topic is judged by, window of coherence.
WORDS, TOP, WINDOW = 1 << 15, 20, 110
#: Cells (words x texts) of a table of texts of one window.
CELLS = 1 << 22


def vocabulary(paras: DataFrame, column: str = "tokens", least: int = 5, share: float = 0.55) -> DataFrame:
    """word, df of the words that at least ``least`` paragraphs and at most ``share`` of all paragraphs hold."""
    counts = paras.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = paras.agg(F.count(F.lit(1)).alias("total"))
    return counts.filter(F.col("df") >= least).join(F.broadcast(total), F.col("df") <= share * F.col("total")).drop("total")


def vectorizer(words: DataFrame, column: str = "tokens", most: int = WORDS) -> CountVectorizerModel:
    """Bag of words over the ``most`` most frequent words of a vocabulary; only those reach the driver."""
    top = [r["word"] for r in words.orderBy(F.desc("df"), "word").limit(most).collect()]
    return CountVectorizerModel.from_vocabulary(top, column, "bag")


def train(bags: DataFrame, k: int, passes: int = 20, seed: int = 42) -> Model:
    """Online variational training with a learned document prior."""
    return variational.train(bags, [k], passes, seed)[0]


def with_topics(model: Model, bags: DataFrame, listed: dict[str, list[int]]) -> DataFrame:
    """Adds topics (one probability per topic) and, per name, the largest probability of its listed topics (0 if none is listed)."""
    out = bags.withColumn("topics", variational.probabilities(bags, model)).drop("bag")
    return out.withColumns({n: F.array_max(F.array(*[F.col("topics")[i] for i in ids])) if ids else F.lit(0.0) for n, ids in listed.items()})


def overlap(rows: DataFrame, topic: str = "fiscal_topic_prob", keyword: str = "is_fiscal", least: float = 0.15, flag: float = 0.25) -> DataFrame:
    """Per group: paragraphs that keyword and topic flags pick, either alone, and the share above the topic threshold."""
    by_topic, by_word = F.col(topic) >= least, F.col(keyword)
    counts = {"both": by_topic & by_word, "only_keyword": ~by_topic & by_word, "only_topic": by_topic & ~by_word}
    return rows.groupBy("president").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.avg((F.col(topic) >= flag).cast("double")).alias("share"))


def top_words(model: Model, words: list[str], n: int = TOP) -> DataFrame:
    """topic, rank (from 1), word, weight."""
    rows = [(t, rank, words[w], weight) for t, top in enumerate(model.top(n)) for rank, (w, weight) in enumerate(top, 1)]
    return SparkSession.active().createDataFrame(rows, "topic int, rank int, word string, weight double")


def pair_codes(topics: list[list[int]], n: int) -> np.ndarray:
    """a * n + b of the pairs (a <= b) of words that stand in one topic, sorted."""
    codes = [np.minimum.outer(t, t).ravel() * n + np.maximum.outer(t, t).ravel() for t in (np.array(x, np.int64) for x in topics) if len(t)]
    return np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def window_counts(paras: DataFrame, words: list[str], column: str = "tokens", width: int = WINDOW, topics: list[list[str]] | None = None) -> DataFrame:
    """a, b, n: windows of ``width`` tokens that hold words a and b (a <= b; a = b: hold a; a = b = -1: all windows).

    With ``topics`` only pairs of words of one topic are counted, whatever the number of models they come from: one pass over the texts, and
    a task holds a number per such pair. A text of fewer tokens is one window.
    """
    place = {w: i for i, w in enumerate(words)}
    sets = [sorted({place[w] for w in t}) for t in ([words] if topics is None else topics)]
    wanted = pair_codes(sets, len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, total = np.zeros(len(wanted), np.int64), 0
        pairs, taken = [], np.zeros(len(wanted), bool)  # of each set the places of its pairs in ``wanted`` that no set before has
        for t in sets:
            a, b = np.triu_indices(len(t))
            at = np.searchsorted(wanted, np.array(t, np.int64)[a] * len(words) + np.array(t, np.int64)[b])
            new = ~taken[at]
            taken[at] = True
            pairs.append((t, at[new], a[new], b[new]))
        many = max(CELLS // max(len(words), 1), 1)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            coded = batch.column(0).flatten().dictionary_encode()
            codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
            known = np.array([*[place.get(w, -1) for w in coded.dictionary.to_pylist()], -1], np.int64)[codes]
            total += int(np.maximum(sizes - width + 1, 1).sum())
            short = np.flatnonzero(sizes <= width)
            for lo in range(0, len(short), many):  # texts of one window: the words that they hold, all of them at a time
                rows = short[lo : lo + many]
                row = np.repeat(np.arange(len(rows)), sizes[rows])
                ids = known[np.arange(len(row)) + np.repeat(starts[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows])]
                holds = np.zeros((len(words), len(rows)), np.float32)
                holds[ids[ids >= 0], row[ids >= 0]] = 1
                for t, at, a, b in pairs:
                    part = holds[t]
                    both[at] += (part @ part.T).astype(np.int64)[a, b]
            for i in np.flatnonzero(sizes > width):
                ids = known[starts[i] : starts[i] + sizes[i]]
                windows = len(ids) - width + 1
                for lo in range(0, windows, 4096):
                    n = min(4096, windows - lo)
                    part = ids[lo : lo + n + width - 1]
                    here = np.unique(part[part >= 0])
                    if not len(here):
                        continue
                    seen = np.vstack([np.zeros(len(here), np.int64), np.cumsum(part[:, None] == here, axis=0)])
                    start = np.arange(n)
                    inside = (seen[start + width] > seen[start]).astype(np.float64)
                    a, b = np.triu_indices(len(here))
                    codes = here[a] * len(words) + here[b]
                    at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
                    asked = wanted[at] == codes
                    both[at[asked]] += (inside.T @ inside).astype(np.int64)[a[asked], b[asked]]
        held = np.flatnonzero(both)
        yield pa.RecordBatch.from_pydict({"a": np.append(wanted[held] // max(len(words), 1), -1), "b": np.append(wanted[held] % max(len(words), 1), -1), "n": np.append(both[held], total)})

    return paras.select(column).mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def coherence(paras: DataFrame, topics: list[list[str]], column: str = "tokens") -> list[float]:
    """c_v of each topic, of one or of many models: the mean cosine between each word's vector of normalised pointwise mutual information
    and the topic's sum. One counting job."""
    words = sorted({w for t in topics for w in t})
    got = window_counts(paras, words, column, topics=topics).toArrow()  # at most a row per pair of words of a topic
    a, b, n = (got.column(c).to_numpy() for c in ("a", "b", "n"))
    total = max(int(n[a < 0].sum()), 1)
    share = {(int(x), int(y)): k / total for x, y, k in zip(a, b, n, strict=True) if x >= 0}
    place, tiny, out = {w: i for i, w in enumerate(words)}, 1e-12, []
    for t in topics:
        at = [place[w] for w in t]
        p = np.array([[share.get((min(x, y), max(x, y)), 0.0) for y in at] for x in at]).reshape(len(at), len(at))
        one = np.diag(p)
        v = np.log((p + tiny) / (np.outer(one, one) + tiny)) / -np.log(np.minimum(p + tiny, 1 - tiny))
        whole = v.sum(axis=0)
        size = np.linalg.norm(v, axis=1) * np.linalg.norm(whole)
        out.append(float(np.mean(np.divide(v @ whole, size, out=np.zeros(len(at)), where=size > 0))))
    return out


def grid(bags: DataFrame, words: list[str], ks: list[int], column: str = "tokens", passes: int = 20, at_once: int = 4) -> DataFrame:
    """k, coherence, best (the first largest) of models of each size: ``at_once`` groups are trained side by side on the same written draws,
    and the words of all of them are counted in one pass. The bags are read twice for the draws, their tokens once more."""
    models = [[[words[w] for w, _ in t] for t in m.top(TOP)] for m in variational.train(bags, ks, passes, at_once=at_once)]
    scores = iter(coherence(bags, [t for m in models for t in m], column))
    found = [(k, float(np.mean([next(scores) for _ in m]))) for k, m in zip(ks, models, strict=True)]
    best = max(found, key=lambda x: x[1])
    return bags.sparkSession.createDataFrame([(k, c, k == best[0]) for k, c in found], "k int, coherence double, best boolean")
