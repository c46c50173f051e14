"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, id_remainder, lean, settle

#: Bounds of the labelled sample: documents for the word statistics, and per class for the field and the score.
LABELLED, PER_CLASS = 12_000, 300
#: A word's (or stem's) evidence is the lower 95 % Wilson bound of the share of toxic texts among those that hold it.
LEVELS = (0.3, 0.45, 0.55, 0.65, 0.75, 0.85, 0.92)
#: From this level on a word in a toxic text is a labelled toxic token. Tokens in a training window; words within which two of the
#: lexicon are near.
TAGGED, WINDOW, NEAR = 3, 64, 3
#: Lexicon words (or characters) of the texts scored at a time, unless one text has more.
PLACES, CHARS = 200_000, 2_000_000

#: Letters of the stems that count as evidence beside whole words.
STEMS = (5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Field:
    """lexicon: word, or stem and an asterisk, -> level (1...). emit[code] is the score of the toxic tag of a word (the clean tag has
    0), see ``_codes``; trans[a, b] the score of tag b after a; weights turn the expected tags of a text into its score."""

    lexicon: dict[str, int]
    emit: np.ndarray
    trans: np.ndarray
    weights: np.ndarray
    base_rate: float


def _design() -> np.ndarray:
    """Features of every code: constant, level, known by its stem only, in capitals, near another word of the lexicon."""
    rows = [np.eye(1, len(LEVELS) + 4)[0]]
    for level, stem, caps, near in product(range(len(LEVELS)), (0, 1), (0, 1), (0, 1)):
        rows.append(np.concatenate([[1.0], np.arange(len(LEVELS)) == level, [stem, caps, near]]))
    return np.array(rows)


def _keys(word: str) -> list[str]:
    """The word and its stems of STEMS letters, marked with an asterisk."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def _codes(text: str, lexicon: dict[str, int], begun: frozenset[str]) -> np.ndarray:
    """The code of every word: 0 outside the lexicon, else its row in ``_design``. begun: the first letters of the lexicon's stems."""
    get, first = lexicon.get, STEMS[0]
    raw = _WORD.findall(text)
    words = [w.lower() for w in raw]
    level = np.fromiter([max(get(k, 0) for k in _keys(w)) if w[:first] in begun else get(w, 0) for w in words], np.uint8, len(words))
    at = np.flatnonzero(level)
    near = np.diff(at) <= NEAR
    near = np.append(near, False) | np.append(False, near) if len(at) else np.zeros(0, bool)
    out = np.zeros(len(words), np.uint8)
    for i, close in zip(at.tolist(), near.tolist(), strict=True):
        stem, caps = get(words[i], 0) < level[i], len(raw[i]) > 1 and raw[i].isupper()
        out[i] = 1 + (int(level[i]) - 1) * 8 + 4 * stem + 2 * caps + close
    return out


def _level(codes: np.ndarray) -> np.ndarray:
    return (codes + 7) // 8


def _begun(lexicon: dict[str, int]) -> frozenset[str]:
    return frozenset(k[: STEMS[0]] for k in lexicon if k.endswith("*"))


def _sketch(words: list[str]) -> int:
    """Equal for copies, and for most near copies: the least hash of three neighbouring words."""
    import zlib

    h = [zlib.crc32(w.encode("utf-8", "replace")) for w in words]
    return min(((a * 31 + b) * 31 + c) * 0x9E3779B97F4A7C15 % (1 << 61) for a, b, c in zip(h, h[1:] or h, h[2:] or h, strict=False)) if h else 0


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Field:
    """Learns from labelled rows with crc32(doc_id) mod ``modulus`` other than ``held_out``, at most LABELLED of them (by
    least hash of the id; all, if fewer). Copies and near copies of a text count once per word.

    No token is labelled, so tags come from the documents: the texts fall into two halves, each with its own evidence of
    words. A word of a toxic text is a toxic token if its own half says so; its features come from the other half, so that the
    field learns how far such evidence holds for texts it was not counted from. The scores use the evidence of both."""
    spark = docs.sparkSession
    batches_of(spark, 1000)
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", modulus) != held_out))
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = rows.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows if total <= LABELLED else rows.filter(u < 0.98 * LABELLED / total)
    chosen = settle(chosen.withColumn("u", u))
    rate = chosen.agg(F.avg("toxic")).first()[0] or 0.0
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most LABELLED rows
    texts = settle(texts.select("toxic", "u", "text", F.xxhash64("text").alias("same")).dropDuplicates(["same", "toxic"]))

    def holding(wanted: frozenset[str] | None):
        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = [w.lower() for w in _WORD.findall(text)]
                    own = {k for w in set(words) for k in _keys(w)}
                    own = list(own if wanted is None else own & wanted)
                    if own:
                        yield pa.RecordBatch.from_pydict({"word": own, "toxic": pa.array([toxic] * len(own), pa.int32()), "sketch": [_sketch(words)] * len(own)})

        return held

    def counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
        seen = rows.select("toxic", "text").mapInArrow(lean(holding(wanted)), "word string, toxic int, sketch long").distinct()
        return seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sketch") % 2 == 0).alias("n0"))

    toxic_in = settle(counted(texts.filter("toxic = 1"), None).filter("n >= 3").withColumnsRenamed({"n": "k", "n0": "k0"}))
    wanted = frozenset(r["word"] for r in toxic_in.collect())  # of at most LABELLED texts
    clean_in = counted(texts.filter("toxic = 0"), wanted).withColumnsRenamed({"n": "c", "n0": "c0"})
    counts = toxic_in.join(clean_in, "word", "left").na.fill(0, ["c", "c0"])
    ways = {"low": ("k", "k + c"), "low0": ("k0", "k0 + c0"), "low1": ("k - k0", "k - k0 + c - c0")}
    wilson = "({k} / {n} + 1.9208 / {n} - 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n})"
    lows = counts.selectExpr("word", *[f"if({n} > 0, {wilson.format(k=f'({k})', n=f'({n})')}, 0) AS {way}" for way, (k, n) in ways.items()])
    strong = lows.filter(F.greatest(*ways) >= LEVELS[0]).collect()
    lexicon, *halves = [{r["word"]: int(np.searchsorted(LEVELS, r[way], side="right")) for r in strong if r[way] >= LEVELS[0]} for way in ways]
    begun, begun_half = _begun(lexicon), [_begun(x) for x in halves]

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[str, list[bytes]] = {"codes": [], "seen": [], "tags": []}
            for t in b.column(1).to_pylist():
                own = _sketch([w.lower() for w in _WORD.findall(t)]) % 2
                got["codes"].append(_codes(t, lexicon, begun).tobytes())
                got["seen"].append(_codes(t, halves[1 - own], begun_half[1 - own]).tobytes())
                got["tags"].append((_level(_codes(t, halves[own], begun_half[own])) >= TAGGED).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, pa.binary()) for v in got.values()]], ["toxic", *got])

    few = texts.filter("toxic = 1").orderBy("u").limit(PER_CLASS).unionByName(texts.filter("toxic = 0").orderBy("u").limit(PER_CLASS))
    sample = few.select("toxic", "text").mapInArrow(lean(tagged), "toxic int, codes binary, seen binary, tags binary").collect()
    seqs = [tuple(np.frombuffer(r[c], np.uint8) for c in ("codes", "seen", "tags")) for r in sample]
    if not lexicon or len({r["toxic"] for r in sample}) < 2:
        return Field({}, np.zeros(len(_design())), np.zeros((2, 2)), np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0, 0.0]), rate)
    emit, trans = _fit_field([(seen, tags & np.uint8(r["toxic"])) for r, (_, seen, tags) in zip(sample, seqs, strict=True)])
    field = Field(lexicon, emit, trans, np.zeros(4), rate)
    x = _features(field, [codes for codes, _, _ in seqs])[0]
    y = np.array([r["toxic"] for r in sample], float)
    field.weights = _logistic(x, y)
    shift = np.log(max(rate, 1e-4) / max(1 - rate, 1e-4)) - np.log(y.mean() / (1 - y.mean()))
    field.weights[0] += shift  # the sample is drawn by class
    return field


def _fit_field(seqs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood (L2-penalised, Adam) of (codes, tags) by forward-backward over windows of WINDOW tokens, all at once."""
    rows, marks = [], []
    for codes, tags in seqs:
        for i in range(0, len(codes), WINDOW):
            w, m = codes[i : i + WINDOW], tags[i : i + WINDOW]
            if w.any() or m.any() or i == 0:  # of windows without any evidence the first of a text stands for all
                rows.append(np.pad(w.astype(np.int64), (0, WINDOW - len(w)), constant_values=-1))
                marks.append(np.pad(m.astype(np.int64), (0, WINDOW - len(m))))
    x, y, design = np.array(rows), np.array(marks), _design()
    live, levels = x >= 0, len(design)
    x = np.maximum(x, 0)
    n, size = len(x), design.shape[1]
    p = np.zeros(size + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    pair = live[:, 1:]
    seen = design.T @ np.bincount(x[live], weights=y[live], minlength=levels)
    seen = np.concatenate([seen, np.bincount((2 * y[:, :-1] + y[:, 1:])[pair], minlength=4)])
    for step in range(1, rounds + 1):
        emit, trans = design @ p[:size], np.exp(p[size:].reshape(2, 2))
        e = np.where(live, np.exp(emit[x]), 1.0)
        a, b = np.zeros((n, WINDOW, 2)), np.ones((n, WINDOW, 2))
        a[:, 0] = np.stack([np.ones(n), e[:, 0]], 1)
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for t in range(1, WINDOW):
            f = a[:, t - 1] @ trans
            f[:, 1] *= e[:, t]
            a[:, t] = np.where(live[:, t, None], f / f.sum(1, keepdims=True), a[:, t - 1])
        for t in range(WINDOW - 2, -1, -1):
            g = b[:, t + 1].copy()
            g[:, 1] *= e[:, t + 1]
            g = g @ trans.T
            b[:, t] = np.where(live[:, t + 1, None], g / g.sum(1, keepdims=True), b[:, t + 1])
        q = a * b
        q = q[..., 1] / q.sum(2)
        joint = a[:, :-1, :, None] * trans * (b[:, 1:] * np.stack([np.ones_like(e[:, 1:]), e[:, 1:]], 2))[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        expected = np.concatenate([design.T @ np.bincount(x[live], weights=q[live], minlength=levels), joint[pair].sum(0).ravel()])
        grad = (seen - expected) / n - 1e-4 * p
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return design @ p[:size], p[size:].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - q) - 1e-2 * w)
    return w


def _scan(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors (each of sum 1) and the logarithms of the forward sums of a chain of 2 x 2 steps.

    The chain is cut into segments of about the root of its length: their products give the vectors that enter each, then
    all segments go at once. So a chain of any length takes its root in numpy calls.
    """
    m = len(steps)
    long = max(1, int(np.sqrt(m)))
    x = np.concatenate([steps, np.tile(np.eye(2), (-m % long, 1, 1))]).reshape(-1, long, 2, 2)
    n = len(x)
    whole = np.tile(np.eye(2), (n, 1, 1))
    for t in range(long):
        whole = whole @ x[:, t]
        whole /= np.maximum(whole.sum((1, 2), keepdims=True), 1e-300)
    enter, leave, a, b = np.empty((n, 2)), np.empty((n, 2)), np.full(2, 0.5), np.full(2, 0.5)
    for k in range(n):
        enter[k], leave[n - 1 - k] = a, b
        a, b = a @ whole[k], whole[n - 1 - k] @ b
        a, b = a / max(a.sum(), 1e-300), b / max(b.sum(), 1e-300)
    forward, backward, sums = np.empty((n, long, 2)), np.empty((n, long, 2)), np.empty((n, long))
    a, b = enter, leave
    for t in range(long):
        a = np.einsum("ni,nij->nj", a, x[:, t])
        sums[:, t] = np.maximum(a.sum(1), 1e-300)
        forward[:, t] = a = a / sums[:, t, None]
        u = long - 1 - t
        backward[:, u] = b
        b = np.einsum("nij,nj->ni", x[:, u], b)
        b = b / np.maximum(b.sum(1, keepdims=True), 1e-300)
    return forward.reshape(-1, 2)[:m], backward.reshape(-1, 2)[:m], np.log(sums).ravel()[:m]


def _features(field: Field, seqs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per text: 1, log(1 + expected toxic tags), probability that any tag is toxic, expected tags up to 2; and the marginals of its lexicon words.

    Forward-backward is exact over the whole text: runs of words outside the lexicon share one matrix, whose powers come
    from its two eigenvalues, so only lexicon words take a step. The texts make one chain, in which the first word of
    a text forgets what came before.
    """
    places = [np.flatnonzero(s) for s in seqs]
    sizes, lengths, d = np.array([len(p) for p in places], int), np.array([len(s) for s in seqs], int), len(seqs)
    m = int(sizes.sum())
    if not m:
        return np.tile([1.0, 0.0, 0.0, 0.0], (d, 1)), places
    trans, e = np.exp(field.trans), np.exp(field.emit)
    neutral = trans * np.array([1.0, e[0]])
    values, left = np.linalg.eig(neutral.T)
    values, left = values.real, left.real
    right = np.linalg.inv(left).T
    top = values.max()

    def power(g: np.ndarray) -> np.ndarray:
        return np.einsum("nk,ik,jk->nij", (values / top)[None, :] ** g[:, None], right, left)

    at, code = np.concatenate(places), np.concatenate([s[p] for s, p in zip(seqs, places, strict=True)])
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    first, last = ends - sizes[full], ends - 1
    gap = np.diff(at, prepend=0) - 1
    own = np.stack([np.ones(m), e[code]], 1)
    gap[first] = 0
    steps = (power(gap) @ trans) * own[:, None, :]
    before = at[first]  # words ahead of the first of the lexicon
    start = np.einsum("i,nij->nj", np.array([1.0, e[0]]), power(np.maximum(before - 1, 0))) @ trans
    steps[first] = (np.where((before > 0)[:, None], start, 1.0) * own[first])[:, None, :]
    after = lengths[full] - 1 - at[last]
    steps[last] *= power(after).sum(2)[:, None, :]
    forward, backward, logs = _scan(steps)
    q = forward * backward
    q = q[:, 1] / np.maximum(q.sum(1), 1e-300)
    expected, none = np.zeros(d), np.ones(d)
    expected[full] = np.add.reduceat(q, first)
    log_z = np.add.reduceat(logs + gap * np.log(top), first) + (np.maximum(before - 1, 0) + after) * np.log(top)
    none[full] = np.exp(np.minimum((lengths[full] - 1) * field.trans[0, 0] - log_z, 0))
    return np.stack([np.ones(d), np.log1p(expected), 1 - none, np.minimum(expected, 2)], 1), np.split(q, np.cumsum(sizes)[:-1])


def score(docs: DataFrame, field: Field, modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, probability of toxic lexicon words with marginal >= 0.5, in
    code points) of every text.

    A null or empty text, or one without lexicon words, gets the score of no evidence. Whole texts are scored, however long;
    repeated rows repeat; extra columns are ignored; an empty table gives an empty result.
    """
    batches_of(docs.sparkSession, 1000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", modulus) == held_out).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    begun = _begun(field.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for b in batches:
            texts = b.column(2).to_pylist()
            scores, spans = [], []

            def close(some: list[str], seqs: list[np.ndarray]) -> None:
                x, marginals = _features(field, seqs)
                scores.append(1 / (1 + np.exp(-x @ field.weights)))
                for t, s, q in zip(some, seqs, marginals, strict=True):
                    hot = np.flatnonzero(s)[q >= 0.5]
                    places = [m.span() for m in _WORD.finditer(t)] if len(hot) else []
                    spans.append([{"start": places[i][0], "end": places[i][1], "probability": float(p)} for i, p in zip(hot, q[q >= 0.5], strict=True)])

            some, seqs, n, held = [], [], 0, 0
            for t in texts:
                seq = _codes(t, field.lexicon, begun)
                if some and (n + np.count_nonzero(seq) > PLACES or held + len(t) > CHARS):
                    close(some, seqs)
                    some, seqs, n, held = [], [], 0, 0
                some.append(t)
                seqs.append(seq)
                n, held = n + np.count_nonzero(seq), held + len(t)
            if some:
                close(some, seqs)
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "spans"])

    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,probability:double>>")
