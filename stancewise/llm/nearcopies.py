"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_HOT, batches_of, broadcast_if, handed_back, lean, null_safe_join, release, settle, without_copies, words_print
from .graph import components, merged
from .hashing import mixed, piece_hashes

#: Words of a shingle, least similarity, bands of rows samples each.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 3
SAMPLES = BANDS * ROWS
#: A shingle in at least SHARE of all texts is common and weighs less, down to 1 for one in every text; all others weigh 1 + GAIN.
SHARE, GAIN = 1 / 200, 0.25
#: Hash cells of the first count, which tells where common shingles can be.
CELLS = 1 << 18
#: Random variables of the sampling are shared by features with the same low bits.
DRAWS = 1 << 14
#: Bands of the first pass, which joins what is alike at little cost; the second takes all bands.
FIRST = 4
#: Texts and bytes of shingles in a tile: in the last pass, tile against tile, all pairs of a bucket that are still of different
#: components are compared.
TILE, TILE_BYTES = 512, 4_000_000
#: Pairs that one copy of a node's shingles serves while pairs are verified.
MEETINGS = 200
#: Candidate texts whose ids are broadcast to pick their rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Candidate pairs whose signatures agree in less than this share are not verified (4 standard errors below SIMILAR).
HOPELESS = 0.55

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_state: dict[str, object] = {}


def shingles(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, shingle keys, counts, owners) of runs of texts: each text's distinct shingles in ascending order.

    A key has 50 hash bits. A text of fewer than WORDS words has its words as its one shingle; one without words has none.
    """
    lo = 0
    while lo < len(texts):
        raw, n = [], 0
        while lo + len(raw) < len(texts) and n < 1 << 18 and len(raw) < 4096:
            raw.append(texts[lo + len(raw)].encode("utf-8", "replace"))
            n += len(raw[-1]) + 1
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        space = _SPACE[buf]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        word = piece_hashes(buf, starts, stops)
        ends = np.cumsum([len(r) + 1 for r in raw])
        upto = np.searchsorted(starts, ends)
        words = np.diff(np.append(0, upto))
        first = upto - words
        made = np.where(words == 0, 0, np.maximum(words - WORDS + 1, 1))
        owner = np.repeat(np.arange(len(raw)), made)
        at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(made.sum())
        h = np.zeros(len(at), np.uint64)
        for k in range(WORDS):
            inside = k < words[owner]
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else 0, np.uint64(k)))
        key = (owner.astype(np.uint64) << np.uint64(50)) | (h >> np.uint64(14))
        key.sort()
        one = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(one, len(key)))
        yield lo, key[one] & np.uint64((1 << 50) - 1), count, (key[one] >> np.uint64(50)).astype(np.int64)
        lo += len(raw)


@dataclass
class Weights:
    """What a shingle weighs: keys (ascending) and weights of the common ones, and the cells that hold some; rare weighs all others."""

    keys: np.ndarray
    weights: np.ndarray
    held: np.ndarray
    rare: float

    def of(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.rare)
        near = np.flatnonzero(self.held[(keys & np.uint64(CELLS - 1)).astype(np.int64)])
        if len(near):
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            out[near] = np.where(self.keys[at] == keys[near], self.weights[at], self.rare)
        return counts * out


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "draws" not in _state:
        g = np.random.Generator(np.random.PCG64(2010))
        shape = (SAMPLES, DRAWS)
        _state["draws"] = tuple(x.astype(np.float32) for x in (g.gamma(2.0, 1.0, shape) + 1e-6, np.log(g.gamma(2.0, 1.0, shape) + 1e-9), g.random(shape)))
    return _state["draws"]


def signatures(keys: np.ndarray, weights: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """SAMPLES x texts: hashes of the consistent weighted samples (Ioffe's scheme). Owners ascend; each has a key.

    For a key of weight S: t = floor(ln S / r + beta), ln a = ln c - r (t - beta + 1); the key of least a is the sample, with
    its t. Equal keys of equal weight behave alike in every text; ties go to the smaller key.
    """
    r_all, c_all, b_all = _draws()
    begin = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    size = np.diff(np.append(begin, len(owners)))
    nth = np.repeat(np.arange(len(begin)), size)
    cell = ((keys >> np.uint64(18)) & np.uint64(DRAWS - 1)).astype(np.int64)
    log_w = np.log(weights).astype(np.float32)
    out = np.empty((SAMPLES, len(begin)), np.uint64)
    for j in range(SAMPLES):
        r, beta = r_all[j][cell], b_all[j][cell]
        t = np.floor(log_w / r + beta)
        a = c_all[j][cell] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, begin)
        at = np.flatnonzero(a == least[nth])[::-1]
        pick = np.empty(len(begin), np.int64)
        pick[nth[at]] = at
        out[j] = mixed(keys[pick] * np.uint64(SAMPLES) + np.uint64(j) + (t[pick].astype(np.int64).astype(np.uint64) << np.uint64(56)))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for b in batches:
        for _, keys, _, _ in shingles([t or "" for t in b.column(0).to_pylist()]):
            total += np.bincount((keys & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(total)
    for lo in range(0, len(at), 50_000):
        some = at[lo : lo + 50_000]
        yield pa.RecordBatch.from_pydict({"cell": some.astype(np.int32), "n": total[some]})


def _counted_in(cells):
    """Exact counts of the shingles in some cells, added up within the task some million at a time."""

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(back, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = cells.value, 2_000_000
        keys, counts, n = [], [], 0
        for b in batches:
            for _, found, _, _ in shingles([t or "" for t in b.column(0).to_pylist()]):
                some = found[held[(found & np.uint64(CELLS - 1)).astype(np.int64)]]
                keys.append(some)
                counts.append(np.ones(len(some)))
                n += len(some)
                if n > most:
                    one, many = summed(keys, counts)
                    if len(one) > most // 2:
                        yield pa.RecordBatch.from_pydict({"key": one.astype(np.int64), "n": many})
                        one, many = one[:0], many[:0]
                    keys, counts, n = [one], [many], len(one)
        if n:
            one, many = summed(keys, counts)
            yield pa.RecordBatch.from_pydict({"key": one.astype(np.int64), "n": many})

    return run


def inverse_frequencies(docs: DataFrame) -> Weights:
    """1 + GAIN * min(ln(N / df), ln(1 / SHARE)) / ln(1 / SHARE) for a shingle in df of N texts, over all texts.

    A count by cell finds the cells that can hold a common shingle; those alone are counted one by one. At most mean shingles of
    a text / SHARE are common, at any number of texts, and only they reach the driver. The rest need no table.
    """
    spark = docs.sparkSession
    total = max(docs.count(), 1)
    least, deep = max(SHARE * total, 3.0), np.log(1 / SHARE)
    cells = docs.select("text").mapInArrow(lean(_counted), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    held = np.zeros(CELLS, bool)
    held[cells.column("cell").to_numpy()] = True
    if not held.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0), held, 1 + GAIN)
    sent = spark.sparkContext.broadcast(held)
    common = docs.select("text").mapInArrow(lean(_counted_in(sent)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy("key").toArrow()
    keys, n = common.column("key").to_numpy().astype(np.uint64), common.column("n").to_numpy()
    held = np.zeros(CELLS, bool)
    held[(keys & np.uint64(CELLS - 1)).astype(np.int64)] = True
    return Weights(keys, 1 + GAIN * np.clip(np.log(total / np.maximum(n, 1)), 0, deep) / deep, held, 1 + GAIN)


def _signed(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            for lo, keys, counts, owners in shingles(texts):
                if not len(keys):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
                sig = signatures(keys, idf.value.of(keys, counts), owners)
                bands = np.zeros((BANDS, sig.shape[1]), np.uint64)
                for k in range(SAMPLES):
                    bands[k // ROWS] = mixed(bands[k // ROWS] * np.uint64(31) + sig[k])
                which = pa.array(lo + owners[begin])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(which), b.column(1).take(which), pa.FixedSizeListArray.from_arrays(pa.array(bands.T.astype(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())), pa.FixedSizeListArray.from_arrays(pa.array((sig >> np.uint64(48)).T.astype(np.uint16).view(np.int16).ravel()), SAMPLES).cast(pa.list_(pa.int16()))],
                    ["doc_id", "print", "bands", "samples"],
                )

    return run


def packed_shingles(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys (8 bytes each), then their counts (4 bytes each)."""
    return keys.astype("<u8").tobytes() + np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes()


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, keys, counts, owners in shingles([t or "" for t in b.column(1).to_pylist()]):
            if len(keys):
                begin = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
                raws = [packed_shingles(k, n) for k, n in zip(np.split(keys, begin[1:]), np.split(counts, begin[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + owners[begin])), pa.array(raws, pa.binary())], ["print", "shingles"])


def unpacked_shingles(raw: bytes, idf: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of what packed_shingles made."""
    n = len(raw) // 12
    keys = np.frombuffer(raw, "<u8", n)
    return keys, idf.of(keys, np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64))


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    (kx, wx), (ky, wy) = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    at = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)
    both = np.minimum(wx, wy[at])[ky[at] == kx].sum()
    return float(both / (wx.sum() + wy.sum() - both))


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """node, shingles of the nodes of need (node, doc_id, print; written). Only their texts are read again."""
    ids = need.select("doc_id").distinct()
    near = broadcast_if(ids, need.count(), BROADCAST_IDS)
    rows = null_safe_join(docs.select("doc_id", "text"), near, ["doc_id"], "left_semi").select(words_print(F.col("text")).alias("print"), "text")
    texts = rows.mapInArrow(lean(_featured), "print binary, shingles binary").join(need.select("node", "print"), "print").select("node", "shingles").dropDuplicates(["node"])
    return settle(texts)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, idf) -> DataFrame:
    """Of pairs (a, b; written, distinct) those whose weighted Jaccard similarity is at least SIMILAR. Only texts in a pair are
    read again. A node in many pairs, as the leader of a large bucket is, comes once per MEETINGS of them, dealt over the tasks."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    need = settle(met.join(nodes.select("node", "doc_id", "print"), "node"))
    texts = _texts(docs, need)
    hot = need.filter(F.col("met") > MEETINGS).select("node", F.ceil(F.col("met") / MEETINGS).cast("int").alias("shares"))
    near = broadcast_if(hot, hot.count(), BROADCAST_HOT)
    shares = F.coalesce("shares", F.lit(1))

    def handed(rows: DataFrame, end: str, name: str) -> DataFrame:
        many = near.withColumnRenamed("node", end)
        dealt = rows.join(many, end, "left").withColumn("share", F.pmod(F.xxhash64("a", "b"), shares).cast("int")).drop("shares")
        held = texts.select(F.col("node").alias(end), F.col("shingles").alias(name)).join(many, end, "left")
        return dealt.join(held.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares"), [end, "share"]).drop("share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z, x, y = (b.column(i) for i in range(4))
            good = [i for i in range(b.num_rows) if weighted_jaccard(unpacked_shingles(x[i].as_py(), idf.value), unpacked_shingles(y[i].as_py(), idf.value)) >= SIMILAR]
            if good:
                yield pa.RecordBatch.from_arrays([a.take(pa.array(good)), z.take(pa.array(good))], ["a", "b"])

    both = handed(handed(pairs, "a", "x"), "b", "y").select("a", "b", "x", "y")
    return settle(both.mapInArrow(lean(run), "a long, b long"))


def _alike(one: str, two: str) -> Column:
    """Two signatures agree often enough for verifying to make sense."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= int(HOPELESS * SAMPLES)


def _with_leaders(held: DataFrame, open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hopeful pairs (a < b) of a node and the leader of its bucket, if that is of another component. A leader's signature comes
    with its bucket, so pairs without hope end in the join that would make them."""
    samples = nodes.select("node", "samples")
    leads = open_.join(samples.select(F.col("node").alias("of"), F.col("samples").alias("lead")), F.col("leader.node") == F.col("of")).drop("of")
    met = held.join(leads, ["band", "key"]).filter("label <> leader.label").select("node", F.col("leader.node").alias("other"), "lead")
    return met.join(samples, "node").filter(_alike("samples", "lead")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _last_links(docs: DataFrame, held: DataFrame, open_: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """Links (a, b) between nodes that share a bucket and are of different components, enough to join all components that have one.

    Of a bucket's components the largest is its main one; every node outside meets all nodes of the bucket. A tile of outside
    nodes and a tile of the bucket make one row. First they come with their signatures, to find the nodes that are likely
    enough to link to some other; those alone come again with their shingles, and are verified where they meet. So a large
    bucket spreads over the tasks, pairs never become rows, and a node's shingles travel once per bucket and tile.
    """
    batches_of(held.sparkSession, 8)
    rows = settle(held.join(open_.select("band", "key", "main"), ["band", "key"]).withColumn("out", F.col("label") != F.col("main")))
    signed = rows.join(nodes.select("node", "bands", "samples"), "node")
    near = settle(_in_tiles(signed.withColumns({"size": F.lit(0), "shingles": F.lit(None).cast("binary")})).mapInArrow(lean(_likely), "band int, key long, node long").distinct())
    texts = _texts(docs, settle(near.select("node").distinct().join(nodes.select("node", "doc_id", "print"), "node")))
    likely = rows.join(near, ["band", "key", "node"]).join(nodes.select("node", "bands", "samples"), "node").join(texts, "node")
    batches_of(held.sparkSession, 4)
    links = settle(_in_tiles(likely.withColumn("size", F.octet_length("shingles"))).mapInArrow(lean(_met(idf)), "a long, b long"))
    batches_of(held.sparkSession, 500)
    return links


def _in_tiles(rows: DataFrame) -> DataFrame:
    """band, key, x, y: each tile of outside nodes of a bucket with each tile of its nodes, of at most about TILE nodes and TILE_BYTES.
    Tiles are dealt one by one, so that those of one bucket are made and meet in many tasks."""
    tiles = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_BYTES), F.lit(1)).cast("int")
    counts = rows.groupBy("band", "key").agg(tiles(F.count(F.lit(1)), F.sum("size")).alias("all"), tiles(F.count_if("out"), F.sum(F.when(F.col("out"), F.col("size")).otherwise(0))).alias("outside"), F.count_if("out").alias("n_out"))
    full = rows.join(settle(counts.filter("n_out > 0")), ["band", "key"])
    one = F.struct("node", "label", "out", "bands", "samples", "shingles")
    spread = ["band", "key", "tile"]
    dealt = lambda df, n: df.withColumn("tile", F.pmod(F.xxhash64("node"), F.col(n)).cast("int")).repartition(*spread)
    whole = dealt(full, "all").groupBy(*spread).agg(F.collect_list(one).alias("y"))
    outside = dealt(full.filter("out"), "outside").groupBy(*spread, "all").agg(F.collect_list(one).alias("x"))
    outside = outside.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    return outside.join(whole, spread).select("band", "key", "x", "y")


def _columns(held: pa.ListScalar) -> list:
    node, label, out, bands, samples, shingles = held.values.flatten()
    return [node.to_numpy(), label.to_numpy(), out.to_numpy(zero_copy_only=False), bands.flatten().to_numpy().reshape(-1, BANDS), samples.flatten().to_numpy().reshape(-1, SAMPLES), shingles]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of two tiles whose signatures agree often enough with some node of the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            one, two = _columns(batch.column(2)[i]), _columns(batch.column(3)[i])
            x, y, _ = _hopeful_pairs(batch.column(0)[i].as_py(), one, two)
            found = np.unique(np.concatenate([one[0][np.unique(x)], two[0][np.unique(y)]]))
            if len(found):
                yield pa.RecordBatch.from_arrays([batch.column(c)[i : i + 1].take(pa.array(np.zeros(len(found), int))) for c in (0, 1)] + [pa.array(found, pa.int64())], ["band", "key", "node"])


def _hopeful_pairs(band: int, one: list, two: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in two tiles of the pairs of different components that share no band before this one and are not HOPELESS, and how
    many samples agree."""
    (n1, l1, _, b1, s1, _), (n2, l2, o2, b2, s2, _) = one, two
    unmet = (l1[:, None] != l2[None, :]) & ~(o2[None, :] & (n1[:, None] > n2[None, :]))  # two outside nodes meet once
    for k in range(band):
        unmet &= b1[:, k, None] != b2[None, :, k]
    agree = np.zeros(unmet.shape, np.int16)
    if unmet.any():
        for k in range(SAMPLES):
            agree += s1[:, k, None] == s2[None, :, k]
    x, y = np.nonzero(unmet & (agree >= int(HOPELESS * SAMPLES)))
    return x, y, agree[x, y]


def _met(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                links = _compared(batch.column(0)[i].as_py(), _columns(batch.column(2)[i]), _columns(batch.column(3)[i]), idf.value)
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compared(band: int, one: list, two: list, idf: Weights) -> list[tuple[int, int]]:
    """Links between the nodes of two tiles, the likeliest pairs first; pairs of components that a link has joined are passed over."""
    (n1, l1, raw1), (n2, l2, raw2) = (one[0], one[1], one[5]), (two[0], two[1], two[5])
    x, y, agree = _hopeful_pairs(band, one, two)
    order = np.argsort(-agree, kind="stable")
    top: dict[int, int] = {}

    def root(v: int) -> int:
        while v in top:
            v = top[v]
        return v

    held: tuple[dict, dict] = ({}, {})
    links = []
    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        p, q = root(int(l1[i])), root(int(l2[j]))
        if p == q:
            continue
        for side, raw, at in ((0, raw1, i), (1, raw2, j)):
            if at not in held[side]:
                held[side][at] = unpacked_shingles(raw[at].as_py(), idf)
        if weighted_jaccard(held[0][i], held[1][j]) >= SIMILAR:
            a, b = int(n1[i]), int(n2[j])
            links.append((min(a, b), max(a, b)))
            top[max(p, q)] = min(p, q)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, n_links, kept.

    Classes are the components of "weighted Jaccard similarity of five-word shingles is 0.8 or more", where a shingle weighs
    its count times a smoothed inverse document frequency (see inverse_frequencies). Texts of the same words are one node from
    the start. Each node's consistent weighted samples fall into bands; nodes that share a band are candidates. First, in FIRST of
    the bands, every node of a bucket meets the bucket's most central one, whose bands are shared most: of copies of one text
    that is the text. Then, in all buckets that still hold several components, every node meets the central one of its bucket if
    that is of another component. Last, every pair of a bucket of any size that is
    still of different components is compared, so no candidate is left out (see _last_links). A pair of similarity 0.8 shares 8 of 16 bands on average and none with probability 1e-5. Every link is verified on
    the whole texts. n_links counts the verified links of a document's text.

    A text without words is alone in its class, as is a null one. Of equal ids, rows repeat; exactly one row of a class is kept,
    that of the least id (null ids last). An empty table gives an empty result; extra columns are ignored.
    """
    return _classes(docs).drop("mark")


def _classes(docs: DataFrame) -> DataFrame:
    """near_duplicates with mark, the print of the words of each text."""
    spark = docs.sparkSession
    batches_of(spark, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))  # at most mean shingles of a text / SHARE entries
    signed = docs.select("doc_id", words_print(F.col("text")).alias("print"), "text").mapInArrow(lean(_signed(idf)), "doc_id long, print binary, bands array<long>, samples array<short>")
    signed = settle(signed.withColumn("row", F.monotonically_increasing_id()))
    nodes = settle(signed.groupBy("print").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"), F.any_value("samples").alias("samples")))
    banded = settle(nodes.select("node", F.posexplode("bands").alias("band", "key")))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(banded.join(buckets, ["band", "key"]))
    central = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    shared = settle(shared.select("node", "band", "key").join(central, "node"))
    release(spark)

    most_central = F.struct("weight", F.xxhash64("node"))
    leader = F.max_by(F.struct("node", "label"), most_central).alias("leader")
    alone = shared.filter(f"band < {FIRST}").withColumn("label", F.col("node"))
    tried = settle(_with_leaders(alone, alone.groupBy("band", "key").agg(leader), nodes).distinct())
    links = _verified(docs, nodes, tried, idf)
    labels = components(links)
    for last in (False, True):
        release(spark)
        held = settle(shared.join(labels, "node", "left").select("band", "key", "node", "weight", F.coalesce("label", "node").alias("label")))
        wanted = F.mode("label").alias("main") if last else leader
        open_ = settle(held.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), wanted).filter("lo <> hi").drop("lo", "hi"))
        if last:
            more = settle(_last_links(docs, held, open_, nodes, idf).distinct())
        else:
            more = _verified(docs, nodes, settle(_with_leaders(held, open_, nodes).distinct().join(tried, ["a", "b"], "left_anti")), idf)
        if more.limit(1).count():
            links, labels = links.unionByName(more), merged(labels, more)
    release(spark)

    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("node", "print", "copies").join(labels, "node", "left").join(ends, "node", "left").select("print", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = settle(handed_back(signed.select("doc_id", "print", "row"), settle(named), "print", "copies").drop("copies"))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    classes = settle(rows.groupBy("label").agg(first_row, F.count(F.lit(1)).alias("class_size")))
    in_class = handed_back(rows, classes, "label", "class_size").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", (F.col("row") == F.col("first.row")).alias("kept"), F.col("print").alias("mark"))
    alone = docs.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), words_print(F.col("text")).alias("mark"))
    return in_class.unionByName(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay (one of each class), with the columns of docs.

    A row is known by its id and words, so with null or repeated ids every class still keeps one row; of rows that repeat both
    (their other columns may differ) one stays. Texts without words stay, each of them; an empty table stays empty.
    """
    found = _classes(docs).filter("class_size > 1").groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return without_copies(docs, settle(found.filter("n > 1 OR NOT kept")), words_print(F.col("text")), BROADCAST_IDS)
