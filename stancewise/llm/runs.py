"""Periodic runs of words by divide and conquer (Main and Lorentz) on interned word ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, lean
from .hashing import mixed

#: A run repeats its period so often and has so many words at least.
TIMES, WORDS = 4, 6
#: Words of the texts that are searched together (a longer text is searched alone).
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Prefixes:
    """Word ids with prefix sums of a polynomial hash. Equal stretches always hash alike; what hashes alike is compared in the end."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        power = np.full(len(ids) + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(mixed(ids.astype(np.uint64)) * self.power[:-1], dtype=np.uint64))

    def alike(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a and those from b (a <= b) hash alike."""
        return (self.sums[a + size] - self.sums[a]) * self.power[b - a] == self.sums[b + size] - self.sums[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """The Z-function: for how many words the text from b goes on like the text from a."""
        z, step = np.zeros(len(a), np.int64), 1 << most.bit_length()
        while step:
            fits = np.flatnonzero(b + z + step <= len(self.ids))
            fits = fits[self.alike(a[fits] + z[fits], b[fits] + z[fits], step)]
            z[fits] += step
            step >>= 1
        return z

    def backward(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """The same towards the front: how many words before a equal those before b."""
        z, step = np.zeros(len(a), np.int64), 1 << most.bit_length()
        while step:
            fits = np.flatnonzero(a - z - step >= 0)
            fits = fits[self.alike(a[fits] - z[fits] - step, b[fits] - z[fits] - step, step)]
            z[fits] += step
            step >>= 1
        return z


def _exact(ids: np.ndarray, a: int, period: int) -> tuple[int, int]:
    """The stretch around the pair (a, a + period) in which words ``period`` apart are equal, word by word."""
    differ = np.flatnonzero(ids[: len(ids) - period] != ids[period:])
    k = int(np.searchsorted(differ, a))
    if k < len(differ) and differ[k] == a:
        return a, a
    return (int(differ[k - 1]) + 1 if k else 0), (int(differ[k]) if k < len(differ) else len(ids) - period) + period


def _is_run(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether [start, end) has the period, word by word, and no neighbouring word carries it on."""
    grows = (start > 0 and ids[start - 1] == ids[start - 1 + period]) or (end < len(ids) and ids[end] == ids[end - period])
    return not grows and np.array_equal(ids[start : end - period], ids[start + period : end])


def runs_of(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run, by start and period. ids: texts one after another, parted by ids that occur once;
    longest: words of the longest text.

    The array is halved again and again; every run crosses the middle of just one block that holds it whole, and reaches two periods
    far on one side of it. So for each middle m and period q up to a quarter of the block, one Z-value after m and one before m tell
    whether the q words beside m repeat at once; all blocks of a size are looked at together. Such squares are extended to both
    sides; intervals found with several periods keep the smallest. Larger blocks come first, and a square inside a run
    that is known, with a period as small, is not extended again. Every interval is compared word by word before it counts.
    """
    n = len(ids)
    size = max(8, 1 << max(0, n - 1).bit_length())
    top = int(ids.max(initial=0)) + 1
    ids = np.concatenate([ids, np.arange(top, top + size - n, dtype=ids.dtype)])
    text, found = Prefixes(ids), {}
    reach, least = np.zeros(size, np.int64), np.zeros(size, np.int64)  # how far runs from here or before go; the period of the one that goes farthest
    while size >= 8:
        half, periods = size // 2, min(size, longest) // TIMES
        blocks = ids.reshape(-1, size)
        known = len(found)
        if periods:
            node, q = np.nonzero(blocks[:, half + 1 : half + 1 + periods] == blocks[:, half : half + 1])
            middle, q = node * size + half, q + 1
            yes = text.alike(middle, middle + q, q)
            a, period = middle[yes], q[yes]
            node, q = np.nonzero(blocks[:, half - 1 - periods : half - 1] == blocks[:, half - 1 : half])
            middle, q = node * size + half, periods - q
            yes = text.alike(middle - 2 * q, middle - q, q)
            left = middle[yes] - 2 * q[yes]
            a, period = np.append(a, left), np.append(period, q[yes])
            new = (reach[a] < a + 2 * period) | (least[a] > period)
            a, period = a[new], period[new]
            if len(a):
                start = a - text.backward(a, a + period, longest)
                end = a + period + text.forward(a, a + period, longest)
                good = np.flatnonzero(end - start >= np.maximum(WORDS, TIMES * period))
                good = good[np.lexsort((period[good], end[good], start[good]))]
                for i in good.tolist():
                    s, e, p = int(start[i]), int(end[i]), int(period[i])
                    if (s, e) in found:
                        continue
                    if not _is_run(ids, s, e, p):  # other stretches of the same hash
                        s, e = _exact(ids, int(a[i]), p)
                        if e - s < max(WORDS, TIMES * p):
                            continue
                    found[s, e] = min(p, found.get((s, e), p))
        if len(found) > known:
            ordered = sorted((s, e, p) for (s, e), p in found.items())
            s, e, p = (np.array(x) for x in zip(*ordered, strict=True))
            far = np.maximum.accumulate(e)
            who = np.maximum.accumulate(np.where(e == far, np.arange(len(e)), 0))
            at = np.searchsorted(s, np.arange(len(ids)), "right") - 1
            reach, least = np.where(at >= 0, far[at], 0), p[who][at]
        size //= 2
    return sorted((s, e, p) for (s, e), p in found.items())


def search(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs as (start, length, period), by start and period."""
    lo = 0
    while lo < len(texts):
        words, held = [], 0
        while lo + len(words) < len(texts) and held < CHUNK:
            words.append(texts[lo + len(words)].split())
            held += len(words[-1]) + 1
        known: dict[bytes, int] = {}
        ids, begins = [], []
        for of in words:
            begins.append(len(ids))
            ids += [known.setdefault(w, len(known)) for w in of]
            known[b" %d" % len(known)] = end = len(known)  # no word holds a space
            ids.append(end)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        found = runs_of(np.array(ids, np.int64), max(map(len, words)))
        of_text = np.searchsorted(begins, [s for s, _, _ in found], "right") - 1
        for (s, e, p), k in zip(found, of_text.tolist(), strict=True):
            runs[k].append((s - begins[k], e - s, p))
        yield from zip(words, (sorted(x, key=lambda r: (r[0], r[2])) for x in runs), strict=True)
        lo += len(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period), collapsed (the text without the repeats: its words but those
    that some run holds after its first period, joined by a space).

    Words are maximal stretches without ASCII white space. Texts are searched whole; those of a batch together, up to CHUNK words.
    Null and empty texts have no runs and an empty collapsed text; repeated rows repeat; null ids stay null; extra columns are
    ignored; an empty table gives an empty result. No shuffle.
    """
    batches_of(docs.sparkSession, 1000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            collapsed, places, flat = [], [0], []
            for words, runs in search(b.column(1).to_pylist()):
                if runs:
                    keep = np.ones(len(words), bool)
                    for s, length, p in runs:
                        keep[s + p : s + length] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                flat += runs
                places.append(len(flat))
                collapsed.append(b" ".join(words))
            parts = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(lean(run), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the words of one document in ten (by crc32 of its id) repeat from some word on, as the contract of the query says."""
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("words").cast("long"), F.floor(h / 10)
    tail = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("g", F.when(h % 10 == 0, g)).withColumn("words", F.when(F.col("g").isNotNull(), words))
    tail = tail.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return tail.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns: the run of the greatest length / period (compared exactly) and digests of all runs and of the collapsed text."""
    best = F.aggregate(
        "runs", F.element_at("runs", 1), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    first = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"))
    return first.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
