"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, broadcast_if, id_remainder, lean, settle

#: Bounds of the labelled sample: documents and characters per language, and the document lengths that qualify.
SAMPLE_DOCS, SAMPLE_CHARS, SHORTEST, LONGEST = 96, 32_000, 40, 8_000
#: Of a language without such documents: texts at most, and pieces taken of one above LONGEST.
OTHER_DOCS, PIECES = 4_000, 8
#: Characters of a segment: parsing starts a new phrase at each multiple of it, so that segments are independent.
SEGMENT = 1024
#: Characters parsed at a time (some 60 bytes of working memory each).
PASS = 500_000
#: Cells of all dense tables of a worker (4 bytes each).
DENSE = 1 << 25


def labelled_sample(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> dict[str, str]:
    """Labelled text per language, at most SAMPLE_CHARS characters: the documents of least hash among the labelled rows
    with crc32(doc_id) mod ``modulus`` other than ``held_out``. Whole documents of SHORTEST to LONGEST characters; a language that
    has none of them is learned from its short texts whole and from PIECES pieces spread over its long ones.

    The hash threshold per language comes from its row count, so only a few times the rows that are taken are ever ranked.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (id_remainder("doc_id", modulus) != held_out))
    fits = F.length("text").between(SHORTEST, LONGEST)
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    share = rows.groupBy("lang").agg(F.count_if(fits).alias("fit"), F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("fit") > 0, SAMPLE_DOCS).otherwise(OTHER_DOCS)
    share = settle(share.select("lang", (F.col("fit") > 0).alias("some_fit"), most.alias("most"), (4.0 * most / F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("n"))).alias("share")))
    share = broadcast_if(share, share.count(), 100_000)  # a row per language; without the hint all labelled texts would be shuffled
    near = rows.join(share, "lang").filter((u < F.col("share")) & (fits | ~F.col("some_fit"))).withColumn("u", u)
    piece = LONGEST // PIECES
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", (F.floor(i * (F.length("text") - piece) / (PIECES - 1)) + 1).cast("int"), F.lit(piece)))
    near = near.select("lang", "doc_id", "u", "most", F.when(F.length("text") > LONGEST, F.array_join(spread, "\n")).otherwise(F.col("text")).alias("text"))
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("u", "doc_id", "text"))).filter(F.col("k") <= F.col("most"))
    # what is beyond SAMPLE_CHARS cannot be taken and stays with the executors
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("lang").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("before", before).filter((F.col("most") == SAMPLE_DOCS) | (F.col("before") < SAMPLE_CHARS))
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
        held = out.setdefault(r["lang"], [])
        if sum(map(len, held)) + len(r["text"]) <= SAMPLE_CHARS or not held:
            held.append(r["text"])
    return {lang: "\n".join(texts) for lang, texts in sorted(out.items())}


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def automaton(text: str) -> tuple[list[dict[str, int]], int]:
    """Transitions of the suffix automaton of text; state 0 is the start."""
    trans, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans, len(text)


class _Table:
    """A language's automaton over its own letters. Cell [state, code] holds 2 * (next state * width) + (1 if a phrase ends).

    After the automaton's states come one for "after a character that the sample lacks" and one for "nothing read yet". Small
    tables are dense; of large alphabets only the moves are kept, sorted.
    """

    def __init__(self, text: str, code: dict[str, int], dense: int):
        trans, n = automaton(text)
        letters = sorted(set(text) - {" "})
        local = {c: i + 1 for i, c in enumerate(letters)} | {" ": 0}
        self.width, self.bits = len(letters) + 2, math.log2(max(n, 2))
        self.local = np.full(len(code) + 2, self.width - 1, np.int32)
        self.local[0] = 0
        self.local[[code[c] for c in letters]] = [local[c] for c in letters]
        lacking, w = len(trans), self.width
        self.begin = (lacking + 1) * w
        first = np.full(w, lacking, np.int64)
        for c, q in trans[0].items():
            first[local[c]] = q
        self.restart = 2 * first * w + 1
        self.dense = (lacking + 2) * w <= dense
        if self.dense:
            t = np.tile(self.restart, (lacking + 2, 1))
            t[-1] -= 1  # the first phrase is counted at the end
            for s, moves in enumerate(trans):
                for c, q in moves.items():
                    t[s, local[c]] = 2 * q * w
            self.cells = t.astype(np.int32 if 2 * t.size < 1 << 31 else np.int64).ravel()
        else:
            moves = sorted((s * w + local[c], 2 * q * w) for s, m in enumerate(trans) for c, q in m.items())
            self.keys, self.next = np.array([k for k, _ in moves], np.int64), np.array([v for _, v in moves], np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.cells[state + code]
        key = state + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], self.restart[code] - (state == self.begin))


class Parser:
    """The automata of all languages. The dense ones share DENSE cells, the narrowest first."""

    def __init__(self, samples: dict[str, str]):
        self.langs = list(samples)
        words = {lang: _plain(text) for lang, text in samples.items()}
        alphabet = sorted(set().union(*words.values()) - {" "})
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.letter = _letters()
        self.code = np.zeros(len(self.letter), np.int32)
        self.code[self.letter] = len(alphabet) + 1
        self.code[[ord(c) for c in alphabet]] = list(code.values())
        made: dict[str, _Table] = {}
        left = DENSE
        for lang in sorted(self.langs, key=lambda x: (len(set(words[x])), x)):
            made[lang] = _Table(words[lang], code, left)
            left -= len(made[lang].cells) if made[lang].dense else 0
        self.tables = [made[lang] for lang in self.langs]
        self.bits = [t.bits for t in self.tables]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: phrases by language (rows), characters after normalising, has a letter."""
        raw = [t.lower() for t in texts]
        points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        codes = self.code[points]
        has = np.bincount(owner[self.letter[points]], minlength=len(raw)) > 0
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        codes, owner = codes[keep], owner[keep]
        chars = np.bincount(owner, minlength=len(raw))
        starts = np.concatenate([[0], np.cumsum(chars)])[:-1]
        pieces = -(-chars // SEGMENT)
        doc = np.repeat(np.arange(len(raw)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[doc] + nth * SEGMENT
        size = np.minimum(chars[doc] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, doc = begin[order], size[order], doc[order]
        alive = np.searchsorted(-size, -np.arange(SEGMENT), side="left")
        total = np.zeros((len(self.langs), len(raw)))
        for k, table in enumerate(self.tables):
            own = table.local[codes]
            count = np.ones(len(doc), np.int64)
            state = np.full(len(doc), table.begin, np.int64)
            for i in range(int(size[0]) if len(size) else 0):
                m = alive[i]
                t = table.step(state[:m], own[begin[:m] + i])
                count[:m] += t & 1
                state[:m] = t >> 1
            total[k] = np.bincount(doc, weights=count, minlength=len(raw))
        return total, chars, has


def _plain(text: str) -> str:
    """Lower case; runs of anything but letters become one space."""
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))


_made: dict[int, Parser] = {}


#: The columns that a verdict adds.
VERDICT = ("held_out", "lang_pred", "score")


def _parser(samples: dict[str, str]) -> Parser:
    """One per Python worker: made from the sample (some 30 kB per language), not sent as a table."""
    key = hash(tuple(samples.items()))
    if key not in _made:
        _made.clear()
        _made[key] = Parser(samples)
    return _made[key]


def identify(docs: DataFrame, samples: dict[str, str] | None = None, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of docs with held_out, lang_pred and score added.

    Each language's sample becomes a suffix automaton. A text is parsed greedily into the longest phrases that occur in
    the sample; a phrase costs log2(sample size) bits, as a pointer would. The language with the fewest bits wins (ties to the
    first by name); score is 1 - bits / bits of the runner-up. Whole texts are parsed, a new phrase at each SEGMENT characters.

    ``und`` with score 0 where text is null or has no letter, or nothing could be learned. Very long texts are parsed
    in segments, so memory follows the batch. Repeated rows repeat; an empty table gives an empty result; input columns named
    like the added ones are replaced.
    """
    spark = docs.sparkSession
    samples = labelled_sample(docs, modulus, held_out) if samples is None else samples
    batches_of(spark, 500)
    plain = docs.drop(*VERDICT).withColumn("held_out", id_remainder("doc_id", modulus) == held_out)
    schema = plain.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            preds, scores = [], []
            lo = 0
            while lo < len(texts):  # as many texts at a time as hold PASS characters, or one
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= PASS):
                    n += len(texts[hi] or "")
                    hi += 1
                p, s = _decide(parser, [t or "" for t in texts[lo:hi]])
                preds += p
                scores += s
                lo = hi
            columns = [b.column(i) for i in range(b.num_columns)] + [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "lang_pred", "score"])

    return plain.mapInArrow(lean(run), ddl)


def _decide(parser: Parser, texts: list[str]) -> tuple[list[str], list[float]]:
    if not parser.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    phrases, _, has = parser.phrases(texts)
    bits = phrases * np.array(parser.bits)[:, None]
    best = bits.argmin(0)
    ordered = np.sort(bits, axis=0)
    score = 1 - ordered[0] / np.maximum(ordered[1], 1e-9) if len(parser.langs) > 1 else np.ones(len(texts))
    return [parser.langs[k] if h else "und" for k, h in zip(best, has, strict=True)], [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)]
