"""Filter audit, packing by least slack and periodic runs against brute force, and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancewise.llm import audit, queries, runs, slack, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""
    r = random.Random(3)
    long = " ".join(r.choice("a quick brown fox jumps over".split()) + str(r.randrange(50)) for _ in range(30_000))
    rows = [(1, None, None), (2, "", ""), (3, " \t", "s"), (4, "one", "s"), (4, "one", "s"), (5, "one", "t"), (None, "one", "t"), (None, None, None), (6, long, "s"), (7, long + " END#", "s"), (8, "x" * 50_000, "t")]
    rows += [(9, "É" * 10 + " ñandú x", "t"), (10, "ab " * 40_000, "t"), (11, "A B C d e" * 30, None), (12, "a\x0bb\x0cc\rd", "t"), (13, "<|endoftext|> ok", "t"), (-5, "one", "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, value in (("row", 1), ("key", 2), ("length", 3), ("word", "w"), ("part", "p"), ("mask", 4), ("digest", "d"), ("words", 5), ("runs", 6), ("g", 7), ("k", 8), ("n", 9), ("start", 1), ("deal", 2), ("good", 1)):
        table = table.withColumn(name, F.lit(value))
    return table


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


# 11 packing by least slack
def check_slack(rows, table):
    """Every id in one piece, pieces as the tokenizer gives them, sequences without gaps; the padding."""
    tok = tokens.encoder(slack.default_path()).tok
    texts = collections.Counter((x["doc_id"], x["text"] or "") for x in table.select("doc_id", "text").collect())
    ids = {(d, t): np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts}
    spans = collections.defaultdict(collections.Counter)
    bins = collections.defaultdict(list)
    for x in rows:
        spans[x["doc_id"], x["doc_tokens"]][x["start"], x["length"], x["ids_crc32"]] += 1
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    want = collections.Counter()
    for (d, t), n in texts.items():
        want[d, len(ids[d, t])] += n * len(ids[d, t])
    assert {k: sum(length * n for (_, length, _), n in v.items()) for k, v in spans.items()} == dict(want)
    for (d, t), n in texts.items():
        all_ids = ids[d, t]
        if sum(m for (e, u), m in texts.items() if e == d and len(ids[e, u]) == len(all_ids)) == n == 1:
            at = 0
            for start, length, crc in sorted(spans[d, len(all_ids)]):
                assert start == at and length > 0 and crc == zlib.crc32(all_ids[start : start + length].tobytes())
                at += length
            assert at == len(all_ids)
    padding = 0
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_least_slack_leaves_no_padding(docs, odd):
    for table in (docs, odd):
        assert check_slack(slack.pack_with_least_slack(table).collect(), table) == 0


def test_least_slack_of_an_empty_table_and_ids(docs, odd):
    assert slack.pack_with_least_slack(docs.limit(0)).count() == 0
    rows = slack.pack_with_least_slack(odd, capacity=64, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(x["ids"])) == x["ids_crc32"] and len(x["ids"]) == 4 * x["length"] for x in rows)


def brute_fill(stock, room):
    best = 0
    for counts in itertools.product(*[range(c + 1) for c in stock.values()]):
        total = sum(n * k for n, k in zip(stock, counts, strict=True))
        best = max(best, total if total <= room else 0)
    return best


def test_closest_fill_equals_all_multisets():
    r = random.Random(4)
    for _ in range(300):
        stock = {r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(0, 5))}
        room = r.randint(0, 90)
        fill = slack.closest_fill(stock, room)
        assert sum(n * k for n, k in fill.items()) == brute_fill(stock, room) and all(k <= stock[n] for n, k in fill.items())


@pytest.mark.parametrize("seed", range(6))
def test_slack_plan_places_every_token_once(seed):
    r = random.Random(seed)
    draw = [lambda: min(2048, max(1, int(r.lognormvariate(6, 1)))), lambda: r.randint(1000, 1100), lambda: r.choice((1500, 3)), lambda: 2048, lambda: 1, lambda: r.randint(1, 2048)][seed]
    histogram = dict(collections.Counter(draw() for _ in range(3000)))
    held, fill = collections.defaultdict(list), collections.defaultdict(list)
    for n, lo, hi, begin, part, first, offset in slack.plan(histogram):
        for k in range(lo, hi):
            held[n, k].append((begin, part))
            fill[first + k - lo].append((offset, part))
    assert set(held) == {(n, k) for n, c in histogram.items() for k in range(c)}
    for (n, _), spans in held.items():
        spans.sort()
        assert [b for b, _ in spans] == [0, *itertools.accumulate(p for _, p in spans)][:-1] and sum(p for _, p in spans) == n
    for spans in fill.values():
        spans.sort()
        total = sum(p for _, p in spans)
        assert [o for o, _ in spans] == [0, *itertools.accumulate(p for _, p in spans)][:-1] and (total == 2048 or total & (total - 1) == 0)


def test_plans_do_not_grow_with_the_corpus():
    r = random.Random(1)
    some = dict(collections.Counter(min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(100_000)))
    small, large = (slack.plan({n: c * k for n, c in some.items()}) for k in (1, 100_000))
    assert len(large) < 3 * len(small)


def test_byte_encoder_equals_the_tokenizer():
    enc = tokens.encoder(slack.default_path())
    assert isinstance(enc, tokens.ByteEncoder)
    r = random.Random(2)
    letters = "aAbBéÉçßİΣσς'’\"“.,;:!-_=+*&# \n\t\r\x0b\x85\xa0 　̧́ 01234漢字한국ﬁ🙂\x1cstremdl     " * 2
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(5000)] + ["a<|endoftext|>b", "", " ", "  ", "\n", "a \n", " 's it's  ok\n\n x", "a" * 100, " " * 99 + "b"]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(texts)] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


# 12 filter audit
def brute_audit(docs, labels):
    good = {x["doc_id"] for x in labels if x["quality"] == 1 and x["doc_id"] is not None}
    bad = {x["doc_id"] for x in labels if x["toxic"] == 1 and x["doc_id"] is not None}
    least, rows = {}, collections.defaultdict(list)
    for x in docs:
        if x["doc_id"] is not None:
            least[x["text"] or ""] = min(x["doc_id"], least.get(x["text"] or "", x["doc_id"]))
    for x in docs:
        t = x["text"] or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": x["doc_id"] is not None and x["doc_id"] > least[t]}
        rows[x["source"] or ""].append(({k for k, v in fails.items() if v}, x["doc_id"] in good, x["doc_id"] in bad))
    out = {}
    for part, held in rows.items():
        removed_by, unique = collections.Counter(), {k: sum(f == {k} for f, _, _ in held) for k in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = held
            for step, k in enumerate(order, 1):
                gone = [x for x in alive if k in x[0]]
                alive = [x for x in alive if k not in x[0]]
                removed_by[k] += len(gone)
                all_failing = sum(k in f for f, _, _ in held)
                out[part, order, step] = [len(alive), len(gone), all_failing - len(gone), unique[k], sum(x[1] for x in gone), sum(x[2] for x in gone), k]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = removed_by[v[-1]]
    return out


def test_audit_equals_brute_force(spark, docs, odd, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    strange = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, 1), (10, 1, None), (-5, 1, 0)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    for table, marks in ((docs, labels), (odd, strange), (docs, labels.limit(0))):
        got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in columns] for x in audit.filter_interactions(table, marks).collect()}
        assert got == brute_audit(table.collect(), marks.collect())
    assert audit.filter_interactions(docs.limit(0), labels).count() == 0


def test_audit_words_take_one_shuffle_of_the_texts(spark, docs):
    frame = audit.word_totals(docs.select(F.col("doc_id").alias("row"), "text"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION" in plan


# 13 periodic runs
def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(6, 4 * p) and i > s and not any(w[s : i + p - q] == w[s + q : i + p] for q in range(1, p)):
                out.append((s, i + p - s, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *rest, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_equal_brute_force():
    r = random.Random(5)
    texts = []
    for n in range(600):
        kind, size = n % 4, r.randint(0, 90)
        w = [r.choice("abc"[: 2 + n % 2]) for _ in range(size)] if kind < 2 else []
        while kind == 2 and len(w) < size:
            w += [r.choice("abcd") for _ in range(r.randint(1, 5))] * r.randint(1, 7)
        texts.append(w if kind < 3 else ["a" if r.random() > 0.05 else "b" for _ in range(size)])
    got = list(runs.search([" ".join(w).encode() for w in texts]))
    assert [x for _, x in got] == [brute_runs(w) for w in texts]


def test_runs_of_strings_of_many_collisions():
    """Thue-Morse words hash alike modulo 2^64 without being equal; they hold no run, also between runs."""
    morse = ["ab"[bin(i).count("1") % 2] for i in range(1 << 13)]
    text = ["x"] * 9 + morse + ["y", "z"] * 8 + morse[::-1] * 4
    (_, got), = runs.search([" ".join(text).encode()])
    n = len(morse)
    assert [g for g in got if g[2] < n] == [(0, 9, 1), (9 + n, 16, 2)]
    for s, length, p in got:
        assert text[s : s + length - p] == text[s + p : s + length] and length >= 4 * p
        assert (s == 0 or text[s - 1] != text[s - 1 + p]) and (s + length == len(text) or text[s + length] != text[s + length - p])
    assert [g[2] for g in got].count(n) == 1


def test_runs_of_very_long_texts_take_time_in_proportion():
    r = random.Random(7)
    for w in (["a"] * 500_000, [r.choice("ab") for _ in range(200_000)], [str(i % 777) for i in range(500_000)], ["a" if r.random() > 0.001 else "b" for _ in range(300_000)]):
        (_, got), = runs.search([" ".join(w).encode()])
        for s, length, p in got:
            assert w[s : s + length - p] == w[s + p : s + length]


def test_periodic_runs_query_equals_brute_force(spark, small, docs):
    rows = {x["doc_id"]: tuple(x) for x in queries.op13_periodic_runs(spark, small).collect()}
    assert rows == {x["doc_id"]: brute_digest(x["doc_id"], x["text"]) for x in docs.collect()}
    assert sum(x[1] for x in rows.values()) > 5


def test_periodic_runs_odd_rows(spark, odd, docs):
    short = odd.filter("doc_id IS NULL OR doc_id NOT IN (6, 7, 10)")
    got = runs.run_digests(runs.periodic_runs(runs.planted(short))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_digest(x["doc_id"], x["text"]) for x in short.collect()), key=repr)
    (long,) = runs.periodic_runs(odd.filter("doc_id = 10")).collect()
    assert [tuple(x) for x in long["runs"]] == [(0, 40_000, 1)] and long["collapsed"] == "ab"
    assert runs.periodic_runs(docs.limit(0)).count() == 0
