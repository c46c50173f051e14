"""Order statistics of large groups against numpy and pandas; the term index against regular expressions."""

import random
import re
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from stancewise.functions.config import FIXTURE
from stancewise.functions.patterns import cue_pattern, term_pattern
from stancewise.functions.terms import TermIndex
from stancewise.operators import index, quantiles


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else r.choice("ab") + str(i % 4), r.choice((float(r.randint(0, 9)), r.gauss(0, 1)))) for i in range(4000)]
    rows += [("hot", 5.0)] * 1500 + [("one", 7.0), ("two", 1.0), ("two", 4.0), (None, 2.0), (None, 3.0), ("hot", None), ("none", None), ("nan", float("nan"))]
    return spark.createDataFrame(rows, "g string, x double").repartition(6), rows


def test_quantiles_equal_numpy(values):
    table, rows = values
    groups = {}
    for g, x in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    got = {r["g"]: (r["a"], r["b"], r["c"], r["d"]) for r in quantiles.exact_quantiles(table, ["g"], "x", {"a": 0.025, "b": 0.5, "c": 0.975, "d": 1.0}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(xs, (0.025, 0.5, 0.975, 1.0)))), g
    (one,) = quantiles.exact_quantiles(table, [], "x", {"q": 0.25}).collect()
    assert one["q"] == pytest.approx(np.quantile([x for xs in groups.values() for x in xs], 0.25))
    (none,) = quantiles.exact_quantiles(table.limit(0), [], "x", {"q": 0.25}).collect()
    assert none["q"] is None


def test_rank_correlation_equals_pandas(spark):
    r = random.Random(4)
    rows = [(float(r.randint(0, 30)), r.gauss(0, 1) if i % 2 else 0.5) for i in range(3000)] + [(None, 1.0), (1.0, None), (float("nan"), 2.0)]
    (got,) = quantiles.rank_correlation(spark.createDataFrame(rows, "a double, b double").repartition(5), "a", "b").collect()
    frame = pd.DataFrame(rows, columns=["a", "b"]).dropna()
    assert got["n"] == len(frame) and got["pearson"] == pytest.approx(frame.a.corr(frame.b)) and got["spearman"] == pytest.approx(frame.a.rank().corr(frame.b.rank()))
    (same,) = quantiles.rank_correlation(spark.createDataFrame([(1.0, 2.0)] * 3, "a double, b double"), "a", "b").collect()
    assert (same["n"], same["pearson"], same["spearman"]) == (3, None, None)


def test_no_task_sorts_all_values(spark, values):
    """The only window that meets in one task is over a row per range; the other is over a range."""
    table, _ = values
    plan = quantiles.value_places(table, ["g"], "x")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("__part" in line for line in windows)
    alone = [plan.split("\n")[i + 1] for i, line in enumerate(plan.split("\n")) if "SinglePartition" in line]
    assert all("functions=[sum(n" in line and "keys=[__part" in line for line in alone)


def test_winsorising_rows_equals_winsorising_months(values):
    table, _ = values
    rows = table.filter("x IS NOT NULL AND NOT isnan(x)")
    one, two = (sorted(map(tuple, index.standardised(rows, {"x": ("w", "z", "zr")}, months=m).select("x", "w", "z", "zr").collect())) for m in (True, False))
    assert np.array(one) == pytest.approx(np.array(two))


def by_expressions(text, lexicon):
    strong, gated, weak = (re.compile(cue_pattern(c), re.A) for c in (lexicon.strong, lexicon.gated, lexicon.weak))
    out = []
    for direction, terms in (("pos", lexicon.positive), ("neg", lexicon.negative)):
        for term in terms:
            for m in re.finditer(term_pattern(term), text, re.A):
                words = text[: m.start()].split()
                far, near = " ".join(words[-lexicon.strong_window :]), " ".join(words[-lexicon.weak_window :])
                out.append((direction, term, bool(strong.search(far) or (direction == "neg" and gated.search(far)) or weak.search(near))))
    return sorted(out)


def test_term_index_equals_regular_expressions():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab") for _ in range(r.randint(1, n)))
    found = 0
    for _ in range(1500):
        lexicon = replace(
            FIXTURE, positive=tuple({" ".join(word(3) for _ in range(r.randint(1, 3))) for _ in range(4)}), negative=tuple({" ".join(word(5) for _ in range(r.randint(1, 2))) for _ in range(4)}),
            strong=("aab", "b a"), weak=("ba",), gated=("abb*",),
        )
        text = " ".join(word(5) for _ in range(r.randint(0, 30)))
        got = sorted(TermIndex(lexicon).matches(text))
        assert got == by_expressions(text, lexicon)
        found += len(got)
    assert found > 20_000
    assert TermIndex(replace(FIXTURE, positive=("no hay plata",), negative=())).matches("no hay platano hay plata") == [("pos", "no hay plata", False)]


def test_term_index_forgets_and_takes_thousands_of_terms(monkeypatch):
    from stancewise.functions import terms

    monkeypatch.setattr(terms, "REMEMBERED", 50)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    lexicon = replace(FIXTURE, positive=tuple({f"{word()} {word()}" for _ in range(2000)}), negative=tuple({word() for _ in range(1000)}))
    known = TermIndex(lexicon)
    text = " ".join(word() for _ in range(400))
    assert sorted(known.matches(text)) == by_expressions(text, lexicon) and len(known.known) <= 50


def test_memory_of_words_is_bounded():
    """100,000 words, each once: the memory of an index stays within a few megabytes, and matches are found as before."""
    import itertools
    import tracemalloc

    from stancewise.functions.config import FIXTURE
    from stancewise.functions.terms import TermIndex

    index = TermIndex(FIXTURE)
    tracemalloc.start()
    for word in map("".join, itertools.islice(itertools.product("abcdefghij", repeat=5), 100_000)):
        index.matches(word)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 8e6
    assert index.matches("nation the") == [("pos", "tion the", False)]


def test_memory_of_long_words_is_bounded():
    """200 words of 10,000 letters, each once: an index holds none of them, and finds terms inside them each time."""
    import itertools

    index = TermIndex(FIXTURE)
    for start in map("".join, itertools.islice(itertools.product("abcdefghij", repeat=3), 200)):
        index.matches(start + "x" * 9_997)
    assert sum(map(len, index.known)) < 10_000
    text = "z" * 9_000 + "nation thereof no " + "z" * 65 + "ble the"
    assert index.matches(text) == index.matches(text) == [("pos", "tion the", False), ("neg", "ble the", True)]
    assert sorted(index.matches(text)) == by_expressions(text, FIXTURE)
