"""Coherence counts by brute force; bands, histograms and sheets on small rows."""

import random

from pyspark.sql import functions as F

from stancewise.operators import agreement, topics


def test_window_counts_by_brute_force(spark):
    g = random.Random(1)
    texts = [[g.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 4, 5, 6, 23, 5000)] + [None]
    words, width = ["a", "b", "c"], 5
    want = {(-1, -1): 0}
    for t in texts:
        t = t or []
        for i in range(max(len(t) - width + 1, 1)):
            held = sorted({words.index(w) for w in t[i : i + width] if w in words})
            want[-1, -1] += 1
            for x in held:
                for y in held:
                    if x <= y:
                        want[x, y] = want.get((x, y), 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(3)
    assert {(r["a"], r["b"]): r["n"] for r in topics.window_counts(df, words, width=width).collect()} == want


def test_coherence_prefers_words_that_meet(spark):
    df = spark.createDataFrame([(["a", "b", "x"],), (["a", "b", "y"],), (["c", "x"],), (["d", "y"],), (["z"],)] * 10, "tokens array<string>")
    together, apart = topics.coherence(df, [["a", "b"], ["c", "d"]])
    assert together > 0.99 and together > apart


def test_vocabulary_bounds(spark):
    df = spark.createDataFrame([(["all", "one" if i == 0 else "few", "few"],) for i in range(10)] + [([],)], "tokens array<string>")
    assert {r["word"] for r in topics.vocabulary(df, least=2, share=0.95).collect()} == {"all", "few"}
    assert topics.vocabulary(df, least=2, share=0.9).filter("word = 'all'").count() == 0


def test_bands_are_half_open(spark):
    df = spark.createDataFrame([(0.0, True), (0.5, False), (0.5, True), (1.0, True), (None, True)], "s double, f boolean")
    got = {(r["lo"], r["hi"]): (r["n"], r["n_hit"]) for r in agreement.band_rates(df, "s", "f", [0.0, 0.5, 1.0]).collect()}
    assert got == {(0.0, 0.5): (1, 1), (0.5, 1.0): (2, 1)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(11)] + [("one", 3.0), ("one", 3.0), (None, 1.0), ("a", None)], "g string, x double")
    got = {(r["g"], r["bin"]): r["n"] for r in agreement.histogram(df, "g", "x", 5).collect()}
    assert got == {("a", 0): 2, ("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): 3, ("one", 0): 2, (None, 0): 1}


def test_label_sheet_is_blind(spark):
    df = spark.createDataFrame([(i, f"t{i}", 1) for i in range(5)], "id long, text string, model int")
    sheet = agreement.label_sheet(df, "id", "text")
    assert sheet.columns == ["item_no", "text", "score", "notes"]
    assert [r["item_no"] for r in sheet.orderBy("item_no").collect()] == [1, 2, 3, 4, 5] and sheet.filter(F.col("score").isNotNull()).count() == 0


def test_counts_of_many_models_take_one_pass(spark):
    """Pairs of one topic only, equal to those of all pairs; coherence of two models at once equals each on its own."""
    g = random.Random(2)
    df = spark.createDataFrame([([g.choice("abcdefgh") for _ in range(g.randint(0, 40))],) for _ in range(60)], "tokens array<string>")
    words, lists = list("abcdef"), [["a", "b", "c"], ["c", "d"], ["f"]]
    every = {(r["a"], r["b"]): r["n"] for r in topics.window_counts(df, words, width=7).collect()}
    some = {(r["a"], r["b"]): r["n"] for r in topics.window_counts(df, words, width=7, topics=lists).collect()}
    asked = {(-1, -1)} | {tuple(sorted((words.index(x), words.index(y)))) for t in lists for x in t for y in t}
    assert some == {k: n for k, n in every.items() if k in asked}
    one, two = [["a", "b", "c"], ["d", "e"]], [["a", "d"], ["b", "e", "f"]]
    assert topics.coherence(df, one + two) == topics.coherence(df, one) + topics.coherence(df, two)


def planted(spark, n=160):
    """Paragraphs of one of two vocabularies: money words (those of even ids) and garden words."""
    g = random.Random(3)
    money, garden = [f"money{i}" for i in range(12)], [f"garden{i}" for i in range(12)]
    rows = [(i, "p" if i % 4 < 2 else "q", i % 8 == 0, [g.choice(garden if i % 2 else money) for _ in range(30)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, president string, is_fiscal boolean, tokens array<string>").repartition(2)


def test_planted_topics_are_found(spark):
    """I2, I3, I4, B7: each topic's words are of one vocabulary; a paragraph's topic probability tells its vocabulary; flags follow it."""
    paras = planted(spark)
    bag = topics.vectorizer(topics.vocabulary(paras))
    bags = bag.transform(paras)
    model = topics.train(bags, 2)
    lists = {}
    for r in topics.top_words(model, bag.vocabulary, 10).collect():
        lists.setdefault(r["topic"], []).append(r["word"])
    kinds = {t: {w.rstrip("0123456789") for w in ws} for t, ws in lists.items()}
    assert sorted(map(sorted, kinds.values())) == [["garden"], ["money"]]
    (money,) = (t for t, k in kinds.items() if k == {"money"})
    rows = topics.with_topics(model, bags, {"fiscal_topic_prob": [money], "ideology_topic_prob": []}).collect()
    assert all((r["fiscal_topic_prob"] > 0.9) == (r["id"] % 2 == 0) and (r["fiscal_topic_prob"] >= 0.25) == (r["id"] % 2 == 0) and r["ideology_topic_prob"] == 0.0 for r in rows)
    assert all(abs(sum(r["topics"]) - 1) < 1e-6 for r in rows)


def test_overlap_of_planted_topic_and_keyword(spark):
    """E19: of each group, paragraphs that both flags pick, either alone, and the share above the topic threshold."""
    paras = planted(spark)
    bag = topics.vectorizer(topics.vocabulary(paras))
    bags = bag.transform(paras)
    model = topics.train(bags, 2)
    money = next(r["topic"] for r in topics.top_words(model, bag.vocabulary, 1).collect() if r["word"].startswith("money"))
    rows = topics.with_topics(model, bags, {"fiscal_topic_prob": [money]})
    got = {r["president"]: (r["both"], r["only_keyword"], r["only_topic"], r["share"]) for r in topics.overlap(rows).collect()}
    assert got == {"p": (20, 0, 20, 0.5), "q": (0, 0, 40, 0.5)}


def test_models_side_by_side_and_texts_settled_in_blocks(spark):
    """Models of one group have their own sizes; a text settled in blocks is as it is settled alone."""
    import numpy as np
    import pyarrow as pa

    from stancewise.operators import variational

    paras = planted(spark)
    bags = topics.vectorizer(topics.vocabulary(paras)).transform(paras).select("bag")
    models = variational.train(bags, [2, 3, 5, 4], passes=4, at_once=1)
    assert [m.weights.shape for m in models] == [(24, k) for k in (2, 3, 5, 4)] and all((m.prior > 0).all() for m in models)
    g = np.random.default_rng(5)
    beta, prior = g.dirichlet(np.ones(24), 3).T.copy(), np.array([0.2, 0.3, 0.5])
    ids = [sorted(g.choice(24, n, replace=False).tolist()) for n in (0, 1, 5, 24, 3, 12)]
    counts = [g.integers(1, 6, len(x)).astype(float).tolist() for x in ids]
    texts = variational.Texts(pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float64())))
    start = np.random.default_rng(7).gamma(100, 0.01, (6, 3))
    got = variational.settle(beta, prior, texts, list(texts.blocks(np.arange(6), 30)), np.random.default_rng(7))
    for i in range(1, 6):
        gamma, b, moved = start[i], beta[ids[i]], 1.0
        while moved > 1e-3:
            theta = np.exp(variational.expected(gamma[None]))[0]
            new = theta * (np.array(counts[i], np.float32) / (b @ theta) @ b) + prior
            gamma, moved = new, np.abs(new - gamma).mean()
        assert np.allclose(got[i], gamma, atol=1e-6)
    assert abs(float(variational.digamma(np.array(1.0))) + 0.5772156649) < 1e-8 and abs(float(variational.trigamma(np.array(1.0))) - np.pi**2 / 6) < 1e-7


def test_grid_of_planted_topics(spark):
    paras = planted(spark, 80)
    bag = topics.vectorizer(topics.vocabulary(paras))
    got = {r["k"]: (r["coherence"], r["best"]) for r in topics.grid(bag.transform(paras), bag.vocabulary, [2, 3], passes=5, at_once=2).collect()}
    assert set(got) == {2, 3} and sum(b for _, b in got.values()) == 1


def test_seed_similarity_in_blocks(spark):
    import numpy as np

    from stancewise.operators import similarity

    g = np.random.default_rng(1)
    rows = [(i, i % 3, g.normal(size=6).tolist()) for i in range(300)] + [(900, 1, None), (901, 1, [0.0] * 6), (902, 1, [1.0, None] * 3), (903, 1, [1.0, 2.0]), (904, 1, [float("nan")] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    seeds = table.filter("vec_id < 150 OR vec_id >= 900")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows[:300]}
    want = {i: max(float(unit[i] @ unit[j]) for j in range(150)) for i in range(300)}
    for most in (1 << 20, 48 * 40):
        got = {r["vec_id"]: r["similarity"] for r in similarity.seed_similarity(table, seeds, most).collect()}
        assert len(got) == 305 and all(abs(got[i] - want[i]) < 1e-9 for i in want) and all(got[i] is None for i in range(900, 905))
    assert all(r["similarity"] is None for r in similarity.seed_similarity(table, seeds.limit(0)).collect())


def test_bags_of_the_topic_queries_are_written_once(spark, small):
    """Steps and scores start from written bags, not from the documents."""
    from stancewise.jobs import registry

    _, bags, _ = registry._topic_model(spark, small, 2)
    assert bags.inputFiles() and not any("documents" in f for f in bags.inputFiles())


def test_slow_texts_go_on_together(monkeypatch):
    """a block does not go on for the one slow text in it; slow texts go on in blocks of their own, and sums by word hold each entry once."""
    import numpy as np
    import pyarrow as pa

    from stancewise.operators import variational

    g = np.random.default_rng(9)
    beta, prior = np.vstack([np.repeat(np.eye(4), 50, axis=0) + 1e-6, g.gamma(100, 0.01, (200, 4))]), np.full(4, 0.05)
    ids = [(200 + g.choice(200, 30, replace=False) if i % 10 == 0 else i % 4 * 50 + g.choice(50, 30, replace=False)).tolist() for i in range(1000)] + [[]]
    counts = [g.integers(1, 4, len(x)).astype(float).tolist() for x in ids]
    texts = variational.Texts(pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float64())))
    calls, given = [], variational.ratios
    monkeypatch.setattr(variational, "ratios", lambda near, counts, theta: calls.append(len(theta)) or given(near, counts, theta))
    small = list(texts.blocks(np.arange(len(ids)), 300))
    gamma = variational.settle(beta, prior, texts, small, np.random.default_rng(3))
    assert len(small) == 100 and len(calls) < 40 * len(small)
    for i in range(1000):
        theta = np.exp(variational.expected(gamma[i][None]))[0]
        assert np.abs(theta * (counts[i] / (beta[ids[i]] @ theta) @ beta[ids[i]]) + prior - gamma[i]).mean() <= variational.CLOSE
    theta, want, found, by_word = g.random((len(ids), 4)), np.zeros((400, 4)), np.zeros((400, 4)), variational.Words(small)
    for i in range(1000):
        want[ids[i]] += np.outer(counts[i], theta[i])
    found[by_word.own] = by_word.sums([c for _, _, c in small], theta)
    assert np.allclose(found, want)
    x = np.array([0.02, 0.5, 1, 3, 40, 1e5])
    assert np.allclose(variational.exp_digamma(x), np.exp(variational.digamma(x)), rtol=3e-8, atol=0)


def test_sizes_are_dealt_evenly():
    """groups of like work, none above TOPICS unless a model alone is; models come back in the order asked."""
    from stancewise.operators import variational

    dealt = variational.groups(list(range(8, 31)))
    assert sorted(k for g in dealt for k in g) == list(range(8, 31)) and len(dealt) == 4
    assert max(map(sum, dealt)) <= variational.TOPICS and max(map(sum, dealt)) < 1.3 * min(map(sum, dealt))
    assert variational.groups([300, 2]) == [[300], [2]] and variational.groups([5]) == [[5]]
