"""Parallel greedy pair cover equals the sequential rule (J9), plus pair discovery."""

import random

from langmix.operators import pairs as P


def _random_pairs(rnd, n_langs=9, n_pairs=25, hub="en"):
    langs = [hub] + [f"l{i}" for i in range(n_langs)]
    seen, out = set(), []
    while len(out) < n_pairs:
        a, b = rnd.sample(langs, 2)
        key = tuple(sorted((a, b)))
        if key not in seen:
            seen.add(key)
            out.append(key)
    return out


def test_greedy_cover_equals_sequential(spark):
    rnd = random.Random(11)
    for _ in range(3):
        pairs = _random_pairs(rnd)
        ranked = spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(pairs)], "l1 string, l2 string, rank int")
        got = sorted((r["l1"], r["l2"]) for r in P.greedy_pair_cover(ranked, "en").collect())
        rank = {p: i for i, p in enumerate(pairs)}
        ends = lambda p: {x for x in p if x != "en"}
        # no two taken pairs share an end but the hub, and every other pair meets a smaller taken one
        assert sum(len(ends(p)) for p in got) == len(set().union(*map(ends, got)))
        for p in pairs:
            assert p in got or any(ends(p) & ends(t) and rank[t] < rank[p] for t in got)


def test_cover_of_a_long_chain(spark):
    """Each round can take one pair only; all rounds run."""
    pairs = [(f"c{i:02d}", f"c{i + 1:02d}", i + 1) for i in range(12)]
    ranked = spark.createDataFrame(pairs, "l1 string, l2 string, rank int")
    assert sorted(r["rank"] for r in P.greedy_pair_cover(ranked, "en").collect()) == [1, 3, 5, 7, 9, 11]


def test_pair_product_and_uncovered(spark):
    rows = [(1, "en", "de"), (2, "de", "en"), (3, "fr", "es"), (4, "es", "it"), (5, "en", "fr")]
    df = spark.createDataFrame(rows, "pair_id long, a string, b string")
    prod = sorted((r["l1"], r["l2"], r["n_rows"]) for r in P.pair_product(df, "a", "b").collect())
    assert ("de", "en", 2) in prod and ("en", "de", 2) in prod and len(prod) == 8
    unc = [(r["l1"], r["l2"]) for r in P.pair_uncovered(df, "a", "b", "en").collect()]
    assert unc == [("es", "it")]


def test_doc_pairs_invariants(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de", ["eng", "deu"][i % 3 == 0], f"src{i % 4}") for i in range(301)]
    corpus = spark.createDataFrame(rows, "doc_id long, sentence string, data_lang string, language string, dataset string")
    for parts in (1, 7):
        p = P.doc_pairs(corpus.repartition(parts)).select("pair_id", "doc_id_a", "doc_id_b")
        assert sorted(map(tuple, p.collect())) == [(i, i, i + 1) for i in range(0, 300, 2)]
    more = P.doc_pairs(corpus.where("doc_id < 100")).select("pair_id", "doc_id_a", "doc_id_b")
    assert sorted(map(tuple, more.collect())) == [(i, i, i + 1) for i in range(0, 100, 2)]  # a larger corpus pairs alike
    assert all(r["language_a"] != r["language_b"] for r in P.two_languages(P.doc_pairs(corpus)).collect())
