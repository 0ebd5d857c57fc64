"""Detector: equal to the formula in plain Python however documents and grams are dealt; predictions are sane."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from langmix.operators import detect as D


def _docs(spark):
    rows = [
        (1, "eng", "the cat sat on the mat and the dog ran"),
        (2, "eng", "this is the house that jack built"),
        (3, "fra", "le chat est sur le tapis et le chien court"),
        (4, "fra", "voici la maison que jacques a construite"),
        (5, "deu", "die katze sitzt auf der matte und der hund"),
        (6, "deu", "das ist das haus das jack gebaut hat"),
    ]
    return spark.createDataFrame(rows, "doc_id long, language string, sentence string")


def _brute(train, texts, n):
    """Top-3 languages of each text by the smoothed n-gram formula."""
    grams = lambda t: Counter((p := " " + " ".join(t.split()).lower() + " ")[i:i + n] for i in range(max(0, len(" " + " ".join(t.split()).lower() + " ") - n + 1)))
    counts = {}
    for _, lang, t in train:
        counts.setdefault(lang, Counter()).update(grams(t))
    v = len(set().union(*counts.values()))
    out = []
    for t in texts:
        score = {x: sum(k * math.log((c[g] + 1) / (sum(c.values()) + v)) for g, k in grams(t).items()) for x, c in counts.items()}
        z = sum(math.exp(s - max(score.values())) for s in score.values())
        best = sorted(score, key=lambda x: (-score[x], x))[:3]
        out.append([(x, round(math.exp(score[x] - max(score.values())) / z, 9)) for x in best])
    return out


@pytest.mark.parametrize("most,hot,held", [(4 << 20, 10_000, 1_000_000), (60, 3, 50), (1, 10_000_000, 1)])
def test_equals_the_formula(spark, monkeypatch, most, hot, held):
    """Blocks of one document or of all, few or all grams salted, counts handed on at once or at the end."""
    monkeypatch.setattr(D, "BLOCK_BYTES", most)
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(D, "HELD", held)
    train = [tuple(r) for r in _docs(spark).collect()]
    rng = random.Random(1)
    words = " ".join(t for _, _, t in train).split() + ["zzz", "ÄÖ", "\U0001F600x", "\u0301"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(25)] + ["x", "the the the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    for n in (1, 3):
        model = D.fit_char_ngram(_docs(spark).repartition(2), "sentence", "language", n)
        got = {r["id"]: [(p["lang"], round(p["prob"], 9)) for p in r["top_preds"]] for r in model.transform(frame, "id", "t").collect()}
        assert [got[i] for i in range(len(texts))] == _brute(train, texts, n)


def test_orders_in_one_pass_and_odd_rows(spark):
    models = D.fit_char_ngram_multi(_docs(spark), "sentence", "language", (1, 2, 3, 5))
    rows = [("a", "the dog and the cat"), ("a", "le chien et le chat"), ("b", ""), ("c", None), (None, "der hund")]
    frame = spark.createDataFrame(rows, "id string, t string")
    every = sorted(map(str, D.detect_all(models, frame, "id", "t").collect()))
    each = []
    for n, m in models.items():
        each += map(str, m.transform(frame, "id", "t").select(F.lit(n).alias("n"), "id", "pred_lang", "pred_prob", "top_preds").collect())
    assert every == sorted(each) and len(every) == 4 * len(rows)
    null = [r for r in D.detect_all(models, frame, "id", "t").collect() if r["id"] == "c"]
    assert len(null) == 4 and all(r["pred_lang"] is None and r["top_preds"] is None for r in null)
    assert models[3].transform(frame.limit(0), "id", "t").collect() == []


def test_many_languages(spark):
    """A vector holds the languages of its gram alone."""
    rows = [(i, f"l{i:04d}", f"shared w{i} q{i * 7}") for i in range(1_600)]
    model = D.fit_char_ngram(spark.createDataFrame(rows, "doc_id long, language string, sentence string"), "sentence", "language", 3)
    out = model.transform(spark.createDataFrame(rows[::50], "doc_id long, language string, sentence string"), "doc_id", "sentence")
    assert {r["doc_id"]: r["pred_lang"] for r in out.collect()} == {r[0]: r[1] for r in rows[::50]}


def test_topk_probabilities(spark):
    docs = _docs(spark)
    model = D.fit_char_ngram(docs, "sentence", "language", 3)
    out = model.transform(docs, "doc_id", "sentence", k=3)
    for r in out.select("top_preds").collect():
        probs = [p["prob"] for p in r["top_preds"]]
        assert len(probs) == 3 and probs == sorted(probs, reverse=True) and abs(sum(probs) - 1) < 1e-9
    acc = out.join(docs, "doc_id").agg(F.avg((F.col("pred_lang") == F.col("language")).cast("double"))).first()[0]
    assert acc == 1.0


def test_multi_fit_equals_single_fits(spark):
    docs = _docs(spark)
    multi = D.fit_char_ngram_multi(docs, "sentence", "language", (1, 2, 3))
    for n in (1, 2, 3):
        single = D.fit_char_ngram(docs, "sentence", "language", n)
        assert multi[n].floors == single.floors and multi[n].vocab_size == single.vocab_size
        a = sorted(map(tuple, multi[n].grams.collect()))
        b = sorted(map(tuple, single.grams.collect()))
        assert a == b


def test_a_task_holds_a_megabyte_of_text(spark):
    """What a task works on at once does not grow with what it reads."""
    frame = spark.range(0, 30, 1, 1).select("id", F.repeat(F.lit("some words "), 10_000).alias("t"))
    rows = D._dealt(frame, "id", "t", [1, 2, 3])
    assert rows.where("grams is not null").count() >= 3 and rows.where("grams is null").count() == 30
