"""Classifiers over blocks: equal to plain numpy however rows are dealt, warm starts, many labels, the adapter's gradients."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from langmix.operators import blocks as B
from langmix.operators import learn as L


def _rows(n=60):
    rng = random.Random(3)
    words = {"x": "red fish dog".split(), "y": "blue sea sky".split(), "z": "tree leaf".split()}
    return [(i, " ".join(rng.choice(words[lab] + ["and", "the"]) for _ in range(rng.randint(1, 9))), lab) for i in range(n) for lab in [rng.choice("xyz")]]


def _plain(rows, n, buckets, steps, regs, kind="softmax"):
    """Weights by the formula, on dense matrices."""
    classes = sorted({r[2] for r in rows})
    grams = []
    for _, t, _ in rows:
        w = t.lower().split()
        grams.append([L.ALWAYS] + w + [" ".join(w[i:i + k]) for k in range(2, n + 1) for i in range(len(w) - k + 1)])
    x = np.zeros((len(rows), buckets))
    for i, g in enumerate(grams):
        for f in B.hashed(g, buckets):
            x[i, f] += 1 / len(g)
    y = np.array([[r[2] == c for c in classes] for r in rows], float)
    m = x.sum(axis=0)
    out = []
    for reg in regs:
        w = np.zeros((buckets, len(classes)))
        for _ in range(steps):
            p = L._probabilities((x @ w)[:, None, :], kind)[:, 0]
            w -= L.STEPS[kind] * (np.divide(x.T @ (p - y), m[:, None], out=np.zeros_like(w), where=m[:, None] > 0) + reg * w)
        out.append((x, w))
    return out


@pytest.mark.parametrize("rows_of_block", [2_000, 7])
def test_fit_equals_numpy(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(B, "BLOCK_ROWS", rows_of_block)
    rows = _rows()
    df = spark.createDataFrame(rows, "i int, t string, y string").repartition(3)
    blocks = L.word_ngram_blocks(df, "t", "y", 2, 32, 2)
    model = L.descend(L.start(blocks, "softmax", [0.0, 0.05]), blocks, 4)
    want = _plain(rows, 2, 32, 4, [0.0, 0.05])
    got = {r["f"]: np.frombuffer(r["w"]).reshape(2, 3) for r in model.weights.collect()}
    for k, (x, w) in enumerate(want):
        for f in np.flatnonzero(x.sum(axis=0)):
            assert np.allclose(got[f][k], w[f], atol=1e-9)
    assert len(got) == (want[0][0].sum(axis=0) > 0).sum()


def test_later_steps_go_on_from_earlier_ones(spark):
    df = spark.createDataFrame(_rows(), "i int, t string, y string")
    blocks = L.word_ngram_blocks(df, "t", "y", 1, 64)
    whole = L.descend(L.start(blocks, "softmax"), blocks, 4)
    parts = L.descend(L.descend(L.start(blocks, "softmax"), blocks, 1), blocks, 3)
    a, b = ({r["f"]: r["w"] for r in m.weights.collect()} for m in (whole, parts))
    assert parts.steps == 4 and a.keys() == b.keys() and all(np.allclose(np.frombuffer(a[f]), np.frombuffer(b[f])) for f in a)


def test_loss_never_rises(spark):
    rows = _rows(40)
    losses = []
    for steps in (0, 1, 2, 5, 12):
        x, w = _plain(rows, 1, 16, steps, [0.0])[0]
        p = L._probabilities((x @ w)[:, None, :], "softmax")[:, 0]
        losses.append(-np.log([p[i, "xyz".index(r[2])] for i, r in enumerate(rows)]).mean())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.7 * losses[0]


def test_odd_rows_and_top_k(spark):
    train = spark.createDataFrame(_rows(), "i int, t string, y string").unionByName(spark.createDataFrame([(90, None, "x"), (91, "red", None), (92, "", "y")], "i int, t string, y string"))
    model = L.fit_word_ngram(train, "t", "y", n=2, buckets=256, max_iter=6)
    out = {r["i"]: r for r in model.transform(train, "i", "t").collect()}
    assert len(out) == 63 and all(len(r["top_preds"]) == 3 and abs(sum(p["prob"] for p in r["top_preds"]) - 1) < 1e-9 for r in out.values())
    assert out[91]["pred_lang"] == "x"
    assert model.transform(train.limit(0), "i", "t").collect() == []


def test_sixteen_hundred_labels(spark):
    """Weights stay in rows by feature; a block holds as many features as its share of cells allows."""
    rows = [(i, f"w{i} shared", f"l{i:04d}") for i in range(1_600)]
    df = spark.createDataFrame(rows, "i int, t string, y string").repartition(2)
    model = L.fit_word_ngram(df, "t", "y", n=1, buckets=1 << 18, max_iter=2)
    out = model.transform(df.where("i % 40 = 0"), "i", "t", k=1).collect()
    assert all(r["pred_lang"] == f"l{r['i']:04d}" for r in out) and len(out) == 40


def test_early_stop_keeps_the_best(spark):
    df = spark.createDataFrame(_rows(), "i int, t string, y string")
    model, log = L.fit_with_early_stop(df, df, "t", "y", n=1, block=2, total=6, buckets=64)
    assert [r["max_iter"] for r in log] == [2, 4, 6][:len(log)] and not log[-1]["improved"] or len(log) == 3
    best = max(r["dev_accuracy"] for r in log)
    pred = df.join(model.transform(df, "i", "t"), "i")
    assert abs(L.precision_at_1(pred, "y") - best) < 1e-3


def test_multilabel_in_one_fit(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(x for a in labs for x in [f"{a}word"] * 3), sorted(labs)) for i in range(80) for labs in [rng.sample(["A", "B", "C"], rng.randint(1, 2))]]
    df = spark.createDataFrame(rows, "i int, t string, y array<string>")
    model = L.fit_multilabel(df, "t", "y", ["A", "B", "C"], max_iter=25, buckets=512)
    got = {r["i"]: r["predicted"] for r in L.predict_multilabel(model, df, "i", "t", threshold=0.5, buckets=512).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 76


def test_adapter_gradients_and_loss(spark):
    rng = np.random.default_rng(0)
    model = L.Adapter.new(["A", "B"], 5)
    e, dh = rng.normal(size=(4, 5)), rng.normal(size=(4, 5))
    grad = model.backward(e, model.forward(e)[1], dh)
    at = 0
    for part in model.parts()[:4]:
        for i in np.ndindex(part.shape):
            part[i] += 1e-6
            up = (model.forward(e)[0] * dh).sum()
            part[i] -= 2e-6
            down = (model.forward(e)[0] * dh).sum()
            part[i] += 1e-6
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-4
            at += 1
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(8)], "id long, embedding array<float>")
    rows = [(i, [(int(i % 4), 0.5), (int(4 + i % 4), 0.5)], ["A"] if i % 4 < 2 else ["B"]) for i in range(24)] + [(30, None, ["A"])]
    df = spark.createDataFrame(rows, "i int, features array<struct<f: long, x: double>>, labels array<string>")
    fitted, losses = L.fit_adapter(df, "labels", ["A", "B"], vectors, max_iter=12, rate=0.1)
    assert losses[-1] < 0.5 * losses[0]
    got = {r["i"]: r["predicted"] for r in L.predict_adapter(fitted, df, "i", vectors, 0.5, 1).collect()}
    assert sum(got[i] == y for i, _, y in rows[:24]) >= 22 and 30 in got
