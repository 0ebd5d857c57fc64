import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from langmix.llm import quality_gbt, quality_knn
from langmix.sources.tables import table
from tests.conftest import SF_MID
from tests.llm import data

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def mid(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    return docs, labels, {r.doc_id: r.quality for r in labels.collect()}


def test_knn_held_out(spark, mid):
    docs, labels, truth = mid
    got = quality_knn.classify(docs, quality_knn.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 50 and np.mean([p == y for p, y in test]) > 0.9


def test_knn_never_sees_held_out_labels(spark, mid):
    docs, labels, _ = mid
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) quality", "toxic")
    a, b = quality_knn.fit(docs, labels), quality_knn.fit(docs, flipped)
    assert (a.labels == b.labels).all() and np.array_equal(a.vectors, b.vectors)


def test_knn_scores_equal_brute_force(mid):
    docs, labels, truth = mid
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id in truth]
    terms = [quality_knn.text_terms(r.text) for r in rows]
    model = quality_knn.LatentModel(terms[:150], [truth[r.doc_id] for r in rows[:150]])
    for t, s in zip(terms[150:], model.scores(terms[150:])):
        v = model.vector(*t)
        cos = model.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cos, kind="stable")[:quality_knn.VOTERS]
        w = np.maximum(cos[near], 0) ** 4
        assert abs(s - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_knn_awkward(spark, mid):
    _, labels, _ = mid
    docs = data.table(spark)
    more = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, 0, 0), (None, 1, 0), (3, None, 0), (200, 0, 0), (10 ** 6, 1, 1)], LABELS)
    for lab in (more, more.where("quality > 5"), more.where("quality = 1")):
        got = quality_knn.classify(docs, quality_knn.fit(docs, lab)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and np.isfinite(r.score) for r in got)
    empty = data.table(spark, [])
    assert quality_knn.classify(empty, quality_knn.fit(empty, more)).collect() == []


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i:i + 3])].append(i)
    cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dups = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dups += x in lines
            lines.add(x)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_base_rules(spark, mid):
    docs, labels, _ = mid
    model = quality_gbt.fit(docs, labels)
    rows = data.awkward() + [(500, "a b c d " * 40 + "\nx y\nx y\nx y", "en", "s", 0) + ("c",) * len(data.CLASHES)]
    got = quality_gbt.judge(data.table(spark, rows), model).collect()
    want = Counter((r[0], *brute_base(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_gbt.judge(data.table(spark, []), model).collect() == []


def test_trees_held_out(spark, mid):
    docs, labels, truth = mid
    got = quality_gbt.judge(docs, quality_gbt.fit(docs, labels)).collect()
    test = [(r.score >= 0.5, truth[r.doc_id] == 1) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([p == y for p, y in test]) > 0.9


def test_trees_without_labels(spark):
    docs = data.table(spark)
    for rows in ([], [(1, 1, 0), (2, 1, 0)]):
        model = quality_gbt.fit(docs, spark.createDataFrame(rows, LABELS))
        assert len(model.leaf) == 0 and quality_gbt.judge(docs, model).count() == docs.count()


def test_trees_are_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((3_000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + 0.6 * rng.standard_normal(3_000)) > 0).astype(float)
    model = quality_gbt.train(x, y, [1, -1, 0], trees=30)
    grid = np.linspace(0, 1, 50)
    for f, sign in ((0, 1), (1, -1)):
        for base in rng.random((40, 3)):
            probe = np.repeat(base[None], 50, 0)
            probe[:, f] = grid
            assert (sign * np.diff(model.margin(probe)) >= -1e-12).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.random((500, 4))
    model = quality_gbt.train(x, (x[:, 0] * x[:, 1] > 0.25).astype(float), [0, 0, 0, 0], trees=5, depth=3)
    for row, got in zip(x, model.margin(x)):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > t[i] else 1)
            total += leaf[i - len(f)]
        assert abs(total - got) < 1e-9
    assert ((model.scores(x) > 0.5) == (x[:, 0] * x[:, 1] > 0.25)).mean() > 0.9
