import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from langmix.llm import maxent_lm as M
from tests.llm import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")] + ["\n"]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows):
    counts = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    return [(str(i), held_out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total,
             round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words(t)), 6)) for i, t in rows]


@pytest.mark.parametrize("small", [False, True])
def test_counts_and_base_equal_brute_force(spark, small):
    """``small``: most words outside the dictionary, so that they are joined."""
    rows = data.awkward() + [(800 + k, "w" * 200 + " shared " + "w" * 200, "en", "s", 0) + ("c",) * len(data.CLASHES) for k in range(9)]
    docs = data.table(spark, rows)
    model, vocab = M.fit(docs, task_tokens=20_000, **({"dictionary": 150, "heads": 2, "width": 16, "rows": 1 << 8} if small else {}))
    got = M.score(docs, model, vocab).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(brute([(r[0], r[1]) for r in rows]))
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    """After any history, over all words of the vocabulary and one unknown word for each ending."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(data.WORDS[:120]) for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, vocab = M.fit(docs, heads=3, width=16, rows=1 << 8, task_tokens=2_000)
    known = [bytes(r.word) for r in vocab.collect()]
    unknown = {}
    while len(unknown) < model.tails:
        w = str(rng.random()).encode()
        unknown.setdefault(model.tail_class(w), w)
    history = " ".join(data.WORDS[:3])
    total, state = 0.0, {}
    for w in [*known, *unknown.values()]:
        if w == M.END:
            p = model.word_scores(model.encode([history], state))[-1]
        else:
            got = model.encode([history + " " + w.decode()], state)
            p = model.word_scores(got)[-2]
            if got["at"][-2] < 0:
                p += math.log(1 / model.tail_total[got["kind"][-2] - model.heads])
        total += math.exp(p)
    assert abs(total - 1) < 1e-4


def sentences(rng, n):
    """Two languages whose words alternate by a rule."""
    a, b = data.WORDS[:40], data.WORDS[40:80]
    out = []
    for i in range(n):
        w = a if i % 2 else b
        k = rng.randrange(40)
        text = []
        for _ in range(50):
            text.append(w[k])
            k = (k * 7 + rng.choice([1, 3])) % 40
        out.append((i, " ".join(text)))
    return out


def test_learns_more_than_counts(spark):
    rows = sentences(random.Random(4), 1_500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model, vocab = M.fit(docs, heads=2, width=64, rows=1 << 10, task_tokens=20_000)
    held = [r for r in M.score(docs, model, vocab).collect() if r.held_out]
    mean = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert len(held) > 100
    assert mean("score") > mean("base_score") + 0.5  # each word is more than three times as likely


def test_a_step_follows_the_gradient():
    """The log-probability of the words rises along the step, as finite differences say it should."""
    model = M.MaxentModel(heads=2, width=8, rows=1 << 4, rate=1e-3)
    model.words = [w.encode() for w in data.WORDS[:16]]
    model.counts = np.arange(16, 0, -1)
    model.kinds = np.arange(16, dtype=np.int32) // 8
    hashes = M.Words([" ".join(data.WORDS[:16])]).hashes[:-1]
    model.order = np.argsort(hashes)
    model.hashes = hashes[model.order]
    model.class_bias, model.word_bias, model.tail_total = np.zeros(8, np.float32), np.zeros((2, 8), np.float32), np.ones(6)
    text = [" ".join(data.WORDS[i % 20] for i in range(0, 300, 7))]
    arrays = model.encode(text, {})
    before = model.word_scores(arrays).sum()
    model.descend(arrays, np.zeros(32, np.float32), np.zeros(32, np.float32))
    assert model.word_scores(arrays).sum() > before


def test_words_in_bulk():
    """Words and their hashes are those of each text alone: equal words, and only they, have equal hashes."""
    rng = random.Random(9)
    texts = [r[1] or "" for r in data.awkward()] + ["", " ", "a", " A\x0bb\x1c c\n"] + ["".join(rng.choice("ab \n\té") for _ in range(30)) for _ in range(50)]
    got = M.Words(texts)
    want = [w.encode("utf-8") for t in texts for w in words(t)]
    assert [got.word(i) for i in range(len(got.doc))] == want and got.sizes.tolist() == [len(words(t)) for t in texts]
    assert len({(w, int(h)) for w, h in zip(want, got.hashes)}) == len(set(want)) == len(set(got.hashes.tolist()))


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if held_out(i)][:5]
    docs = spark.createDataFrame([(i, "a b") for i in held] + [(held[0], None)], "doc_id long, text string")
    model, vocab = M.fit(docs)
    got = M.score(docs, model, vocab).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 6 and sorted(r.n_tokens for r in got) == [1, 3, 3, 3, 3, 3]
    empty = data.table(spark, [])
    model, vocab = M.fit(empty)
    assert M.score(empty, model, vocab).collect() == []
