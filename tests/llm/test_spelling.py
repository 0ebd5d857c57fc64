import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from langmix.llm.spelling import damaged_words, near_pairs, signatures, spelling_groups
from tests.llm import data

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least=7, count=2):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(words, ratio=10):
    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(close[w]), words.get(form[w])))
    return out


def variants(rng, n=60):
    """Words in families: copies with one or two edits, of the same letters, and of few letters."""
    letters = "aabcdeéàÿ"
    words = set()
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 11)))
        words.add(w)
        for _ in range(6):
            x = list(rng.choice(sorted(words)))
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(x))
                rng.choice([lambda: x.insert(k, rng.choice(letters)), lambda: x.pop(k), lambda: x.__setitem__(k, rng.choice(letters)), lambda: rng.shuffle(x)])()
            words.add("".join(x))
    return {w: rng.choice([2, 3, 20, 30, 40, 400, 5000]) for w in words}


@pytest.mark.parametrize("group", [5_000, 1, 4])
def test_groups_equal_brute_force(spark, group):
    words = variants(random.Random(group))
    got = spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"), group=group).collect()
    assert len(got) == len(words)
    assert set(map(tuple, got)) == brute_groups(words)
    assert any(r.form and r.root not in (r.word, r.form) for r in got)


def test_near_words_share_a_signature():
    words = sorted(variants(random.Random(2), 25))
    same, short, long, masks = signatures(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if len(a) <= len(b) and a != b and near(a, b):
                assert (same[i] == same[j]).any() if len(a) == len(b) else (short[i] == long[j]).any()
                assert np.bitwise_count(masks.view(np.uint64)[i] ^ masks.view(np.uint64)[j]) <= 2


def test_words_of_documents(spark):
    rows = data.awkward() + [(900 + k, "Réticulation réticulation xRÉTICULATION ÷÷÷÷÷÷÷÷×", "en", "s", 0) + ("c",) * len(data.CLASHES) for k in range(40)]
    got = damaged_words(data.table(spark, rows)).collect()
    assert {r.word: r.n for r in got} == brute_words([(r[0], r[1]) for r in rows])
    assert max(len(r.word) for r in got) < 100  # the long run occurs once
    twice = damaged_words(data.table(spark, rows + rows)).collect()
    assert max(len(r.word) for r in twice) >= 29_999


def test_long_words_nulls_and_empty(spark):
    a = "x" * 3_000
    rows = [(a, 50), (a + "y", 2), ("y" + a, 5), (None, 7)]
    got = {r.word: r for r in spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[a + "y"].form == a and got["y" + a].root == a and got[a].n_near == 2 and got[a].form is None and len(got) == 3
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling_groups(empty).collect() == [] and near_pairs(empty).collect() == []
    assert damaged_words(data.table(spark, [])).collect() == []
