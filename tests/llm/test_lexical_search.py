import math
import re
from collections import Counter

from langmix.llm.lexical_search import Bucket, ranked_search
from tests.llm import data

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, score string, rank string, n string, q string"


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        rows = []
        for (i, c), size in zip(held, sizes):
            if size:
                m = 100 - 25 + (25 * size * n) // length
                s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, a in asked.items() if t in c)
                if s > 0:
                    rows.append((-s, i is None, i))
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(rows[:k], 1)]
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "c", "c", "c", "c") for i, t in rows], ITEMS)


def asked():
    rows = data.awkward()
    return [(i, r[1]) for i, r in enumerate(rows) if r[1] and i % 5 == 0] + [(90, None), (91, ""), (92, "nosuchterm"), (93, "Shared shared LINE"), (None, "of all"), (93, "one of all")]


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_brute_force(spark):
    rows = data.awkward()
    want = brute([(r[0], r[1]) for r in rows], asked())
    assert got(ranked_search(data.table(spark, rows), items(spark, asked()))) == want
    # several blocks of items, thresholds from few documents, and few results
    assert got(ranked_search(data.table(spark, rows), items(spark, asked()), block_bytes=2_000, seeds=1)) == want
    assert got(ranked_search(data.table(spark, rows), items(spark, asked()), k=3, seeds=5)) == brute([(r[0], r[1]) for r in rows], asked(), 3)


def test_ties_and_repeated_rows(spark):
    rows = [(i, "same words here", "s") for i in (9, 3, 5, 3)] + [(7, "same", "s"), (8, "other words", "s"), (10, "none", "s")]
    rows = [(i, t, "en", s, 0) + ("c",) * len(data.CLASHES) for i, t, s in rows]
    out = got(ranked_search(data.table(spark, rows), items(spark, [(1, "same here")]), k=3))
    assert [r[2] for r in out] == [7, 3, 3] or [r[2] for r in out] == [3, 3, 5]
    assert out == brute([(r[0], r[1]) for r in rows], [(1, "same here")], 3)


def test_empty_tables(spark):
    assert got(ranked_search(data.table(spark, []), items(spark, [(1, "a")]))) == []
    assert got(ranked_search(data.table(spark), items(spark, []))) == []
    assert got(ranked_search(data.table(spark, [r for r in data.awkward() if r[0] == 200]), items(spark, [(1, "a")]))) == []


def test_bounds_prune(spark, monkeypatch):
    """Buckets and documents that cannot reach the threshold are never scored."""
    import numpy as np

    from langmix.llm.lexical_search import Query

    q = Query([b"a", b"a", b"b"], {b"a": 0, b"b": 1, b"c": 2}, np.array([1_000, 10, 5]))
    vec = [{0: 900, 1: 5}, {1: 700, 2: 500}, {1: 300}, {2: 100}]
    cols = [np.array(sorted(v), np.int32).tobytes() for v in vec]
    imp = [np.array([v[c] for c in sorted(v)], np.int32).tobytes() for v in vec]
    norms = np.array([math.sqrt(sum(x * x for x in v.values())) for v in vec])
    b = Bucket(np.arange(4), norms, cols, imp, 3)
    assert b.survivors(q, 1).tolist() == [0, 1, 2]
    assert b.survivors(q, 100_000).tolist() == [0]  # without its largest term nothing gets there
    assert b.survivors(q, 10 ** 9).tolist() == []
    dense = np.array([2_000, 10, 0])
    assert b.scores(np.array([0, 2]), dense).tolist() == [2_000 * 900 + 50, 3_000]
