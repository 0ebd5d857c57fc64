import hashlib
from collections import Counter, defaultdict

from langmix.llm.line_dedup import drop_common_lines
from tests.llm import data

BLANKS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    docs = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            docs[x.strip(BLANKS).translate(LOW)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (k := x.strip(BLANKS).translate(LOW)) or len(docs[k]) < least]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def run(spark, rows, least):
    got = drop_common_lines(data.table(spark, rows), least)
    assert set(got.columns) == set(data.table(spark, rows).columns)
    return Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect())


def test_matches_brute_force(spark):
    rows = data.awkward()
    for least in (2, 5, 100):
        assert run(spark, rows, least) == brute(rows, least)


def test_hot_and_rare_common_lines(spark, monkeypatch):
    """With a small bound only the hottest lines are broadcast; the result stays."""
    import langmix.llm.line_dedup as op

    rows = [(i, "\n".join(["hot"] * (i % 2) + [f"rare {i // 3}", f"own {i}"]), "en", "s", 0) + ("c",) * len(data.CLASHES) for i in range(60)]
    monkeypatch.setattr(op, "HOT", 3)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_empty_table(spark):
    assert drop_common_lines(data.table(spark, [])).collect() == []
