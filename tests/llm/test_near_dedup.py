import random
import re
from collections import Counter

import numpy as np
import pytest

from langmix.llm.components import components
from langmix.llm.near_dedup import NearDuplicates, exact_links, minwise, near_dedup, shingle_set
from tests.llm import data

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    """component_id of each id, all pairs compared."""
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


def families(seed=1):
    """Copies, a family around a centre whose members are not alike enough to each other, chains, one with a common passage."""
    rng = random.Random(seed)
    out = []
    add = lambda words: out.append((len(out), " ".join(words), "en", "src0", 0) + ("c",) * len(data.CLASHES))
    centre = data.prose(rng, 300).split()
    for _ in range(25):
        w = list(centre)
        for at in rng.sample(range(0, 300, 12), 3):
            w[at] = "edit" + str(rng.random())
        add(w)
    add(centre)
    for _ in range(6):
        add(centre)
    chain = data.prose(rng, 200).split()
    for k in range(12):
        chain = list(chain)
        chain[k * 15 + 3] = f"step{k}"
        add(chain)
    passage = data.prose(rng, 80).split()
    for _ in range(30):
        add(data.prose(rng, rng.randint(40, 120)).split() + passage)
    rng.shuffle(out)
    return [(i, *r[1:]) for i, r in enumerate(out)]


@pytest.mark.parametrize("parameters", [{}, {"leaf": 4, "share": 8, "depth": 2, "group_docs": 6}, {"leaf": 3, "depth": 4, "group_bytes": 20_000}])
def test_matches_brute_force(spark, parameters):
    rows = data.awkward(20) + [(1000 + r[0], *r[1:]) for r in families()]
    got = NearDuplicates(**parameters).run(data.table(spark, rows)).collect()
    want = brute(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(r[1])) for r in rows)


def test_keeps_all_columns(spark):
    docs = data.table(spark)
    got = near_dedup(docs, percent=80)
    assert set(got.columns) == set(docs.columns) and got.count() == docs.count()
    assert got.where("doc_id is null and not kept").count() == 0


def test_empty_table(spark):
    assert near_dedup(data.table(spark, [])).collect() == []
    nothing = data.table(spark, [r for r in data.awkward() if not (r[1] or "").strip()])
    assert near_dedup(nothing).where("kept").count() == nothing.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 500), (500, 3), (3, 9), (1, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 3 for i in (3, 7, 9, 500)}}


def test_minwise_estimates_similarity():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 2 ** 63, 2_000).astype(np.uint64))
    for keep in (0.95, 0.8, 0.5):
        a, b = s[:int(len(s) * (1 + keep) / 2)], s[int(len(s) * (1 - keep) / 2):]
        real = len(np.intersect1d(a, b)) / len(s)
        assert abs((minwise(a)[1] == minwise(b)[1]).mean() - real) < 0.2
    assert len(shingle_set("a b")) == 1 and len(shingle_set(" \n")) == 0 and len(shingle_set("A b c d e a B C D E")) == 5 + 0


def test_exact_links_connect_what_full_sets_connect():
    sets = [shingle_set(r[1]) for r in families(3)]
    links = exact_links(sets, np.arange(len(sets)), 85)
    want = brute(families(3))
    root = list(range(len(sets)))
    for a, b in links:
        i, j = len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))
        assert 100 * i >= 85 * j
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    assert root == [want[i] for i in range(len(sets))]


def template_rows():
    """Documents that share most of a template, too little to be near duplicates; near copies planted among them, and a
    chain of versions whose ends are not alike."""
    rng = random.Random(11)
    template = data.prose(rng, 200).split()
    texts = [template + [f"own{i}x{k}" for k in range(70)] for i in range(400)]
    texts += [texts[i][:-4] + [f"edit{i}x{k}" for k in range(4)] for i in range(60)]
    version = template + [f"v{k}" for k in range(100)]
    for k in range(60):
        version = list(version)
        version[200 + 10 * (k % 10)] = f"step{k}"
        texts.append(version)
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "src0", 0) + ("c",) * len(data.CLASHES) for i, t in enumerate(texts)]


@pytest.mark.parametrize("parameters", [{"depth": 0}, {"leaf": 20, "depth": 2}])
def test_large_nodes_are_compared_across_shares(spark, parameters):
    rows = template_rows()
    want = brute(rows)
    assert len(set(want.values())) == 400 + 1
    got = NearDuplicates(share=40, **parameters).run(data.table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_every_pair_of_a_large_node_is_met(spark):
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2 ** 16, (300, 64)).astype(np.uint16)
    sig[1:150] = sig[0]  # tied to one centre
    sig[150:200] = sig[200:250]
    rows = [(1, bytes([i % 256, i // 256]), s.tobytes(), 300) for i, s in enumerate(sig)]
    got = NearDuplicates(share=20).compare(spark.createDataFrame(rows, "node long, key binary, sig binary, size long")).collect()
    number = lambda k: k[0] + 256 * k[1]
    edges = [(number(r.a), number(r.b)) for r in got]
    roots = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(150)}, **{i: 150 + (i - 150) % 50 for i in range(150, 250)}}
