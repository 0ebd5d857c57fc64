"""Operator 6: near duplicates by chosen-path set similarity join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import LOWER, UPPER, blank_words, stored, without
from langmix.llm.components import components
from langmix.llm.encode import by_bytes, texts_of

ASCII = str.maketrans(UPPER, LOWER)
#: Words in a shingle; minwise tokens of a document.
SHINGLE, TOKENS = 5, 64
REMEMBERED = 200_000
_random = np.random.default_rng(20_240_607)
_MIX = _random.integers(1, 2 ** 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_random.integers(0, 2 ** 32, TOKENS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


_INVERSE = np.array([pow(int(m), -1, 2 ** 32) for m in _MUL], np.uint32)
_rows = np.empty((512, TOKENS), np.uint32)


class _WordHashes(dict):
    """Word -> 64 bits of its lower-cased (A-Z) form, worked out when first met."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word.translate(ASCII).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return got


_words = _WordHashes()


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's 5-word shingles; a shorter text is one shingle, a text without
    words has none."""
    words = blank_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        acc = np.uint64(len(h)) + (h * _MIX[:len(h)]).sum(dtype=np.uint64, keepdims=True)
    else:
        acc = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            acc += h[k:len(h) - SHINGLE + 1 + k] * _MIX[k]
    return np.unique(_finish(acc))


def minwise(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minwise tokens of a set: its member that comes first in each of ``TOKENS`` permutations (of 32 bits of the
    members), and 16 bits of each token for comparison."""
    short = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 512):
        part = short[i:i + 512, None]
        held = np.multiply(part, _MUL, out=_rows[:len(part)])
        np.minimum(low, held.min(axis=0), out=low)
    member = s[np.searchsorted(short, low * _INVERSE)]
    return member, (_finish(member) >> np.uint64(48)).astype(np.uint16)


def sketches(docs: DataFrame, id_col: str, text_col: str, picks: list[int]) -> DataFrame:
    """``(doc_id, n, key, sig, picked)``: set size, a 128-bit key of the set, 16 bits of its minwise tokens, and the
    picked tokens whole (64 bits each). Empty sets have no key."""
    def run(batches):
        for batch in by_bytes(batches, "text"):
            sets = [shingle_set(t) for t in texts_of(batch, "text")]
            tokens = [minwise(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([t and t[1].tobytes() for t in tokens], pa.binary()),
                pa.array([t and t[0][picks].tobytes() for t in tokens], pa.binary())], names=["doc_id", "n", "key", "sig", "picked"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, key binary, sig binary, picked binary")


def segments(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that come sorted by ``column``; the last group of a batch waits for the
    next one. Groups are bounded by the caller."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(column).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(ids, ids[-1], "left"))
        if last or (held and held[0].column(column)[0].as_py() != ids[0]):
            if last:
                held.append(batch.slice(0, last))
                yield pa.Table.from_batches(held)
                held = []
            else:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


class NearDuplicates:
    """The parameters of one join and its steps.

    ``trees`` independent trees; in each a node picks every minwise token with a chance that leaves a pair at the
    threshold ``branching`` common children on average, and a document goes to the child named by its value of each
    picked token. Nodes up to ``leaf`` documents are compared exhaustively; a child that holds nearly all of its
    parent is a dense group and compared as well; a task gets about ``share`` documents of a node at most.
    """

    def __init__(self, percent: int = 85, trees: int = 10, branching: float = 1.5, leaf: int = 2_000, share: int = 30_000,
                 depth: int = 6, slack: float = 4.7, group_docs: int = 4_000, group_bytes: int = 24 << 20):
        p = percent / 100
        self.percent, self.trees, self.leaf, self.share, self.depth = percent, trees, leaf, share, depth
        self.group_docs, self.group_bytes = group_docs, group_bytes
        self.chance = min(1.0, branching / (p * TOKENS))
        rng = np.random.default_rng(7)
        self.picks: list[tuple[int, int]] = []  # (tree, token) of the roots' children, drawn once
        for t in range(trees):
            got = np.flatnonzero(rng.random(TOKENS) < self.chance)
            self.picks += [(t, int(i)) for i in (got if len(got) else [rng.integers(TOKENS)])]
        #: Common tokens that a pair at the threshold shows but for a few times in a million.
        self.common = max(1, int(TOKENS * p - slack * (TOKENS * p * (1 - p)) ** 0.5))

    # -- trees ----------------------------------------------------------------------------------------------------
    def roots(self, reps: DataFrame) -> DataFrame:
        """``(node, cid, key)`` of the children of all roots, named by whole tokens: documents without a common
        shingle do not meet, however many there are."""
        nodes = [F.xxhash64(F.lit(t), F.lit(i), F.substring("picked", 8 * j + 1, 8)) for j, (t, i) in enumerate(self.picks)]
        return reps.select("cid", "key", F.explode(F.array(*nodes)).alias("node"))

    def branch(self, rows: DataFrame) -> DataFrame:
        """Children of large nodes: each node draws its tokens by a hash of its own name, at least one."""
        cut = int(self.chance * 1_000_003)
        index = F.sequence(F.lit(0), F.lit(TOKENS - 1))
        drawn = F.filter(index, lambda i: F.pmod(F.xxhash64(F.col("node"), i), F.lit(1_000_003)) < cut)
        drawn = F.when(F.size(drawn) > 0, drawn).otherwise(F.array(F.pmod(F.xxhash64("node"), F.lit(TOKENS)).cast("int")))
        kids = rows.select("cid", "key", "sig", F.col("size").alias("above"), "node", F.explode(drawn).alias("i"))
        return kids.select("cid", "key", "sig", "above", F.xxhash64("node", "i", F.expr("substring(sig, 2 * i + 1, 2)")).alias("node"))

    def candidates(self, reps: DataFrame) -> DataFrame:
        """Distinct ``(a, b)``, in keys, that tie together all documents of a node that may be similar."""
        first = self.roots(reps).select("node", "cid", "key")
        sizes = first.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        live = first.join(sizes, "node").join(reps.select("key", "sig"), "key")
        rows = stored(live.select("cid", "key", "sig", F.lit(1 << 62).alias("above"), "node", "size"), "cps-level")
        edges = []
        for level in range(self.depth + 1):
            dense = (F.col("size") > 0.7 * F.col("above")) if level < self.depth else F.lit(True)
            ready = (F.col("size") <= self.leaf) | dense
            edges.append(self.compare(rows.where(ready)))
            large = rows.where(~ready)
            if level == self.depth or large.isEmpty():
                break
            kids = self.branch(large)
            sizes = kids.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
            rows = stored(kids.join(sizes, "node"), "cps-level")
        out = edges[0]
        for e in edges[1:]:
            out = out.unionByName(e)
        return out.distinct()

    def compare(self, rows: DataFrame) -> DataFrame:
        """Ties ``(a, b)`` of each node's documents: what they connect is what all pairs of the node connect."""
        small = rows.where(F.col("size") <= self.share)
        ties = self._ties(small.withColumn("at", F.col("node")).withColumn("rest", F.lit(True)))
        big = rows.where(F.col("size") > self.share)
        if not big.isEmpty():
            ties = ties.unionByName(self.large_nodes(stored(big.select("node", "key", "sig", "size"), "cps-large")))
        return ties.select("a", "b")

    def large_nodes(self, big: DataFrame) -> DataFrame:
        """Ties of nodes of more than ``share`` documents. The document with the most ties in its share is compared
        with the whole node. What it ties is connected; the rest meets the rest and all that is tied, in tasks of two
        slots of about ``share / 2`` documents each, so every pair not yet connected is compared."""
        share = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / self.share))
        first = self._ties(big.withColumn("at", F.xxhash64("node", share)).withColumn("rest", F.lit(True)))
        centre = first.groupBy("node", "a").count().groupBy("node").agg(F.max_by("a", F.struct("count", "a")).alias("key"))
        # one row for each large node
        centre = stored(centre.join(big, ["node", "key"]).select("node", F.col("key").alias("centre"), F.col("sig").alias("middle")), "cps-centres")
        met = stored(self._meet(big.join(F.broadcast(centre), "node", "left")), "cps-met")
        out = met.where("not rest and key <> centre").select("node", F.col("centre").alias("a"), F.col("key").alias("b"))
        half = lambda n: F.ceil(n / (self.share / 2))
        sums = met.groupBy("node").agg(F.count_if("rest").alias("n"), F.count_if(~F.col("rest")).alias("tied")).where("n > 0")
        sums = sums.select("node", half(F.col("n")).alias("parts"), half(F.col("tied")).alias("others"))
        slot = F.pmod(F.xxhash64("key"), F.when(F.col("rest"), F.col("parts")).otherwise(F.col("others")))
        dealt = met.join(F.broadcast(sums), "node").withColumn("slot", F.when(F.col("rest"), slot).otherwise(F.col("parts") + slot))
        last = F.col("parts") - 1 + F.when(F.col("rest"), F.col("others")).otherwise(F.lit(0))
        pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        return out.unionByName(self._ties(pairs.withColumn("at", F.xxhash64("node", F.least("slot", "j"), F.greatest("slot", "j")))))

    def _meet(self, rows: DataFrame) -> DataFrame:
        """``(node, key, sig, centre, rest)``; ``rest``: the node's centre does not tie the document."""
        common = self.common

        def run(batches):
            for batch in batches:
                sig, middle = batch.column("sig").to_pylist(), batch.column("middle").to_pylist()
                rest = [m is None or int((np.frombuffer(s, np.uint16) == np.frombuffer(m, np.uint16)).sum()) < common for s, m in zip(sig, middle)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "key", "sig", "centre")] + [pa.array(rest, pa.bool_())],
                                                 names=["node", "key", "sig", "centre", "rest"])

        return rows.select("node", "key", "sig", "centre", "middle").mapInArrow(run, "node long, key binary, sig binary, centre binary, rest boolean")

    def _ties(self, rows: DataFrame) -> DataFrame:
        """``(node, a, b)``: b tied to a, among the documents of one ``at``. Pairs without one of the ``rest`` need not
        be met."""
        common = self.common

        def run(batches):
            for t in segments(batches, "at"):
                at, node = t["at"].to_numpy(), t["node"].to_numpy()
                keys, rest = t["key"].to_pylist(), t["rest"].to_numpy()
                sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, TOKENS)
                ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1
                starts = np.concatenate([[0], ends[:-1]])
                pairs = ends - starts == 2
                near = np.zeros(len(starts), bool)
                near[pairs] = (sig[starts[pairs]] == sig[starts[pairs] + 1]).sum(axis=1) >= common
                out = []
                for s, e, two, close in zip(starts.tolist(), ends.tolist(), pairs.tolist(), near.tolist()):
                    name = int(node[s])
                    if two:
                        if close:
                            out.append((name, keys[s], keys[s + 1]))
                        continue
                    left = np.arange(s, e)
                    while len(left) and rest[left[0]]:  # the rest comes first
                        head, left = left[0], left[1:]
                        front = [head]
                        while front and len(left):  # every pair is met until it is tied
                            p = front.pop()
                            hit = (sig[left] == sig[p]).sum(axis=1) >= common
                            for i in left[hit].tolist():
                                out.append((name, keys[p], keys[i]))
                                front.append(i)
                            left = left[~hit]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["node", "a", "b"])

        spread = rows.select("at", "node", "key", "sig", "rest").repartition("at").sortWithinPartitions("at", F.desc("rest"), "key")
        return spread.mapInArrow(run, "node long, a binary, b binary")

    # -- confirmation ---------------------------------------------------------------------------------------------
    def confirm(self, members: DataFrame, blocks: bool) -> DataFrame:
        """Confirmed links, as few as connect what full sets connect. ``members``: ``(at, chosen, cid, set)``, sorted
        by ``at`` here; every chosen one is compared with all others of its ``at``."""
        percent = self.percent

        def run(batches):
            for t in segments(batches, "at"):
                at = t["at"].to_numpy(zero_copy_only=False)
                cid, chosen, sets = t["cid"].to_numpy(), t["chosen"].to_numpy(zero_copy_only=False), t["set"].to_pylist()
                ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1
                out = []
                for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    if e - s > 1:
                        out += [(int(cid[s + i]), int(cid[s + j])) for i, j in exact_links([np.frombuffer(x, np.uint64) for x in sets[s:e]], np.flatnonzero(chosen[s:e]), percent)]
                cols = list(zip(*out)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["a", "b"])

        return members.select("at", "chosen", "cid", "set").repartition("at").sortWithinPartitions("at", "cid").mapInArrow(run, "a long, b long")

    def links(self, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Confirmed links ``(a, b)`` between representatives that connect every component."""
        ties = self.candidates(reps)
        number = reps.select("key", F.xxhash64("key").alias("k"))
        ties = ties.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
        groups = components(ties).withColumnsRenamed({"id": "k", "component": "group"})
        members = groups.join(reps.join(number, "key"), "k").select("group", "cid", "key", "sig", "n")
        sums = members.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n") * 8).alias("bytes"))
        members = stored(members.join(sums, "group"), "cps-members")
        texts = docs.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).alias("text"))
        wanted = texts.join(members.select("cid", "key", "group", "docs", "bytes"), "cid")

        def run(batches):
            for batch in by_bytes(batches, "text"):
                sets = [shingle_set(x).tobytes() for x in texts_of(batch, "text")]
                # an id may have rows with other texts
                same = pa.array([hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, batch.column("key").to_pylist())])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cid", "key", "group", "docs", "bytes")] + [pa.array(sets, pa.binary())],
                                                 names=["cid", "key", "group", "docs", "bytes", "set"]).filter(same)

        full = wanted.mapInArrow(run, "cid long, key binary, group long, docs long, bytes long, set binary")
        small = (F.col("docs") <= self.group_docs) & (F.col("bytes") <= self.group_bytes)
        big = members.where(~small)
        if big.isEmpty():
            return self.confirm(full.select(F.col("group").alias("at"), F.lit(True).alias("chosen"), "cid", "set"), False)
        full = stored(full, "cps-sets")
        out = self.confirm(full.where(small).select(F.col("group").alias("at"), F.lit(True).alias("chosen"), "cid", "set"), False)
        return out.unionByName(self.large_groups(big, full.where(~small)))

    def large_groups(self, big: DataFrame, full: DataFrame) -> DataFrame:
        """A group beyond one task's bound: its most central document (the one nearest to the commonest tokens) is
        compared with all others in blocks, then all that it does not link with everything, in blocks again."""
        token = big.select("group", "cid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.substring(F.col("sig"), 2 * i + 1, F.lit(2)))).alias("i", "v"))
        usual = token.groupBy("group", "i", "v").count().groupBy("group", "i").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
        centre = token.join(usual, ["group", "i", "v"]).groupBy("group", "cid").count().groupBy("group").agg(F.max_by("cid", F.struct("count", "cid")).alias("cid"))
        star = stored(self._blocks(full, centre.select("cid").distinct()), "cps-star")
        linked = components(star).select(F.col("id").alias("cid"))
        rest = full.select("cid").distinct().join(linked, "cid", "left_anti")
        return star.unionByName(self._blocks(full, rest))

    def _blocks(self, full: DataFrame, chosen: DataFrame) -> DataFrame:
        """Every chosen document against all of its group: each side dealt to blocks of a bounded size."""
        n = F.greatest(F.ceil(F.col("docs") / (self.group_docs / 2)), F.ceil(F.col("bytes") / (self.group_bytes / 2)))
        dealt = full.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
        picked = dealt.join(chosen, "cid", "left_semi")
        many = picked.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / (self.group_docs / 2), F.sum(F.octet_length("set")) / (self.group_bytes / 2))).alias("parts"))
        picked = picked.join(many, "group").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts")))
        left = picked.select("group", "cid", "set", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("chosen"))
        right = dealt.join(many, "group").select("group", "cid", "set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("own").alias("block"), F.lit(False).alias("chosen"))
        return self.confirm(left.unionByName(right).withColumn("at", F.xxhash64("group", "part", "block")), True)

    # -- result ---------------------------------------------------------------------------------------------------
    def run(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``."""
        rows = stored(sketches(docs, id_col, text_col, [i for _, i in self.picks]), "cps-sketches")
        classes = rows.where("key is not null and doc_id is not null").groupBy("key").agg(
            F.min("doc_id").alias("cid"), F.min("sig").alias("sig"), F.min("picked").alias("picked"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
        reps = stored(classes, "cps-classes")
        found = components(stored(self.links(docs, reps, id_col, text_col), "cps-links")).select(F.col("id").alias("cid"), F.col("component").alias("root"))
        tied = reps.join(found, "cid", "left").where("copies > 1 or root is not null").select("key", F.coalesce("root", "cid").alias("root"))
        out = rows.join(tied, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def exact_links(sets: list[np.ndarray], chosen: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the chosen sets and all others that connect everything the full sets connect: a pair already
    connected is not compared again. Central sets, whose shingles many others hold, come first."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    usual = np.bincount(at)
    central = np.add.reduceat(usual[at], starts) / size
    root = np.arange(n)
    out = []
    done = np.zeros(n, bool)
    for p in sorted(chosen.tolist(), key=lambda i: (-central[i], i)):
        done[p] = True
        other = np.flatnonzero((root != root[p]) & ~done & (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p])))
        if not len(other):
            if (root == root[p]).all():
                break
            continue
        mark = np.zeros(len(flat), bool)
        mark[at[starts[p]:starts[p] + size[p]]] = True
        if 3 * len(other) > n:
            both = np.add.reduceat(mark[at], starts, dtype=np.int64)[other]
        else:
            both = np.array([np.count_nonzero(mark[at[starts[i]:starts[i] + size[i]]]) for i in other])
        for i in other[100 * both >= percent * (size[other] + size[p] - both)].tolist():
            out.append((p, i))
            if root[i] != root[p]:
                root[root == root[i]] = root[p]
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """All input columns and ``n_shingles``, ``component_id``, ``kept`` (they replace input columns of that name).

    Equal sets are one class before the join, so copies are never paired. Candidates come from the trees and are
    confirmed on the full sets of the texts; components are the smallest id reachable. Null, empty and blank texts
    have no shingles and link with nothing; rows with one id are one document, kept if that id is the component's; a
    row with a null id links with nothing and is kept. An empty table gives an empty table.
    """
    names = ("n_shingles", "component_id", "kept")
    found = NearDuplicates(**parameters).run(docs, id_col, text_col).groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.min("kept").alias("kept"))
    others = without(docs, *names)
    return docs.select(*others).join(found.withColumnRenamed("doc_id", "__id"), F.col(id_col).cast("long").eqNullSafe(F.col("__id"))).drop("__id")
