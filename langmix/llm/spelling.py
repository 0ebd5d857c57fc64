"""Operator 11: group spelling variants by PartEnum signatures."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import stored
from langmix.llm.encode import by_bytes, texts_of

#: Partitions of the letters' dimensions.
PARTS = 4
#: Distinct words, and bytes of them, that a task counts before it hands its counts on.
HELD, HELD_BYTES = 200_000, 16 << 20
#: One byte for each code point up to 255: letters in lower case (A-Z only), all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_SAME = [list(s) for s in combinations(range(PARTS), PARTS - 2)]
_ONE = [list(s) for s in combinations(range(PARTS), PARTS - 1)]


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """``(word, n)``: words of at least ``least_length`` code points that occur at least ``least_count`` times.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z lower-cased. Where ``every`` divides the
    crc32 of ``<id>:<run>``, the run loses the code point at crc32 % length: spelling errors planted by a rule. Counts
    meet within each task first, in bounded memory. Null texts have no words, a null id is an empty string; repeated
    rows count each; other columns are not read; an empty table gives an empty table."""
    def run(batches):
        counts: dict[bytes, int] = {}
        held = 0
        for batch in by_bytes(batches, "text"):
            for doc_id, text in zip(batch.column("id").to_pylist(), texts_of(batch, "text")):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word in text.encode("latin-1", "replace").translate(_LETTERS).split():
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    if word in counts:
                        counts[word] += 1
                    else:
                        counts[word] = 1
                        held += len(word)
            if len(counts) > HELD or held > HELD_BYTES:
                yield _count_rows(counts)
                counts, held = {}, 0
        yield _count_rows(counts)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _count_rows(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Dimensions(dict):
    """A letter's k-th time in a word -> (its partition, 64 bits of it)."""

    def __missing__(self, key):
        h = int.from_bytes(hashlib.blake2b(repr(key).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        got = self[key] = (h >> 40) % PARTS, h
        return got


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """PartEnum signatures of the words' letter multisets, binary vectors with a dimension for each letter's k-th time.

    Words of one length that are near differ in two dimensions at most: a signature for each choice of ``PARTS - 2``
    partitions, of what the vector holds there (first result). Words of lengths L and L + 1 differ in one: a signature
    for each partition left out, marked with L, for the shorter (second) and the longer word (third). Some choice
    avoids the partitions in which two near words differ. An edit also leaves one end of a word as it is, so each
    signature comes with the first L div 2 letters and with the last L - L div 2: near words agree in one of these.
    Last: ``mask``, the parity of the dimensions in 64 slots; vectors at distance d have masks at distance d at most."""
    known = _Dimensions()
    held = np.zeros((len(words), PARTS), np.uint64)
    masks = np.zeros(len(words), np.uint64)
    ends = np.zeros((4, len(words)), np.uint64)
    size = np.fromiter(map(len, words), np.uint64, len(words))
    for i, word in enumerate(words):
        seen: dict[str, int] = {}
        parts, mask = [0] * PARTS, 0
        for c in word:
            seen[c] = k = seen.get(c, 0) + 1
            p, h = known[c, k]
            parts[p] ^= h
            mask ^= 1 << (h & 63)
        held[i], masks[i] = parts, mask
        for j, n in ((0, len(word)), (2, len(word) - 1)):
            ends[j, i] = zlib.crc32(word[:n // 2].encode("utf-8", "surrogatepass"))
            ends[j + 1, i] = zlib.crc32(word[len(word) - (n - n // 2):].encode("utf-8", "surrogatepass"))
        if len(known) > 1_000_000:
            known.clear()

    def signed(choices, kind: int, less: int) -> np.ndarray:
        out = np.empty((len(words), 2 * len(choices)), np.uint64)
        for j, s in enumerate(choices):
            h = _mix((size - np.uint64(less)) * np.uint64(256) + np.uint64(64 * kind + j))
            for p in s:
                h = _mix(h ^ held[:, p])
            for end in (0, 1):
                out[:, 2 * j + end] = _mix(h + (ends[2 * less + end] * np.uint64(2) + np.uint64(end)))
        return out.view(np.int64)

    return signed(_SAME, 0, 0), signed(_ONE, 1, 0), signed(_ONE, 1, 1), masks.view(np.int64)


def signed_words(words: DataFrame) -> DataFrame:
    """``words(word, n)``, one row for each signature: ``sig, mask, word, n``."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4_096):
                part = batch.slice(i, 4_096)
                *sigs, mask = signatures(part.column("word").to_pylist())
                sigs = np.concatenate(sigs, axis=1)
                at = pa.array(np.repeat(np.arange(part.num_rows), sigs.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(sigs.ravel()), pa.array(mask).take(at), part.column("word").take(at), part.column("n").take(at)],
                                                 names=["sig", "mask", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "sig long, mask long, word string, n long")


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class _Groups:
    """Near pairs among the rows of one signature, from batches sorted by it. A group of more than ``most`` rows is
    not compared: its words are handed on as they come, so memory follows neither the group nor the table."""

    def __init__(self, most: int):
        self.most = most
        self.held: list[pa.RecordBatch] = []
        self.rows = 0
        self.crowded = None

    def meet(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sig = batch.column("sig").to_numpy()
        last = int(np.searchsorted(sig, sig[-1], "left"))
        if self.held and sig[0] != self.held[0].column("sig")[-1].as_py():
            yield from self.close()
        if last:
            if self.crowded == sig[0]:
                end = int(np.searchsorted(sig, sig[0], "right"))
                yield self._hand_on(batch.slice(0, end))
                if end < last:
                    yield from self._compare([batch.slice(end, last - end)])
            else:
                yield from self._compare([*self.held, batch.slice(0, last)])
            self.held, self.rows = [], 0
        tail = batch.slice(last)
        if self.crowded == sig[-1]:
            yield self._hand_on(tail)
            return
        self.held.append(tail)
        self.rows += tail.num_rows
        if self.rows > self.most:
            self.crowded = sig[-1]
            for held in self.held:
                yield self._hand_on(held)
            self.held, self.rows = [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self._compare(self.held)
        self.held, self.rows = [], 0

    @staticmethod
    def _hand_on(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *none], names=["a", "na", "b", "nb"])

    def _compare(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        sig, mask = t["sig"].to_numpy(), t["mask"].to_numpy().view(np.uint64)  # bits of negative numbers are counted otherwise
        word, n = t["word"], t["n"].to_numpy()
        ends = np.flatnonzero(np.append(sig[1:] != sig[:-1], True)) + 1
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(sig)) - 1  # rows of the group that follow
        large = np.repeat(np.diff(ends, prepend=0) > self.most, np.diff(ends, prepend=0))
        if large.any():
            for part in t.filter(pa.array(large)).to_batches():
                yield self._hand_on(part)
        first, second, at, step = [], [], np.flatnonzero((left > 0) & ~large), 1
        while len(at):
            hit = at[np.bitwise_count(mask[at] ^ mask[at + step]) <= 2]
            first.append(hit)
            second.append(hit + step)
            step += 1
            at = at[left[at] >= step]
        if first:
            i, j = np.concatenate(first), np.concatenate(second)
            rows = [(a, x, b, y) if a < b else (b, y, a, x) for a, x, b, y in
                    zip(word.take(pa.array(i)).to_pylist(), n[i].tolist(), word.take(pa.array(j)).to_pylist(), n[j].tolist()) if near(a, b)]
            cols = list(zip(*set(rows))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["a", "na", "b", "nb"])


def _ordered(met: DataFrame) -> DataFrame:
    first = F.col("word") < F.col("word2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(pick("word", "word2").alias("a"), pick("n", "n2").alias("na"), pick("word2", "word").alias("b"), pick("n2", "n").alias("nb"))


def near_pairs(words: DataFrame, group: int = 5_000) -> DataFrame:
    """Distinct ``(a, na, b, nb)``, a < b, of ``words(word, n)`` that one inserted, deleted or replaced code point
    parts. Words meet on equal signatures and are verified there, by masks, then letter by letter. A signature held by
    more than ``group`` words is not compared pair by pair: its words meet on what is left of them without one code
    point, which only near words share."""
    def run(batches):
        groups = _Groups(group)
        for batch in batches:
            if batch.num_rows:
                yield from groups.meet(batch)
        yield from groups.close()

    dealt = signed_words(words).repartition("sig").sortWithinPartitions("sig")
    met = stored(dealt.mapInArrow(run, "a string, na long, b string, nb long"), "spell-met")
    crowded = met.where("b is null").select(F.col("a").alias("word"), F.col("na").alias("n")).distinct()
    return met.where("b is not null").unionByName(_by_gaps(crowded)).distinct()


def _by_gaps(words: DataFrame) -> DataFrame:
    """Near pairs by equality of what is left when one code point goes: at the same place (replaced), or of one word
    alone (deleted). The alphabet bounds how many words share it."""
    gaps = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    left, right = F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)")
    same = gaps.select(F.xxhash64("i", left, right).alias("k"), "word", "n")
    swapped = same.join(same.toDF("k", "word2", "n2"), "k").where("word < word2 and levenshtein(word, word2, 1) = 1")
    less = gaps.select(F.xxhash64(F.concat(left, right)).alias("k"), "word", "n").distinct()
    whole = words.select(F.xxhash64("word").alias("k"), F.col("word").alias("word2"), F.col("n").alias("n2"))
    cut = less.join(whole, "k").where("length(word) = length(word2) + 1 and levenshtein(word, word2, 1) = 1")
    return _ordered(swapped).unionByName(_ordered(cut))


def spelling_groups(words: DataFrame, ratio: int = 10, group: int = 5_000) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``words(word, n)``, distinct words with their counts.

    ``form`` is the word's near word of the largest n (ties: the smallest in code-point order) if that n is at least
    ``ratio`` times its own, else null; ``root`` the last of the chain of forms, which ends soon because counts grow
    by ``ratio`` at each step. Null words are left out; other columns are not read; an empty table gives an empty
    table."""
    words = stored(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "spell-words")
    pairs = stored(near_pairs(words, group), "spell-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("other")).alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("other")).alias("near")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    rows = words.join(best, "word", "left")
    has = -F.col("near.less") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near.other")).alias("form"),
                              F.when(has, -F.col("near.less")).alias("form_n")), "spell-forms")
    # pointer doubling: each round halves what is left of every chain
    steps = rows.where("form is not null").select("word", F.col("form").alias("last"))
    while True:
        longer = stored(steps.join(steps.toDF("last", "next"), "last", "left").select("word", "last", "next"), "spell-roots")
        steps = longer.select("word", F.coalesce("next", "last").alias("last"))
        if longer.where("next is not null").isEmpty():
            break
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
