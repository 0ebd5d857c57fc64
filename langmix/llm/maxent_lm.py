"""Operator 13: a hashed maximum-entropy language model with a class-factored softmax."""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import stored
from langmix.llm.encode import by_bytes, texts_of

#: A-Z in lower case, all other bytes as they are.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text as a word; no word holds a newline.
END = b"\n"
LONG = 32
#: Bound of each weight: three of them never take an exponential out of range.
CLIP = 8.0
#: Distinct words, and bytes of them, that a task counts before it hands its counts on.
HELD, HELD_BYTES = 200_000, 16 << 20
#: Bytes of text that are worked on at once: the arrays of a few bytes to each stay in the processor's cache.
TEXT_BYTES = 1 << 18
_MULTIPLIERS = np.random.default_rng(13).integers(1, 2 ** 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: White space, and a random odd weight for each place of a word: a hash is the sum of its bytes (plus 1) by weight.
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_WEIGHTS = np.random.default_rng(17).integers(1, 2 ** 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint64)
END_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Stands before the first word of a text.
_START = np.uint64(0x5BD1E995)


class Words:
    """All words of some texts in order (runs of characters other than ASCII white space, A-Z lower-cased) and an end
    after each text's, as arrays: ``hashes`` of 64 bits, ``doc`` and ``sizes``; the bytes of a word on demand."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join([*parts, b""]).translate(_LOWER)
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.begin, self.end = edge[::2], edge[1::2]  # the last byte is a newline
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        own = np.searchsorted(ends, self.begin, "right")
        self.sizes = np.bincount(own, minlength=len(texts)).astype(np.int64) + 1
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.last = np.cumsum(self.sizes) - 1
        self.place = np.ones(len(self.doc), bool)
        self.place[self.last] = False
        self.hashes = np.full(len(self.doc), END_HASH, np.uint64)
        if len(self.begin):
            begin = np.concatenate([[0], self.begin]).astype(np.int32)
            inside = np.arange(len(raw), dtype=np.int32)
            inside -= np.repeat(begin, np.diff(begin, append=np.int32(len(raw))))
            inside &= len(_WEIGHTS) - 1
            value = np.take(_WEIGHTS, inside)
            value *= _VALUES[raw]  # white space counts nothing
            self.hashes[self.place] = np.add.reduceat(value, self.begin)
        self.at = np.cumsum(self.place) - 1  # of each word that is no end, its number among them

    def word(self, i: int) -> bytes:
        if not self.place[i]:
            return END
        j = self.at[i]
        return self.data[self.begin[j]:self.end[j]]


def key_of(word: bytes) -> bytes:
    """The word itself, or for a long one a digest behind a newline: keys are bounded."""
    return word if len(word) <= LONG else END + hashlib.blake2b(word, digest_size=16).digest()


def is_held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Rows the model never learns from: crc32 of the id as text leaves ``fold``. A null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def vocabulary(texts: DataFrame) -> DataFrame:
    """``(word, c)``: keys of all words and ends in ``texts(text)`` and their counts. Tasks count first, in bounded
    memory, so a frequent word is one row for each of them."""
    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(map(key_of, counts)), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches):
        counts: dict[bytes, int] = {}
        get, held = counts.get, 0
        for batch in by_bytes(batches, "text", 1 << 20):
            for text in texts_of(batch, "text"):
                words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
                held += len(text)
                for w in words:
                    counts[w] = get(w, 0) + 1
                counts[END] = get(END, 0) + 1
            if len(counts) > HELD or held > HELD_BYTES and sum(map(len, counts)) > HELD_BYTES:
                yield rows(counts)
                counts.clear()
                held = 0
        yield rows(counts)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class MaxentModel:
    """Parameters and what has been learned.

    P(word | history) = P(class | history) P(word | class, history). The ``heads * width`` most frequent words are
    modelled: classes of ``width`` words by frequency, both factors softmaxes over hashed features of the history (the
    last word, the last two words, and the word two back), each a row of weights on top of the unigram counts.
    Every other word has a class by its ending (``width - heads`` of them), of which the model gives the probability;
    within it a word has (c + 1) / (all c + words + 1), one share being left for the words never met. So the
    probabilities of the V words and of one unknown word for each ending sum to 1. ``rows`` hashed rows hold the
    weights of each factor; the ``dictionary`` most frequent words are known to every task, others are joined."""

    rows: int = 1 << 14
    width: int = 64
    heads: int = 40
    dictionary: int = 1 << 18
    batch: int = 4_096
    rate: float = 0.1
    total: int = 0  # N
    distinct: int = 0  # V
    words: list = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # class of each word of the dictionary
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of the words in ``order``, ascending
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray | None = None  # (2 * rows, width): class factor, word factor
    class_bias: np.ndarray | None = None
    word_bias: np.ndarray | None = None
    tail_total: np.ndarray | None = None

    def __post_init__(self):
        if self.rows & (self.rows - 1) or not 0 < self.heads < self.width:
            raise ValueError("rows must be a power of two and heads below width")
        self.weights = np.zeros((2 * self.rows, self.width), np.float32)

    # -- words ----------------------------------------------------------------------------------------------------
    @property
    def tails(self) -> int:
        return self.width - self.heads

    @property
    def modelled(self) -> int:
        return min(self.heads * self.width, len(self.words))

    def tail_class(self, key: bytes) -> int:
        """The class of a word that is not modelled: by its last three bytes."""
        return zlib.crc32(key[-3:]) % self.tails

    def learn_words(self, vocab: DataFrame) -> None:
        """Counts, classes and unigram weights from the stored vocabulary: sums over all of it, and its most frequent
        words (at most ``dictionary`` keys of ``LONG`` bytes)."""
        self.total, self.distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        # steps of c, finer than a hundredth: the least c above which at most ``dictionary`` words lie
        step = F.floor(F.log2("c") * 64)
        sizes = sorted(((r["b"], r["n"]) for r in vocab.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        fits = [b for (b, _), n in zip(sizes, np.cumsum([n for _, n in sizes])) if n <= self.dictionary]
        top = vocab.where(step >= fits[-1]).toPandas().sort_values(["c", "word"], ascending=[False, True]) if fits else None
        self.words = [bytes(w) for w in top["word"]] if fits else []
        self.counts = top["c"].to_numpy(np.int64) if fits else np.zeros(0, np.int64)
        self.kinds = np.fromiter((self.heads + self.tail_class(w) for w in self.words), np.int32, len(self.words))
        self.kinds[:self.modelled] = np.arange(self.modelled) // self.width
        short = np.array([w[:1] != END for w in self.words], bool)
        hashes = np.full(len(self.words), END_HASH)
        own = [w.decode("utf-8", "surrogatepass") for w, s in zip(self.words, short.tolist()) if s]
        hashes[short] = Words([" ".join(own)]).hashes[:-1] if own else 0
        # a long word is in the dictionary by its digest: it is looked up by its key, not by its hash
        known = np.flatnonzero(short | np.array([w == END for w in self.words], bool))
        self.order = known[np.argsort(hashes[known], kind="stable")]
        self.hashes = hashes[self.order]
        ending = F.pmod(F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")), F.lit(self.tails))
        mass = np.zeros((2, self.tails))
        for r in vocab.groupBy(ending.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            mass[:, r["k"]] = r["c"], r["n"]
        for w, c in zip(self.words[:self.modelled], self.counts.tolist()):
            mass[:, self.tail_class(w)] -= c, 1
        self.tail_total = mass.sum(axis=0) + 1
        word_bias = np.full(self.heads * self.width, -1e9, np.float32)
        held = np.zeros(self.heads * self.width)
        held[:self.modelled] = self.counts[:self.modelled]
        held = held.reshape(self.heads, self.width).sum(axis=1)
        word_bias[:self.modelled] = np.log(self.counts[:self.modelled] / held[np.arange(self.modelled) // self.width])
        self.word_bias = word_bias.reshape(self.heads, self.width)
        both = np.concatenate([held, mass[0] + 1])
        self.class_bias = np.where(both > 0, np.log(np.maximum(both, 1) / both.sum()), -1e9).astype(np.float32)

    # -- features -------------------------------------------------------------------------------------------------
    def encode(self, texts: list[str], state: dict) -> dict:
        """Arrays over all words of ``texts`` in order: ``at`` (place in the dictionary or -1), ``kind`` (class),
        ``doc``, the three hashed rows of the history, and the keys of words outside the dictionary. ``state`` keeps
        the dictionary's lookups for the task."""
        if not state:
            state["long"] = {w: i for i, w in enumerate(self.words) if len(w) > 1 and w[:1] == END}
            state["kind"] = np.append(self.kinds, np.int32(0))
            state["hashes"], state["order"] = np.append(self.hashes, np.uint64(0)), np.append(self.order, 0)
        words = Words(texts)
        ids = words.hashes.copy()
        near = np.searchsorted(state["hashes"][:-1], ids)
        at = np.where((state["hashes"][near] == ids) & (near < len(self.hashes)), state["order"][near], -1)
        kind = state["kind"][at]
        missing, keys = [], []
        for i in np.flatnonzero(at < 0).tolist():
            key = key_of(words.word(i))
            known = state["long"].get(key, -1)
            if known >= 0:
                at[i], kind[i] = known, state["kind"][known]
            else:
                kind[i] = self.heads + self.tail_class(key)
                missing.append(i)
                keys.append(key)
        starts = words.last - words.sizes + 1
        before = []
        for back in (1, 2):
            p = np.full(len(ids), _START, np.uint64)
            p[back:] = ids[:-back]
            for j in range(back):
                first = starts + j
                p[first[first < len(ids)]] = _START  # a shorter text's next one starts with it as well
            before.append(p)
        one, two = before
        m = _MULTIPLIERS
        rows = np.stack([one * m[0], one * m[1] + two * m[2], two * m[3]])
        rows ^= rows >> np.uint64(29)
        return {"at": at, "kind": kind, "doc": words.doc, "rows": rows, "missing": missing, "keys": keys, "sizes": words.sizes}

    def _index(self, hashed: np.ndarray, kind: np.ndarray | None) -> np.ndarray:
        """Rows of the weights: of the class factor, or of the word factor within ``kind``."""
        shift = np.uint64(64 - self.rows.bit_length() + 1)
        if kind is None:
            return ((hashed * _MULTIPLIERS[5]) >> shift).astype(np.int64)
        return (((hashed + kind.astype(np.uint64) * _MULTIPLIERS[6]) * _MULTIPLIERS[7]) >> shift).astype(np.int64) + self.rows

    def _softmax(self, index: np.ndarray, bias: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of what is wanted, all exponentials, and their sums. Weights lie within ``CLIP`` and biases below 0, so no
        exponential overflows."""
        s, more = np.empty((2, index.shape[1], self.width), np.float32)
        np.take(self.weights, index[0], axis=0, out=s, mode="clip")
        for i in index[1:]:
            np.take(self.weights, i, axis=0, out=more, mode="clip")
            np.add(s, more, out=s)
        np.add(s, bias, out=s)
        np.exp(s, out=s)
        total = s @ np.ones(self.width, np.float32)
        return s[np.arange(len(s)), wanted] / total, s, total

    # -- learning -------------------------------------------------------------------------------------------------
    def descend(self, arrays: dict, grown: np.ndarray, touched: np.ndarray) -> None:
        """Gradient steps over the words in order, ``batch`` at a time, each row with a rate that falls with the squared
        gradients it has met. A batch steps along one kind of feature, the next along the next (block coordinates)."""
        for step, i in enumerate(range(0, len(arrays["at"]), self.batch)):
            part = slice(i, i + self.batch)
            hashed, kind, at = arrays["rows"][:, part], arrays["kind"][part], arrays["at"][part]
            index = self._index(hashed, None)
            _, p, total = self._softmax(index, self.class_bias, kind)
            p /= total[:, None]
            p[np.arange(len(p)), kind] -= 1
            self._step(index[step % len(index)], p, grown, touched)
            inside = np.flatnonzero((at >= 0) & (at < self.modelled))
            if len(inside):
                k = kind[inside]
                index = self._index(hashed[:, inside], k)
                wanted = at[inside] % self.width
                _, p, total = self._softmax(index, self.word_bias[k], wanted)
                p /= total[:, None]
                p[np.arange(len(p)), wanted] -= 1
                self._step(index[step % len(index)], p, grown, touched)

    def _step(self, index: np.ndarray, gradient: np.ndarray, grown: np.ndarray, touched: np.ndarray) -> None:
        base = index.min()
        order = np.argsort((index - base).astype(np.uint16 if self.rows <= 1 << 16 else np.uint32), kind="stable")
        rows = index[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        sums = np.add.reduceat(gradient[order], first, axis=0)
        rows = rows[first]
        grown[rows] += np.einsum("ij,ij->i", sums, sums)
        touched[rows] += np.diff(np.append(first, len(index)))
        sums *= (self.rate * math.sqrt(self.width) / np.sqrt(grown[rows] + 1))[:, None]
        self.weights[rows] = np.clip(self.weights[rows] - sums, -CLIP, CLIP)

    def round(self, texts: DataFrame, tasks: int, block: int = 256) -> None:
        """One round of distributed gradient updates. Every task descends over its texts from the shared weights and
        returns what it changed, in blocks of rows; a block's changes meet in one task, weighted by how often each
        task's words touched the row, and become the shared weights."""
        model = self

        def learn(batches):
            start = model.weights.copy()
            grown, touched, state = np.zeros(len(start), np.float32), np.zeros(len(start), np.float32), {}
            for batch in by_bytes(batches, "text", TEXT_BYTES):
                model.descend(model.encode(texts_of(batch, "text"), state), grown, touched)
            change = (model.weights - start).astype(np.float16)
            model.weights[:] = start  # a worker may run another task with the same model
            for b in range(0, len(start), block):
                held = np.flatnonzero(touched[b:b + block])
                if len(held):
                    cols = [[b // block], [held.astype(np.int32).tobytes()], [touched[b + held].tobytes()], [change[b + held].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                                     names=["block", "rows", "touched", "change"])

        width = self.width

        def meet(batches):
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # every block at most: the size of the weights
            for batch in batches:
                for b, rows, touched, change in zip(*(c.to_pylist() for c in batch.columns)):
                    rows, touched = np.frombuffer(rows, np.int32), np.frombuffer(touched, np.float32)
                    total, moved = sums.setdefault(b, (np.zeros(block, np.float32), np.zeros((block, width), np.float32)))
                    total[rows] += touched
                    moved[rows] += np.frombuffer(change, np.float16).reshape(-1, width) * touched[:, None]
            moves = [(m / np.maximum(t, 1)[:, None]).astype(np.float32).tobytes() for t, m in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(moves, pa.binary())], names=["block", "move"])

        changes = texts.select("text").coalesce(tasks).mapInArrow(learn, "block int, rows binary, touched binary, change binary")
        # as many bytes as the weights have
        for r in changes.repartition("block").mapInArrow(meet, "block int, move binary").toLocalIterator():
            self.weights[r["block"] * block:(r["block"] + 1) * block] += np.frombuffer(r["move"], np.float32).reshape(-1, width)

    # -- scoring --------------------------------------------------------------------------------------------------
    def word_scores(self, arrays: dict) -> np.ndarray:
        """Natural log-probability of every word in ``arrays``; for words outside the dictionary, of their class."""
        out = np.empty(len(arrays["at"]))
        for i in range(0, len(out), self.batch):
            part = slice(i, i + self.batch)
            hashed, kind, at = arrays["rows"][:, part], arrays["kind"][part], arrays["at"][part]
            got = np.log(self._softmax(self._index(hashed, None), self.class_bias, kind)[0].astype(float))
            inside = np.flatnonzero((at >= 0) & (at < self.modelled))
            if len(inside):
                k = kind[inside]
                got[inside] += np.log(self._softmax(self._index(hashed[:, inside], k), self.word_bias[k], at[inside] % self.width)[0].astype(float))
            tail = np.flatnonzero(at >= self.modelled)
            if len(tail):
                got[tail] += np.log((self.counts[at[tail]] + 1) / self.tail_total[kind[tail] - self.heads])
            out[part] = got
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, task_tokens: int = 2_000_000, **parameters) -> tuple[MaxentModel, DataFrame]:
    """The model learned from all texts that are not held out, and the stored vocabulary ``(word, c)``.

    Counts cover every such text. Each is then met once, in one of ``rounds`` rounds dealt by a hash, by about one
    task for ``task_tokens`` words. Weights depend a little on how Spark deals the texts to tasks; the counts do not."""
    model = MaxentModel(**parameters)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~is_held_out(F.col("id")))
    vocab = stored(vocabulary(rows), "lm-words")
    model.learn_words(vocab)
    tasks = max(1, -(-model.total // (task_tokens * rounds)))
    for r in range(rounds):
        if model.total:
            model.round(rows.where(F.pmod(F.xxhash64(F.lit(r // rounds), F.col("id").cast("string")), F.lit(rounds)) == r), tasks)
    return model, vocab


def score(docs: DataFrame, model: MaxentModel, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row for each row of ``docs``.

    ``base_score`` sums log10((c + 1) / (N + V + 1)) over the words and the end, ``score`` the model's log10
    probability. Words of the dictionary are scored where the text is read; the others are joined with the vocabulary
    on the word: none of them is frequent, so no key is hot. Null and empty texts are the end alone; repeated rows and
    null ids are scored each; other columns are not read; an empty table gives an empty table. With nothing to learn
    from, every word is the unknown one."""
    name = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<word: binary, k: int, n: long>>"
    floor = math.log10(model.total + model.distinct + 1)
    tail_kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32()), ("n", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        rid, state = TaskContext.get().partitionId() << 40, {}
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            got = model.encode(texts_of(batch, "text"), state)
            n, doc = batch.num_rows, got["doc"]
            known = got["at"] >= 0
            counts = np.append(model.counts, 0)[got["at"]]
            base = np.where(known, np.log10(counts + 1) - floor, 0.0)
            tails: list[dict] = [{} for _ in range(n)]
            for i, key in zip(got["missing"], got["keys"]):
                held = tails[doc[i]]
                held[key] = held.get(key, 0) + 1
            rows = [[{"word": w, "k": model.tail_class(w), "n": c} for w, c in t.items()] for t in tails]
            scores = np.bincount(doc, model.word_scores(got), n) / math.log(10)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(rid, rid + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(got["sizes"]),
                pa.array(np.bincount(doc, known, n).astype(np.int64)), pa.array(np.bincount(doc, base, n)), pa.array(scores), pa.array(rows, tail_kind)],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])
            rid += n

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    rows = stored(rows.mapInArrow(run, name), "lm-scores")
    rare = rows.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.k", "t.n").join(vocab, "word", "left")
    c = F.coalesce("c", F.lit(0))
    whole = F.element_at(F.array(*[F.lit(float(x)) for x in model.tail_total]), F.col("k") + 1)
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"))]
    rare = rare.select("rid", *empty, F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"),
                       (F.col("n") * (F.log10(c + 1) - floor)).alias("base_score"), (F.col("n") * F.log10((c + 1) / whole)).alias("score"))
    sums = rows.drop("tail").unionByName(rare).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
