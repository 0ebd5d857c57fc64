"""Language detection as Spark jobs (M1, M2, M4).

``CharNgramModel`` is a smoothed character n-gram language model:

    log P(doc | L) = sum_g count_doc(g) * log((c_L(g) + 1) / (N_L + V))

with ``c_L(g)`` the training count of gram g in language L, ``N_L`` the total
grams of L and ``V`` the number of distinct training grams. Splitting the sum
into ``T_doc * floor_L + sum_{g seen in L} count_doc(g) * ln(c_L(g) + 1)``
(``floor_L = -ln(N_L + V)``) means scoring only meets document grams with the
grams the model has seen. Probabilities are the softmax of the scores.

Grams of up to three code points are packed into a long. The model is one row
for each gram, with a vector of the languages that have it, so its rows follow
the grams, not grams times languages. There is one way of scoring at every
size: documents are dealt to blocks of about ``BLOCK_BYTES`` of text where they
are read; a block asks for each of its distinct grams once, and its documents
are scored where the answers meet them. What moves is one row for each gram of
a block, and a document's grams as places in its block; nothing is broadcast
but the ``HOT`` most frequent grams at most, whose rows are salted.

The detector interface (M1) is ``transform(df, id_col, text_col)`` ->
``id, pred_lang, pred_prob, top_preds array<struct<lang, prob>>``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from langmix.functions.arrow import ragged, runs, slices
from langmix.functions.text import ngram_text
from langmix.session import stored

#: Bytes of text in a block of documents, and in what a task counts at once. A task needs about a hundred times as much.
BLOCK_BYTES, COUNT_BYTES = 1 << 20, 1 << 20
#: Grams with at least one in so many of all training grams are salted (so many of each order at most).
HOT, SALTS = 10_000, 16
#: (language, gram) counts that a task holds before it hands them on.
HELD = 1_000_000
_DIGIT = np.int64(21)


@dataclass
class CharNgramModel:
    n: int
    counts: DataFrame  # n, label, g, c
    vectors: DataFrame  # n, g, v: array of (language's place, delta)
    hot: np.ndarray  # packed grams that are salted, ascending
    floors: dict[str, float]  # label -> floor (one entry per language: a small dimension)
    places: list[str]  # the languages in the order of the vectors' places
    vocab_size: int = 0

    @property
    def labels(self) -> list[str]:
        return sorted(self.floors)

    @property
    def grams(self) -> DataFrame:
        return self.counts.where(F.col("n") == self.n).select("label", "g", F.log(F.col("c") + 1).alias("delta"))

    def transform(self, df: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
        return detect_all({self.n: self}, df, id_col, text_col, k).drop("n")


def pack_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of code points of ``texts`` in order, packed, and which text each belongs to. Code points plus one
    are digits of 21 bits, so grams of different orders differ; beyond three digits a 64-bit hash stands for them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    digits = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    inside = np.arange(len(digits)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.flatnonzero(inside + n <= np.repeat(sizes, sizes))
    g = digits[first]
    for k in range(1, n):
        g = (g << _DIGIT) | digits[first + k] if n <= 3 else (g ^ (g >> np.int64(29))) * np.int64(0x9E3779B97F4A7C1) + digits[first + k]
    if n > 3:
        g = (g << np.int64(4)) | np.int64(n % 16) | np.int64(-1 << 63)
    return g, np.repeat(np.arange(len(texts)), sizes)[first]


def fit_char_ngram_multi(train: DataFrame, text_col: str, label_col: str, ns=(1, 2, 3)) -> dict[int, CharNgramModel]:
    """M2 fit of several n-gram orders from one scan: tasks count (language, gram) first, in bounded memory; one
    grouped sum and one table of vectors serve all orders. Null texts have no grams."""
    orders = sorted(ns)

    def merge(parts):
        g, c = (np.concatenate(x) for x in zip(*parts))
        at = np.argsort(g, kind="stable")
        g, c = g[at], c[at]
        first = runs(g)
        return g[first], np.add.reduceat(c, first) if len(first) else c

    most, slice_bytes = HELD, COUNT_BYTES

    def count(batches):
        held: dict[tuple, list] = {}  # order and language -> sorted grams and their counts
        rows = 0

        def rows_of(n, label, g, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array([label], pa.string()).take(pa.array(np.zeros(len(g), np.int32))),
                                               pa.array(g), pa.array(c)], names=["n", "label", "g", "c"])

        for batch in slices(batches, "p", slice_bytes):
            texts: dict[str, list] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("p").to_pylist()):
                texts.setdefault(label, []).append(text)
            for label, own in texts.items():
                for n in orders:
                    g, c = np.unique(pack_grams(own, n)[0], return_counts=True)
                    held.setdefault((n, label), []).append((g, c))
                    rows += len(g)
            if rows > most:
                held = {k: [merge(v)] for k, v in held.items()}
                rows = sum(len(v[0][0]) for v in held.values())
                if rows > most // 2:
                    for k, v in held.items():
                        yield rows_of(*k, *v[0])
                    held, rows = {}, 0
        for k, v in held.items():
            yield rows_of(*k, *merge(v))

    padded = train.select(F.col(label_col).alias("label"), ngram_text(text_col).alias("p")).where("p is not null and label is not null")
    parts = padded.mapInArrow(count, "n int, label string, g long, c long")
    counts = stored(parts.groupBy("n", "label", "g").agg(F.sum("c").alias("c")), "ngram-counts")
    totals = counts.groupBy("n", "label").agg(F.sum("c").alias("total")).collect()  # one row for each language and order
    names = sorted({r["label"] for r in totals})
    places = counts.sparkSession.createDataFrame(list(enumerate(names)), "i int, label string")
    vectors = counts.join(places, "label").groupBy("n", "g").agg(
        F.sort_array(F.collect_list(F.struct("i", F.log(F.col("c") + 1).alias("d")))).alias("v"), F.sum("c").alias("c"))
    vectors = stored(vectors, "ngram-vectors")
    sizes = {r["n"]: (r["v"], r["c"]) for r in vectors.groupBy("n").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c")).collect()}
    frequent = F.lit(False)
    for n, (_, c) in sizes.items():
        frequent = frequent | ((F.col("n") == n) & (F.col("c") * HOT >= c))
    hot = {n: [] for n in orders}
    for r in vectors.where(frequent).select("n", "g").collect():  # HOT for each order at most
        hot[r["n"]].append(r["g"])
    models = {}
    for n in orders:
        v = sizes.get(n, (0, 0))[0]
        own = [r for r in totals if r["n"] == n]
        # an order may lack a language whose texts are too short for it: it has no floor, as if never trained
        floors = {r["label"]: -math.log(r["total"] + v) for r in own}
        models[n] = CharNgramModel(n, counts, vectors, np.sort(np.array(hot[n], np.int64)), floors, names, v)
    return models


def fit_char_ngram(train: DataFrame, text_col: str, label_col: str, n: int = 3) -> CharNgramModel:
    """M2 fit of one order."""
    return fit_char_ngram_multi(train, text_col, label_col, (n,))[n]


def _dealt(df: DataFrame, id_col: str, text_col: str, orders: list[int]) -> DataFrame:
    """Blocks of documents: a row for each document (its grams as places in its block's list, and their counts), and
    one for each block (its distinct grams)."""
    rows = df.select(F.col(id_col).alias("id"), ngram_text(text_col).alias("p"))
    schema = StructType([StructField("block", LongType()), StructField("id", rows.schema["id"].dataType), StructField("length", LongType()),
                         *(StructField(c, BinaryType()) for c in ("at", "k", "grams"))])

    most = BLOCK_BYTES

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "p", most):
            texts = [t or "" for t in batch.column("p").to_pylist()]
            names, found, base = [], [], 0
            for n in orders:  # grams of different orders differ, so each order has its own part of the block's list
                g, doc = pack_grams(texts, n)
                g, place = np.unique(g, return_inverse=True)
                key, k = np.unique(doc * len(g) + place, return_counts=True)
                doc, at = np.divmod(key, max(len(g), 1))
                found.append(((at + base).astype(np.int32), k.astype(np.int32), np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()))
                names.append(g)
                base += len(g)
            grams = np.concatenate(names)
            at = [b"".join(x[ends[i]:ends[i + 1]].tobytes() for x, _, ends in found) for i in range(len(texts))]
            k = [b"".join(x[ends[i]:ends[i + 1]].tobytes() for _, x, ends in found) for i in range(len(texts))]
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(texts) + 1, block)), pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                pa.concat_arrays([pa.compute.utf8_length(batch.column("p")).cast(pa.int64()), pa.nulls(1, pa.int64())]),
                pa.array([*at, None], pa.binary()), pa.array([*k, None], pa.binary()),
                pa.array([None] * len(texts) + [grams.tobytes()], pa.binary())], names=schema.names)
            block += 1

    return stored(rows.mapInArrow(run, schema), "ngram-blocks")


def detect_all(models: Mapping[int, CharNgramModel], df: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """M1/M4 for models fitted together: ``n``, the id, and the top-k languages with softmax probabilities for every
    row and order, from one pass over the whole texts. A null text gives nulls."""
    orders = sorted(models)
    some = models[orders[0]]
    rows = _dealt(df, id_col, text_col, orders)
    hot = np.sort(np.concatenate([models[n].hot for n in orders]))

    def ask(batches):
        for batch in batches:
            for block, grams in zip(batch.column("block").to_pylist(), batch.column("grams").to_pylist()):
                g = np.frombuffer(grams, np.int64)
                near = np.minimum(np.searchsorted(hot, g), max(len(hot) - 1, 0))
                salt = np.where(hot[near] == g, block % SALTS, 0) if len(hot) else np.zeros(len(g), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g), pa.array(salt.astype(np.int32))],
                                                 names=["block", "at", "g", "salt"])

    asked = rows.where("grams is not null").select("block", "grams").mapInArrow(ask, "block long, at int, g long, salt int")
    vectors = some.vectors.where(F.col("n").isin(orders))
    hot_rows = some.counts.sparkSession.createDataFrame([(int(g),) for g in hot], "g long")  # HOT for each order at most
    copies = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = vectors.join(F.broadcast(hot_rows.withColumn("is_hot", F.lit(True))), "g", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    salted = salted.select("n", "g", "v", F.explode(copies).alias("salt"))
    told = asked.join(salted, ["g", "salt"]).select("block", "at", "n", "v")

    floors = {n: np.array([m.floors.get(x, -np.inf) for x in m.places]) for n, m in models.items()}
    docs = rows.where("grams is null").drop("grams")
    best = ArrayType(StructType([StructField("lang", StringType()), StructField("prob", DoubleType())]))
    schema = StructType([StructField("n", IntegerType()), StructField(id_col, docs.schema["id"].dataType), StructField("pred_lang", StringType()),
                         StructField("pred_prob", DoubleType()), StructField("top_preds", best)])
    names = some.places

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        score, length = _scores(left, right, orders, floors)
        ids = left["id"].combine_chunks()
        out = []
        for j, n in enumerate(orders):
            # languages in order of their names, so a stable sort breaks ties by name
            some = np.flatnonzero(np.isfinite(floors[n]))
            order = np.argsort(-score[:, j, some], axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(score[:, j, some], order, axis=1)
            peak = score[:, j, some].max(axis=1, keepdims=True) if len(some) else np.zeros((len(score), 1))
            prob = np.exp(top - peak) / np.exp(score[:, j, some] - peak).sum(axis=1, keepdims=True)
            lang = [[names[i] for i in some[o]] for o in order.tolist()]
            preds = [[{"lang": x, "prob": p} for x, p in zip(a, b)] if m is not None and a else None for a, b, m in zip(lang, prob.tolist(), length)]
            out.append(pa.Table.from_arrays([
                pa.array(np.full(len(score), n, np.int32)), ids, pa.array([p[0]["lang"] if p else None for p in preds], pa.string()),
                pa.array([p[0]["prob"] if p else None for p in preds], pa.float64()),
                pa.array(preds, pa.list_(pa.struct([("lang", pa.string()), ("prob", pa.float64())])))], names=schema.names))
        return pa.concat_tables(out)

    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(meet, schema)


def _scores(left: pa.Table, right: pa.Table, orders: list[int], floors: dict[int, np.ndarray]) -> tuple[np.ndarray, list]:
    """Scores of a block's documents (document, order, language) and their lengths. ``right``: the block's grams that
    the model has, by their place in the block's list."""
    length = left["length"].to_pylist()
    languages = len(floors[orders[0]])
    score = np.zeros((len(length), len(orders), languages))
    at = right["at"].to_numpy()
    vectors = right["v"].combine_chunks()
    vectors = vectors if isinstance(vectors, pa.ListArray) else pa.concat_arrays(vectors.chunks) if vectors.num_chunks else None
    begins = np.asarray(vectors.offsets, np.int64) if len(at) else np.zeros(1, np.int64)
    values = vectors.values if len(at) else None
    language = values.field("i").to_numpy() if len(at) else np.zeros(0, np.int64)
    delta = values.field("d").to_numpy() if len(at) else np.zeros(0)
    order = np.searchsorted(orders, right["n"].to_numpy()) if len(at) else np.zeros(0, np.int64)
    slot = np.full(int(at.max()) + 1 if len(at) else 0, -1)
    slot[at] = np.arange(len(at))
    for i, (places, counts) in enumerate(zip(left["at"].to_pylist(), left["k"].to_pylist())):
        places, counts = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32)
        inside = places < len(slot)
        met = slot[places[inside]]
        counts = counts[inside][met >= 0]
        met = met[met >= 0]
        sizes = begins[met + 1] - begins[met]
        where = ragged(begins[met], sizes)
        key = np.repeat(order[met] * languages, sizes) + language[where]
        score[i] = np.bincount(key, np.repeat(counts, sizes) * delta[where], len(orders) * languages).reshape(len(orders), languages)
        for j, n in enumerate(orders):
            score[i, j] += max((length[i] or 0) - n + 1, 0) * np.where(np.isfinite(floors[n]), floors[n], 0.0)
    return score, length
