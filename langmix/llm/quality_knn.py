"""Operator 2: quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from langmix.llm.common import blank_words, without
from langmix.llm.encode import by_bytes, texts_of

RUNS = re.compile(r"(.)\1+", re.S)
#: Hashed term space, latent dimensions, neighbours that vote, documents in a block of products.
TERMS, LATENT, VOTERS, BLOCK = 4096, 64, 21, 256
#: Words that a worker remembers the terms of.
REMEMBERED = 200_000


def _shape(word: str) -> str:
    """``Word,`` is ``Aa,`` and ``WORD!!`` is ``A!+``: letters by case, digits as 0, runs of the rest marked."""
    out = []
    for c in word:
        out.append("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c)
    return RUNS.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] + "+", "".join(out))[:24]


def _slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % TERMS


class _WordTerms(dict):
    """Word -> its two hashed terms as one number, worked out when first met."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = _slot("w" + word[:64].lower()) * TERMS + _slot("s" + _shape(word[:64]))
        return got


_terms = _WordTerms()


def text_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a whole text and their share of it: words, word shapes, a word that repeats the one before,
    a line that repeats an earlier one. Each kind sums to one, as far as it occurs; an empty text has none."""
    words = blank_words(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    pairs = np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))
    again = sum(map(operator.eq, words, words[1:]))
    lines = text.split("\n")
    weight = np.bincount(pairs // TERMS, minlength=TERMS) + SHAPE * np.bincount(pairs % TERMS, minlength=TERMS)
    weight = weight / len(words)
    weight[_slot("repeated word")] += SHAPE * again / len(words)
    weight[_slot("repeated line")] += SHAPE * (len(lines) - len(set(lines))) / len(lines)
    at = np.flatnonzero(weight)
    return at.astype(np.int32), np.sqrt(weight[at]).astype(np.float32)


#: Weight of shapes and repetitions against words.
SHAPE = 4.0


class LatentModel:
    """Inverse document frequencies, the projection to the latent space, and the labelled vectors in it."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], seed: int = 5):
        self.labels = np.asarray(labels, np.float32)
        n = len(rows)
        x = np.zeros((n, TERMS), np.float32)
        for i, (at, w) in enumerate(rows):
            x[i, at] = w
        self.idf = (np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]  # no second matrix on the driver
        k = min(LATENT, max(n, 1))
        q = np.random.default_rng(seed).standard_normal((TERMS, k + 16)).astype(np.float32)
        for _ in range(4):  # randomised range finder for the leading right singular vectors
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.project = np.ascontiguousarray((q @ vt.T)[:, :k], dtype=np.float32)
        self.vectors = self._unit(x @ self.project)
        self.prior = float(self.labels.mean()) if n else 1.0

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vector(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        w = w * self.idf[at]
        return (w / max(float(np.linalg.norm(w)), 1e-9)) @ self.project[at] if len(at) else np.zeros(self.project.shape[1], np.float32)

    def scores(self, rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Exact cosines of every row with every labelled vector, a block at a time; the nearest vote by similarity.
        Rows without terms, or without a labelled neighbour, get the share of label 1."""
        got = [self.vector(*r) for r in rows]
        out = np.full(len(got), self.prior)
        if not len(self.labels) or not got:
            return out
        v = self._unit(np.vstack(got).astype(np.float32))
        k = min(VOTERS, len(self.labels))
        for i in range(0, len(v), BLOCK):
            cos = v[i:i + BLOCK] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
            weight = np.maximum(np.take_along_axis(cos, near, 1), 0) ** 4
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[i:i + BLOCK] = np.where(total > 1e-9, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def held_out(id_col: str):
    """The rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, quality)`` of at most ``bound`` labelled rows that may be learned from, picked by a hash of the
    id. Ids are picked from the labels alone; the texts are found with a broadcast of that bounded list."""
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("__id"), "__id").limit(bound)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.join(F.broadcast(picked), rows["id"] == picked["__id"]).select("id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8_192, id_col: str = "doc_id", text_col: str = "text") -> LatentModel:
    """Learn from at most ``bound`` labelled rows: their terms (not their texts) come to the driver, some 4 KB each."""
    sample = labelled_sample(docs, labels, bound, id_col, text_col)

    def run(batches):
        for batch in by_bytes(batches, "text"):
            rows = [text_terms(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([w.tobytes() for _, w in rows], pa.binary()),
                batch.column("quality")], names=["id", "at", "w", "quality"])

    got = sample.mapInArrow(run, "id long, at binary, w binary, quality int").toArrow().sort_by("id").to_pylist()[:bound]
    return LatentModel([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["w"], np.float32)) for r in got], [int(r["quality"] > 0) for r in got])


def classify(docs: DataFrame, model: LatentModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns and ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold``); they replace input
    columns of that name.

    The labelled vectors and the projection are broadcast (bounded by the sample: some 3 MB). Each document's whole
    text becomes one vector in the scan's own task, without a shuffle; nothing but the text enters its score. Null
    and empty texts, and all texts if there is no label to learn from, get the share of label 1 (1.0 without any).
    Repeated rows score alike; a null id is not held out. An empty table gives an empty table.
    """
    names = ("held_out", "score", "predicted")
    rows = docs.select(*without(docs, *names), held_out(id_col).alias("held_out"))
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in by_bytes(batches, text_col):
            s = sent.value.scores(map(text_terms, texts_of(batch, text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)
