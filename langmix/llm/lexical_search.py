"""Operator 12: ranked lexical search by norm buckets of impact vectors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from langmix.llm.common import stored
from langmix.llm.encode import by_bytes, texts_of

#: UTF-8 bytes: digits, letters in lower case (A-Z only) and all of other characters as they are, else a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What floating-point bounds are raised by, so that they stay bounds.
SLACK = 1 + 1e-9
NO_ID = (1 << 63) - 1


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters beyond ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def term_counts(docs: DataFrame, index: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, cols, tf)`` of whole texts: all terms with repeats, and of the terms in ``index`` their numbers
    (ascending) and counts, four bytes each."""
    def run(batches):
        get = index.get
        for batch in by_bytes(batches, "text"):
            n, cols, tf = [], [], []
            for text in texts_of(batch, "text"):
                found = terms(text)
                ids = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
                col, count = np.unique(ids[ids >= 0], return_counts=True)
                n.append(len(found))
                cols.append(col.tobytes())
                tf.append(count.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cols, pa.binary()), pa.array(tf, pa.binary())],
                                             names=["doc_id", "n", "cols", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, cols binary, tf binary")


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of ``size`` terms occurs: one count for each term and task."""
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("cols").to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in counts.select("cols").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def with_norms(counts: DataFrame, documents: int, length: int) -> DataFrame:
    """``(doc_id, norm, cols, impact)``: the impact vectors of the documents that hold a term, and their lengths."""
    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            base = 100 - 25 + 25 * n * documents // length
            impacts, norms = [], []
            for m, b in zip(base.tolist(), batch.column("tf").to_pylist()):
                tf = np.frombuffer(b, np.int32).astype(np.int64)
                x = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                impacts.append(x.astype(np.int32).tobytes())
                norms.append(math.sqrt(float((x * x).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norms), batch.column("cols"), pa.array(impacts, pa.binary())],
                                             names=["doc_id", "norm", "cols", "impact"])

    return counts.where("octet_length(cols) > 0").mapInArrow(run, "doc_id long, norm double, cols binary, impact binary")


class Query:
    """An item as a vector: its terms by falling value, and the length of what follows each place."""

    def __init__(self, found: Iterable[bytes], index: dict[bytes, int], weights: np.ndarray):
        held = Counter(index[t] for t in found)
        cols = np.fromiter(held, np.int64, len(held))
        value = weights[cols] * np.fromiter(held.values(), np.int64, len(held)) if len(held) else np.zeros(0, np.int64)
        order = np.lexsort([cols, -value])
        self.cols, self.value = cols[order], value[order]
        self.rest = np.sqrt(np.append(np.cumsum((self.value.astype(float) ** 2)[::-1])[::-1], 0.0))


class Bucket:
    """Documents of about one length, longest first, and their impacts by term."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, cols: list[bytes], impacts: list[bytes], size: int):
        self.ids, self.norms = ids, norms
        self.cols = np.frombuffer(b"".join(cols), np.int32)
        self.impact = np.frombuffer(b"".join(impacts), np.int32).astype(np.int64)
        self.ends = np.cumsum(np.fromiter((len(c) // 4 for c in cols), np.int64, len(cols)))
        doc = np.repeat(np.arange(len(ids)), np.diff(self.ends, prepend=0))
        order = np.argsort(self.cols, kind="stable")
        self.doc, self.by_term = doc[order], self.impact[order].astype(float)
        self.starts = np.searchsorted(self.cols[order], np.arange(size + 1))

    def survivors(self, q: Query, least: float) -> np.ndarray:
        """Documents that may score ``least`` or more.

        Cauchy-Schwarz leaves the whole bucket out if its longest vector can't reach ``least``. Else the query's
        largest coordinates are scanned, as few as leave a rest that can't reach it alone: a document without any of
        them is out, the others keep what they have scored and at most the rest's length times their own."""
        top = self.norms[0] * SLACK
        if q.rest[0] * top < least:
            return np.zeros(0, np.int64)
        focus = int(np.argmax(q.rest * top < least)) if q.rest[-1] * top < least else len(q.cols)
        score = np.zeros(len(self.ids))
        for t, v in zip(q.cols[:focus].tolist(), q.value[:focus].tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            score[self.doc[at]] += v * self.by_term[at]
        seen = np.flatnonzero(score)
        return seen[(score[seen] + q.rest[focus] * self.norms[seen]) * SLACK >= least]

    def scores(self, chosen: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores in integers."""
        begins = self.ends[chosen] - np.diff(self.ends, prepend=0)[chosen]
        return np.array([int((dense[self.cols[a:b]] * self.impact[a:b]).sum()) for a, b in zip(begins.tolist(), self.ends[chosen].tolist())], np.int64)


def search(vectors: DataFrame, queries: list[Query], size: int, k: int, least: list[int], bucket: int = 4_096) -> DataFrame:
    """``(q, doc_id, score)``: of each task's documents the ``k`` best for each query, if they score ``least[q]`` or
    more. A task meets its documents in the order of the frame; the longer come first, so thresholds rise early."""
    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        floor = list(least)
        dense = np.zeros(size, np.int64)
        for ids, norms, cols, impacts in _buckets(batches, bucket):
            held = Bucket(ids, norms, cols, impacts, size)
            for i, q in enumerate(queries):
                chosen = held.survivors(q, floor[i])
                if not len(chosen):
                    continue
                dense[q.cols] = q.value
                score = np.append(best[i][1], held.scores(chosen, dense))
                dense[q.cols] = 0
                doc = np.append(best[i][0], held.ids[chosen])
                order = np.lexsort([doc, -score])[:k]
                order = order[score[order] >= floor[i]]
                best[i] = doc[order], score[order]
                if len(order) == k:
                    floor[i] = max(floor[i], int(score[order[-1]]))
        doc = np.concatenate([np.zeros(0, np.int64), *(d for d, _ in best)])
        names = np.repeat(np.arange(len(best)), [len(d) for d, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(doc, mask=doc == NO_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s in best)]))],
                                         names=["q", "doc_id", "score"])

    return vectors.select("doc_id", "norm", "cols", "impact").mapInArrow(run, "q int, doc_id long, score long")


def _buckets(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Slices of at most ``most`` documents."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            part = batch.slice(i, most)
            yield part.column("doc_id").fill_null(NO_ID).to_numpy(), part.column("norm").to_numpy(), part.column("cols").to_pylist(), part.column("impact").to_pylist()


def first_thresholds(vectors: DataFrame, queries: list[Query], size: int, k: int, seeds: int) -> list[int]:
    """Each query's ``k``-th best score among the longest vectors, about ``seeds`` of them (all of the last step of
    length that is needed); 1 where fewer score."""
    step = F.floor(F.log2("norm") * 64)
    sizes = sorted(((r["b"], r["n"]) for r in vectors.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least = [1] * len(queries)
    if sizes:
        total = np.cumsum([n for _, n in sizes])
        cut = sizes[min(int(np.searchsorted(total, seeds)), len(sizes) - 1)][0]
        found = search(vectors.where(step >= cut), queries, size, k, least)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        for r in ranked.where(F.col("rank") == k).select("q", "score").collect():
            least[r["q"]] = r["score"]
    return least


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_bytes: int = 4 << 20, seeds: int = 2_000) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item the ``k`` documents of the highest score above 0.

    A document is a vector of impacts, 10^9 tf div (1000 tf + 12 m) with m = 75 + 25 n N div L for its number of
    terms n; an item one of weights floor(1000 ln((2N + 2) / (2 df + 1))) times its counts; the score is their dot
    product, in integers. Documents are dealt by falling length of their vectors, so that each task holds buckets of
    about one length; the best scores of the ``seeds`` longest vectors are every task's first thresholds. They only
    bound the search: every document is a candidate until a bound rules it out, and survivors are scored exactly.

    Items are met in blocks of about ``block_bytes`` of their text (a longer one alone), which is also what bounds the
    terms, weights and thresholds that tasks get. Equal scores rank by ascending id, a null id last; rows of documents
    or items with one id count and are ranked each. Null texts have no terms; items without terms have no rows; other
    columns are not read; empty tables give an empty table."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        got = asked.where(F.col("block") == block).select("item_id", "text").collect()
        found = [terms(r["text"]) for r in got]
        index = {t: i for i, t in enumerate(sorted(set().union(*found)))} if found else {}
        if not index:
            continue
        counts = stored(term_counts(docs, index, id_col, text_col), "search-counts")
        documents, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        df = document_frequencies(counts, len(index))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        queries = [Query(f, index, weights) for f in found]
        vectors = with_norms(counts, documents, length)
        least = first_thresholds(vectors, queries, len(index), k, seeds)
        dealt = vectors.repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id")
        met = search(dealt, queries, len(index), k, least)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(got)], f"q int, item_id {kind}")
        out = out.unionByName(ranked.join(names, "q").select("item_id", "rank", "doc_id", "score"))
    return out
