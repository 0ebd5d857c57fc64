"""Operator 3: token ids as ORC files, and reading them back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from langmix.llm.encode import by_bytes, encoder, texts_of

SCHEMA = "doc_id long, part int, n_tokens int, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int, drops_space: bool, id_col: str = "doc_id",
                    text_col: str = "text", stripe_bytes: int = 64 << 20, index_stride: int = 1_000) -> None:
    """Encode whole texts, append ``end_id`` and write ``(doc_id, part, n_tokens, ids)`` in ascending doc_id order.

    Documents are dealt by ranges of the id before they are encoded, so each file holds one range in order and
    ``part`` numbers the ranges. ORC stores the ids in stripes by integer run-length encoding, with a row index every
    ``index_stride`` rows and Bloom filters on doc_id: readers take stripes in parallel and skip those whose
    statistics or filter exclude an id. Null texts are empty (the end id alone); null ids come first; rows with equal
    ids are ordered by their text.
    """
    spark = docs.sparkSession
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt = dealt.select("doc_id", F.spark_partition_id().alias("part"), "text")

    def run(batches):
        enc, end = encoder(tokenizer, drops_space), np.uint32(end_id).tobytes()
        for batch in by_bytes(batches, "text"):
            ids = [b + end for b in enc.encode(texts_of(batch, "text"))]
            n = np.array([len(b) // 4 for b in ids], np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(n), lists], names=["doc_id", "part", "n_tokens", "ids"])

    (
        dealt.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride).option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a filter on doc_id is pushed to stripe statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files: ``start`` counts the ids of all documents before.

    Ranges are summed first, by the length column alone, so the running sum over all documents is one over the ranges
    (one row for each) and one within each range. Lengths and checksums are taken from the ids read back."""
    def digest(batches):
        for batch in batches:
            col = batch.column("ids")
            off = np.asarray(col.offsets, dtype=np.int64)
            flat = np.ascontiguousarray(np.asarray(col.values, dtype=np.int32))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "n_tokens", "ids_crc32"])

    rows = read_token_orc(spark, path).select("doc_id", "part", "ids").mapInArrow(digest, "doc_id long, part int, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = read_token_orc(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    # one row for each range: bounded by the number of partitions
    return rows.join(F.broadcast(ranges), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
