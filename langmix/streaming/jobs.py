"""Structured Streaming jobs (ST1-ST5, A4, K10).

Every stream runs with ``trigger(availableNow=True)`` over a parquet file
source, checkpoints into the shared checkpoint folder, and writes
idempotently: partial results are keyed by ``batch_id`` and each micro-batch
overwrites only its own partition, so a replayed batch after an executor or
driver loss rewrites the same rows instead of duplicating them (ST3). A job
given the folder of :func:`job_folder` goes on where a killed run stopped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.session import ensure_checkpoint_dir, scratch_path


def parquet_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 4096) -> DataFrame:
    """File-source stream over ``<dir>/<name>*.parquet`` with the batch schema."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(f"{sf_dir.rstrip('/')}/{name}*.parquet")
    )


def job_folder(spark: SparkSession, name: str, inputs: list[str], **parameters) -> str:
    """ST3: the folder of a job in the shared folder, named by what the job is: its name, its parameters, and its input
    files with their sizes and times. The same job finds its folder again, and in it the stream's checkpoint and the
    batches it has written; other files or parameters make another job. ``_manifest`` in the folder says in JSON what
    it belongs to."""
    listed = spark.read.format("binaryFile").load(inputs).select("path", "length", "modificationTime")  # contents are not read
    mark = listed.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
                      F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).cast("string").alias("mark")).first()
    what = {"job": name, "inputs": inputs, "files": mark["files"], "bytes": mark["bytes"], "mark": mark["mark"], "parameters": {k: str(v) for k, v in sorted(parameters.items())}}
    text = json.dumps(what, sort_keys=True)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{hashlib.md5(text.encode()).hexdigest()[:16]}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_manifest")
    return folder


def run_available(stream: DataFrame, sink: Callable, checkpoint: str) -> None:
    """Drive a stream to completion over the data available now."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _overwrite_batch(df: DataFrame, path: str, batch_id: int, partition_cols: tuple[str, ...] = ()) -> None:
    """Idempotent per-batch write: replace only this batch's partitions."""
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols, "batch_id")
        .parquet(path)
    )


def stream_profile(spark: SparkSession, stream: DataFrame, out: str | None = None) -> dict[str, DataFrame]:
    """ST2/A4/K10: per micro-batch persist partial counters keyed by batch_id,
    then merge them into the A1/A2/A3 summaries. The median comes from the
    merged ``(language, num_tokens, count)`` histogram, so it is exact."""
    out = out or scratch_path(spark, "stream-profile")

    def sink(batch: DataFrame, batch_id: int) -> None:
        stats = batch.select(
            "language",
            "dataset",
            T.num_tokens("sentence").alias("t"),
            T.char_length("sentence").alias("c"),
            T.has_special_char("sentence").cast("long").alias("s"),
        )
        hist = stats.groupBy("language", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        _overwrite_batch(hist, f"{out}/lengths", batch_id)
        _overwrite_batch(stats.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), f"{out}/datasets", batch_id)

    run_available(stream, sink, f"{out}/_checkpoint")
    hist = spark.read.parquet(f"{out}/lengths").groupBy("language", "t").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s")
    )
    language = hist.groupBy("language").agg(
        F.sum("n").alias("num_sentences"),
        F.sum(F.col("t") * F.col("n")).alias("total_tokens"),
        F.sum("c").alias("total_chars"),
        F.sum(F.when(F.col("t") <= T.SHORT_MAX_TOKENS, F.col("n")).otherwise(0)).alias("short_sentences"),
        F.sum("s").alias("special_char_sentences"),
        F.round(F.sum(F.col("t") * F.col("n")) / F.sum("n"), 6).alias("mean_tokens"),
        F.expr("percentile(t, 0.5, n)").alias("median_tokens"),
        F.min("t").cast("long").alias("min_tokens"),
        F.max("t").cast("long").alias("max_tokens"),
    )
    datasets = spark.read.parquet(f"{out}/datasets").groupBy("dataset").agg(F.sum("n").alias("num_sentences"))
    n_datasets = datasets.count()  # a scalar
    total = language.agg(
        F.sum("num_sentences").alias("total_sentences"),
        F.count(F.lit(1)).alias("total_languages"),
        F.lit(n_datasets).cast("long").alias("total_datasets"),
    )
    return {"language": language, "dataset": datasets, "global": total}


def stream_ingest(spark: SparkSession, stream: DataFrame, out: str | None = None) -> DataFrame:
    """ST1/ST4: append a stream grouped by language (``partitionBy``), in place
    of the periodic in-memory flush; returns the written table. Filters and
    trims are the caller's, on the stream."""
    out = out or scratch_path(spark, "stream-ingest")

    def sink(batch: DataFrame, batch_id: int) -> None:
        _overwrite_batch(batch, f"{out}/data", batch_id, ("language",))

    run_available(stream, sink, f"{out}/_checkpoint")
    return spark.read.parquet(f"{out}/data").drop("batch_id")


def stream_map(spark: SparkSession, stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str | None = None) -> DataFrame:
    """ST5: apply a batch job (e.g. a detector transform) to each micro-batch and
    append its result idempotently; returns the written table."""
    out = out or scratch_path(spark, "stream-map")

    def sink(batch: DataFrame, batch_id: int) -> None:
        _overwrite_batch(fn(batch), f"{out}/data", batch_id)

    run_available(stream, sink, f"{out}/_checkpoint")
    return spark.read.parquet(f"{out}/data").drop("batch_id")
