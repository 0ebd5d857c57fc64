"""Derived fixtures: every query starts from the driver's tables through these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.operators.corpus import canonicalise_documents
from langmix.session import ensure_checkpoint_dir
from langmix.sources.tables import code_dimension, table


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Raise parallelism only when a scan yields fewer partitions than cores
    (the fixture files are single row groups). On a cluster the scan already
    has thousands of splits and this is a no-op. Hash-partition by a key when
    one is given: a round-robin repartition would sort every row first to stay
    deterministic on retry."""
    spark = df.sparkSession
    try:
        want = spark.sparkContext.defaultParallelism
        have = len(df.inputFiles())  # from the file listing: no job runs
    except Exception:  # noqa: BLE001 - e.g. a remote session without RDD access: leave it to AQE
        return df
    if have >= want:
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical corpus ``(doc_id, sentence, data_lang, language, dataset)``."""
    return canonicalise_documents(documents(spark, sf_dir), code_dimension(spark))


def with_order(df: DataFrame, id_col: str = "doc_id", seed: int | str = 42, name: str = "h") -> DataFrame:
    return df.withColumn(name, F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
