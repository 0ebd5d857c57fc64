"""Sinks (K1-K9). Writers take a DataFrame and a path; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions.text import label_line, strip_ws


def write_shards(df: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "language"), mode: str = "append") -> None:
    """K1: one directory per ``(dataset, language)``; full codes are kept as
    keys, so ``zh-CN``/``zh-TW`` never collide (D3).

    ``rebalance`` groups rows by the keys (few files per shard) but lets AQE
    split a skewed shard over several tasks and merge small ones, so a shard
    holding a third of the corpus is not written by one task."""
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("append").json(path)


def write_label_text(df: DataFrame, path: str, language: str = "language", sentence: str = "sentence") -> None:
    """K3: ``__label__<lang> <sentence>`` lines; rows with an empty trimmed side are skipped."""
    line = label_line(language, sentence)
    ok = (strip_ws(sentence) != "") & F.col(language).isNotNull() & (F.col(language) != "")
    df.filter(ok).select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: headered CSV (quotes escaped with a double quote)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_summary(df: DataFrame, path: str) -> None:
    """K5: append summary rows; the schema lives in the files, so no header logic."""
    df.write.mode("append").parquet(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    """K6: a one-row JSON summary. More rows are an error: the single file is meant for one."""
    if len(df.take(2)) > 1:
        raise ValueError("a JSON summary has one row")
    df.coalesce(1).write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    """K7: ``split=train`` / ``split=dev`` directories."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_predictions(df: DataFrame, path: str, labels_col: str = "labels") -> None:
    """K8: sentence + label list; the list is written as a JSON array in CSV."""
    out = df.withColumn(labels_col, F.to_json(F.col(labels_col)))
    write_csv(out, path)


def resume(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """K9: rows whose keys are not in the manifest of finished shards."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
