"""User-function surface (UD1, UD2, M1 user detectors).

Column expressions come first; these are the escape hatches. Python runs in
Arrow batches through ``mapInPandas`` -- never row-at-a-time UDFs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTOR_SCHEMA = "pred_lang string, pred_prob double"


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """UD1: apply a pandas function to each Arrow batch of every partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def pandas_detector(df: DataFrame, id_col: str, text_col: str,
                    predict: Callable[[list[str]], list[tuple[str | None, float | None]]],
                    id_type: str = "bigint") -> DataFrame:
    """M1 for a user-supplied detector (any per-text library): ``predict`` maps a
    batch of texts to (label, probability) pairs. When a batch fails,
    its texts are predicted one by one, and only those that fail get nulls;
    newlines are removed before prediction (F13)."""

    def one(text: str) -> tuple[str | None, float | None]:
        try:
            return predict([text])[0]
        except Exception:  # noqa: BLE001 - detector failure gives nulls (M1)
            return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text_col].fillna("").str.replace("\n", "", regex=False).tolist()
            try:
                preds = predict(texts)
            except Exception:  # noqa: BLE001 - detector failure gives nulls (M1)
                preds = [one(t) for t in texts]
            langs, probs = [p[0] for p in preds], [p[1] for p in preds]
            yield pd.DataFrame({id_col: b[id_col], "pred_lang": langs, "pred_prob": probs})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, {DETECTOR_SCHEMA}")


def safe_map(df: DataFrame, column: str, expr: Column, out: str) -> tuple[DataFrame, DataFrame]:
    """UD2: ``expr`` should be a ``try_*`` expression (null on failure). Rows
    whose input is set but whose result is null keep the input value and are
    also reported in a rejects DataFrame."""
    mapped = df.withColumn(out, expr)
    failed = F.col(column).isNotNull() & F.col(out).isNull()
    rejects = mapped.filter(failed).drop(out)
    return mapped.withColumn(out, F.coalesce(F.col(out), F.col(column).cast("string"))), rejects
