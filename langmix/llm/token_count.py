"""Operator 8: token counts of whole texts."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from langmix.llm.common import without
from langmix.llm.encode import by_bytes, encode_counts, load, texts_of


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """All input columns but the text, and ``n_bytes``, ``n_tokens``, ``over_limit`` (they replace input columns of
    that name). ``tokenizer`` is the path of a .json vocabulary; begin, end and added special tokens are not counted.

    Only lengths leave the Arrow function. Each call to the library gets about the same number of bytes; long texts
    are cut where the encoding cannot reach across. Null and empty texts have 0 tokens. No shuffle.
    """
    others = without(docs, text_col, "n_bytes", "n_tokens", "over_limit")
    rows = docs.select(*others, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("__text"))
    schema = StructType([*rows.drop("__text").schema.fields, StructField("n_tokens", LongType())])

    def run(batches):
        tok = load(tokenizer)
        for batch in by_bytes(batches, "__text"):
            counts = encode_counts(tok, texts_of(batch, "__text"))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
