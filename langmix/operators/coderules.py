"""Code normalisation against the language dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions.codes import iso3_if_two_letter, prefix_before, strip_script


def _lookup(df: DataFrame, codes: DataFrame, key, name: str) -> DataFrame:
    """Left join of the (broadcast) dimension on ``key``; adds ``name`` = ISO-3 or null."""
    dim = codes.select(F.col("iso_1").alias(f"__k_{name}"), F.col("iso_3").alias(name))
    return df.withColumn(f"__j_{name}", key).join(
        F.broadcast(dim), F.col(f"__j_{name}") == F.col(f"__k_{name}"), "left"
    ).drop(f"__j_{name}", f"__k_{name}")


def apply_code_rules(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Per row: lenient ISO-3 (F1), strict ISO-3 on the '-' prefix (F2/J2: null =
    reject), two-letter-only conversion (F3), script-stripped code (F4) and its
    two-letter conversion, validity (P10) and the malformed probe (P12)."""
    c = F.col(code)
    out = _lookup(df, codes, c, "__m_full")
    out = _lookup(out, codes, prefix_before(c, "-"), "__m_prefix")
    out = out.withColumn("stripped", strip_script(c))
    out = _lookup(out, codes, F.col("stripped"), "__m_stripped")
    normalised = iso3_if_two_letter("stripped", "__m_stripped")
    return out.select(
        *df.columns,
        F.coalesce(F.col("__m_full"), c).alias("iso3_lenient"),
        F.col("__m_prefix").alias("iso3_strict"),
        iso3_if_two_letter(c, "__m_full").alias("iso3_two_letter"),
        "stripped",
        normalised.alias("normalised"),
        (F.length(c).isin(2, 3) & ((F.length(c) == 3) | F.col("__m_full").isNotNull())).alias("valid_code"),
        (F.length(normalised) != 3).alias("malformed"),
    )


def strict_rejects(df: DataFrame, codes: DataFrame, code: str = "code", sep: str = "-") -> DataFrame:
    """J2 rejects: rows whose prefix code misses the dimension (row-level, not shard-level)."""
    key = prefix_before(F.col(code), sep)
    return df.withColumn("__k", key).join(
        F.broadcast(codes.select(F.col("iso_1").alias("__k"))), "__k", "left_anti"
    ).drop("__k")


def null_codes(df: DataFrame, code: str = "code") -> DataFrame:
    """P12, second half: the rows without a code."""
    return df.where(F.col(code).isNull())
