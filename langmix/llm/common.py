"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters, x20 and x09-x0D.
BLANKS = " \t\n\x0b\x0c\r"


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to Python's split() that is no blank here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def blank_words(text: str) -> list[str]:
    """Maximal runs of characters other than blanks."""
    return WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> list[Column]:
    """The frame's columns but for ``names``, which the caller is about to write (case-insensitive)."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
