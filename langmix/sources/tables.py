"""The driver's fixture tables and the small language dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# --- fixed values: dimension rows for the fixture languages ----------------
# ISO 639-1 -> ISO 639-3 for the four fixture languages (same rows in the oracles).
DOC_LANG_CODES = [("en", "eng"), ("de", "deu"), ("fr", "fra"), ("es", "spa")]
# Resource class of each ISO 639-3 code.
RESOURCE_CLASSES = [("eng", 5), ("deu", 5), ("fra", 5), ("spa", 4)]
# English names of the fixture languages (code-switch labels).
LANG_NAMES = [("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")]
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def code_dimension(spark: SparkSession, rows=None) -> DataFrame:
    """(iso_1, iso_3) dimension. Broadcast-safe: built from a fixed list."""
    return F.broadcast(spark.createDataFrame(rows or DOC_LANG_CODES, "iso_1 string, iso_3 string"))


def resource_class_dimension(spark: SparkSession, rows=None) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows or RESOURCE_CLASSES, "lang_code string, class int"))


def lang_name_dimension(spark: SparkSession, rows=None) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows or LANG_NAMES, "code string, name string"))


def read_code_dimension_csv(spark: SparkSession, path: str) -> DataFrame:
    """``iso_1, iso_2b, iso_2t, iso_3, name`` CSV. ``nan`` stays a code (nullValue='')."""
    schema = "iso_1 string, iso_2b string, iso_2t string, iso_3 string, name string"
    return spark.read.csv(path, header=True, schema=schema, nullValue="", multiLine=True, escape='"')


# --- fixed values: the columns of the language dimensions' files ------------
DIMENSIONS = {
    "iso": "iso_1 string, iso_2b string, iso_2t string, iso_3 string, name string",
    "bloom": "`ISO 639-3` string, Name string, `Train Stories` int, `Validation Stories` int, `Test Stories` int",
    "voxpopuli": "Language string, Code string, `Iso 639-2` string, `Transcribed Hours` string, `Transcribed Speakers` string, `Transcribed Tokens` string",
    "smol": "LP string, `Target Language Name` string, `ISO 15924 Script` string, Continent string, Endonym string, `Alternate names` string, "
            "Smoldoc int, SmolSent int, Gatitos int",
    "resource_class": "lang_code string, class int, language string",
}
# ---------------------------------------------------------------------------


def read_dimension(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """One of the language dimensions from its CSV file; ``nan`` stays a code, empty fields are null."""
    return spark.read.csv(path, header=True, schema=DIMENSIONS[kind], nullValue="", multiLine=True, escape='"')


def code_map(dimension: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` of a dimension's rows that have a key; the last of equal keys wins (F25), in order of value."""
    rows = dimension.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
    return rows.groupBy("key").agg(F.max("value").alias("value"))
