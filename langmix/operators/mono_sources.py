"""Monolingual sources: each spec bound to its reader (C1-C13, UD4, P6, P7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from langmix.operators.canon import SOURCE_SPECS, canonicalise
from langmix.operators.corpus import source_policy
from langmix.sources import readers as R

Reader = Callable[[SparkSession, str], DataFrame]


def _jsonl(schema: str) -> Reader:
    return lambda spark, path: spark.read.json(path, schema=schema)


def _fields(*names: str) -> Reader:
    return lambda spark, path: R.read_jsonl(spark, path, list(names))


# --- fixed values: the files' fields, and the policy on the sources of one set ---
_READERS: dict[str, Reader] = {
    "minds14": _fields("transcription", "lang_code"),
    "ted_multi": _jsonl("language array<string>, translation array<string>"),
    "ccaligned": _jsonl("lang_code string, translation map<string, string>"),
    "glot500": _fields("text", "lang_code"),
    "bloom": _fields("text", "lang_code"),
    "common_voice": _fields("sentence", "lang_code"),
    "afrisenti": _fields("tweet", "lang_code"),
    "naijasenti": _fields("tweet", "lang_code"),
    "catalan_youtube": _fields("candidate_1"),
    "cantonese_youtube": _fields("transcript_whisper"),
    "voxpopuli": lambda spark, path: spark.read.schema("normalized_text string, lang_code string").parquet(path),
    "openlid": _jsonl("doc_id long, text string, language string, source string"),
    "tweetlid": R.read_label_records,
}
OPENLID_DROP = ["tatoeba", "pali"]
OPENLID_SAMPLE = ["wili2018", "setimes", "xlsum", "leipzig", "mizan", "tep", "voa"]
OPENLID_SHARE = 0.3
# ---------------------------------------------------------------------------------

MONO_SOURCES = SOURCE_SPECS


def load_mono(spark: SparkSession, name: str, path: str, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical rows of a source's files, and the rows that a strict lookup rejects."""
    rows = _READERS[name](spark, path)
    if name == "openlid":
        rows = source_policy(rows, OPENLID_DROP, OPENLID_SAMPLE, OPENLID_SHARE, "source", "doc_id")
    return canonicalise(rows, MONO_SOURCES[name], codes)
