"""Readers for the reference's input formats (S1-S17, C-spec sources).

All readers are lazy DataFrame scans; block formats use a record delimiter
(``lineSep``) so each block is one record and is parsed with column functions.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions.text import is_label_line, parse_label_line, strip_ws
from langmix.sources.lines import blank_blocks, quoted_records


def read_csv(spark: SparkSession, path: str, schema: str | None = None, place: bool = False) -> DataFrame:
    """Headered CSV, quoted multi-line fields; empty string is the only null (so the ISO code ``nan`` stays a
    code). One file is read by many tasks: records are cut by quote parity (:func:`quoted_records`), and each file's
    first record is its header. Names come from the first file; ``schema`` overrides names and types. A quote mark
    outside a quoted field is taken for one that opens it, as in RFC 4180. ``place``: keep the rows' places."""
    records = quoted_records(spark, path).select("place", F.regexp_replace(F.array_join("lines", "\n"), "\r$", "").alias("text"))
    records = records.where(F.trim("text") != "")
    first = records.groupBy("place.file").agg(F.min(F.struct("place", "text")).alias("first"))  # one row for each file
    head = first.agg(F.min("first.place.file").alias("file"), F.min_by("first.text", "file").alias("text")).first()
    names = next(csv.reader([(head["text"] or "").lstrip("\ufeff")]), []) if head["file"] else []
    kind = schema or ", ".join(f"`{n}` string" for n in names)
    if not kind:
        return spark.createDataFrame([], "place struct<file: string, start: long, seq: long>" if place else "")
    body = records.join(F.broadcast(first.select("first.place")), "place", "left_anti")
    row = F.from_csv("text", kind, {"quote": '"', "escape": '"', "nullValue": "", "maxCharsPerColumn": "-1"})
    return body.select("place", row.alias("__row")).select(*(["place"] if place else []), "__row.*")


def read_tsv(spark: SparkSession, path: str, names: list[str], header: bool = False) -> DataFrame:
    """Tab file with supplied names; quoting off so raw sentences keep their quotes."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, sep="\t", header=header, schema=schema, quote="", escape="")


def read_jsonl(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """S3: JSON lines, selected fields."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    return spark.read.json(path, schema=schema)


def read_nested_json(spark: SparkSession, path: str, key: str = "code-switching") -> DataFrame:
    """A JSON array of items; one row per ``item[key][*].text``, trimmed.
    Items without the key produce no rows."""
    schema = f"`{key}` array<struct<text: string>>"
    items = spark.read.option("multiLine", True).json(path, schema=schema)
    return items.select(F.explode(F.col(f"`{key}`")).alias("u")).select(strip_ws(F.col("u.text")).alias("text"))


def read_parquet_parts(spark: SparkSession, directory: str, prefix: str) -> DataFrame:
    """Every ``prefix_*.parquet`` in a folder."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{prefix}_*.parquet")


def read_label_text(spark: SparkSession, path: str) -> DataFrame:
    """Label lines -> (language, sentence); other and space-less lines are skipped."""
    lines = spark.read.text(path).select(strip_ws("value").alias("value"))
    lang, sent = parse_label_line("value")
    return lines.filter(is_label_line("value")).select(lang.alias("language"), sent.alias("sentence"))


def read_lines(spark: SparkSession, path: str, languages: str, source: str, drop_blank: bool = True) -> DataFrame:
    """One trimmed sentence per line, literal label and source."""
    df = spark.read.text(path).select(strip_ws("value").alias("codeswitch_sentence"))
    if drop_blank:
        df = df.filter(F.col("codeswitch_sentence") != "")
    return df.select("codeswitch_sentence", F.lit(languages).alias("languages"), F.lit(source).alias("dataset_source"))


def read_meta_blocks(spark: SparkSession, path: str, languages: str, source: str) -> DataFrame:
    """CoNLL blocks opened by a ``meta`` line; the sentence is the first tab
    field of each following stripped line joined by a space (a blank line adds an
    empty token; so does the line break that ends a file). Records are split on ``\\nmeta``; the first block keeps its leading
    ``meta`` so it is stripped here."""
    recs = spark.read.option("lineSep", "\nmeta").text(path)
    lines = F.split(F.regexp_replace("value", r"^meta", ""), "\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    words = F.transform(body, lambda ln: F.split(strip_ws(ln), "\t").getItem(0))
    return recs.filter(F.trim("value") != "").select(
        F.array_join(words, " ").alias("codeswitch_sentence"),
        F.lit(languages).alias("languages"),
        F.lit(source).alias("dataset_source"),
    )


def read_blank_blocks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Blocks of stripped lines separated by lines that are empty once stripped (a lone carriage return too), with
    their place in the files (``block``); the first ``limit`` blocks if given. A file is read by many tasks whatever
    its separators (:func:`langmix.sources.lines.blank_blocks`)."""
    blocks = blank_blocks(spark, path).withColumnRenamed("place", "block")
    return blocks if limit is None else blocks.orderBy("block").limit(limit)


def read_tagged_blocks(spark: SparkSession, path: str, required_tags: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``word\\t...\\ttag`` lines; a block is kept iff every
    required tag occurs; text = the words joined. Returns (blocks, malformed
    line count) -- malformed lines (< 2 fields) are skipped, as with a warning."""
    blocks = read_blank_blocks(spark, path, limit)
    fields = F.transform("lines", lambda ln: F.split(ln, "\t"))
    parsed = blocks.select("block", fields.alias("f"))
    good = F.filter("f", lambda x: F.size(x) >= 2)
    tags = F.transform(good, lambda x: F.element_at(x, -1))
    cond = reduce(lambda a, b: a & b, [F.array_contains(tags, t) for t in required_tags])
    kept = parsed.filter(cond).select(
        "block", F.array_join(F.transform(good, lambda x: x.getItem(0)), " ").alias("codeswitch_sentence")
    )
    malformed = parsed.select(F.sum(F.size(F.filter("f", lambda x: F.size(x) < 2))).alias("malformed_lines"))
    return kept, malformed


def read_tweet_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Tab rows with >= 4 fields, label (third) and text (fourth); keep code-switched labels (``+``)."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 4)
    rows = raw.select(F.col("f").getItem(2).alias("languages"), F.col("f").getItem(3).alias("codeswitch_sentence"))
    return rows.filter(F.col("languages").contains("+"))


def read_label_records(spark: SparkSession, path: str) -> DataFrame:
    """Headless ``id, user, language, text``; single-language labels only."""
    df = read_tsv(spark, path, ["id", "user", "language", "text"])
    return df.filter(~F.col("language").rlike("[+/]"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``token f f f ...`` lines -> (token, vec); a header line (two integers) is detected and skipped."""
    parts = spark.read.text(path).select(F.split(strip_ws("value"), " ").alias("p"))
    header = (F.size("p") == 2) & F.col("p")[0].rlike("^[0-9]+$") & F.col("p")[1].rlike("^[0-9]+$")
    return parts.filter(~header & (F.size("p") >= 2)).select(
        F.col("p")[0].alias("token"), F.slice("p", 2, F.size("p") - 1).cast("array<float>").alias("vec")
    )


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """Many result CSVs; ``model`` = file name up to the first ``_``."""
    df = read_csv(spark, glob, place=True)
    name = F.element_at(F.split(F.col("place.file"), "/"), -1)
    return df.withColumn("model", F.split(F.url_decode(name), "_", 2).getItem(0)).drop("place")


def read_first_available(primary: DataFrame, fallback: DataFrame, key: str, domain: str = "document") -> DataFrame:
    """Per key use the primary rows; keys without them take the fallback rows, with ``domain`` set."""
    fb = fallback.join(primary.select(key).distinct(), key, "left_anti").withColumn("domain", F.lit(domain))
    return primary.unionByName(fb, allowMissingColumns=True)


def read_splits(frames: list[DataFrame]) -> DataFrame:
    """Merge all splits of a dataset."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
