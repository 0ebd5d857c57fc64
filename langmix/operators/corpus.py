"""Corpus jobs: canonicalise, profile, dedup, cap, split, sample (P, A, W, T, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.functions.codes import iso3_lenient
from langmix.operators.ranking import head_flag, md5_order
from langmix.session import stored

CANONICAL = ["sentence", "data_lang", "language", "dataset"]


def canonicalise_documents(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """C-spec for the driver's ``documents``: text->sentence, lang->data_lang,
    iso3(lang)->language (lenient, J1/F1), source->dataset; P2 non-empty filter."""
    joined = docs.join(codes, docs["lang"] == codes["iso_1"], "left")
    out = joined.select(
        docs["doc_id"],
        docs["text"].alias("sentence"),
        docs["lang"].alias("data_lang"),
        iso3_lenient(docs["lang"], codes["iso_3"]).alias("language"),
        docs["source"].alias("dataset"),
    )
    return filter_nonempty(out)


def filter_nonempty(df: DataFrame, sentence: str = "sentence", language: str = "language") -> DataFrame:
    """Trimmed sentence and language both non-empty. "Non-empty after strip"
    is tested as "has a non-whitespace character", which stops at the first hit
    instead of rewriting the whole text."""
    return df.filter(F.col(sentence).rlike(r"(?U)\S") & F.col(language).isNotNull() & (F.col(language) != ""))


def with_text_stats(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    return df.withColumn("num_tokens", T.num_tokens(sentence)).withColumn(
        "is_special", T.has_special_char(sentence).cast("int")
    )


def language_summary(corpus: DataFrame) -> DataFrame:
    """A1: per language rows, tokens, chars, short rows, special-char rows and
    mean/median/min/max tokens per row.

    Two-phase (A4): the per-(language, num_tokens) histogram is a partial
    aggregate whose size is bounded by the distinct token counts, and the exact
    median is a weighted percentile over it, so no group's raw rows are gathered.
    """
    stats = corpus.select(
        "language",
        T.num_tokens("sentence").alias("t"),
        T.char_length("sentence").alias("c"),
        T.has_special_char("sentence").cast("long").alias("s"),
    )
    hist = stats.groupBy("language", "t").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s")
    )
    return hist.groupBy("language").agg(
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


def dataset_summary(corpus: DataFrame) -> DataFrame:
    """A2."""
    return corpus.groupBy("dataset").agg(F.count(F.lit(1)).alias("num_sentences"))


def global_summary(corpus: DataFrame) -> DataFrame:
    """A3."""
    return corpus.agg(
        F.count(F.lit(1)).alias("total_sentences"),
        F.countDistinct("language").alias("total_languages"),
        F.countDistinct("dataset").alias("total_datasets"),
    )


def duplicate_stats(corpus: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Exact-sentence duplicates, language ignored. The shuffle carries the
    16-byte md5 of the sentence (plus its length), never the sentence."""
    keyed = corpus.select(F.md5(F.col(sentence)).alias("h"), F.length(F.col(sentence)).alias("l"))
    per_key = keyed.groupBy("h", "l").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("total_sentences"), F.count(F.lit(1)).alias("unique_sentences")
    ).select(
        "total_sentences",
        "unique_sentences",
        (F.col("total_sentences") - F.col("unique_sentences")).alias("duplicates"),
        F.round(
            F.when(F.col("total_sentences") > 0, (F.col("total_sentences") - F.col("unique_sentences")) * 100.0
                   / F.col("total_sentences")),
            6,
        ).alias("duplicates_percentage"),
    )


def dedup_first(df: DataFrame, key_cols: list[str], order_col: str) -> DataFrame:
    """Keep the first row (smallest ``order_col``, nulls last) of each key; null keys are keys like others.

    The key is hashed so the shuffle is small; ``min`` is partially aggregated,
    so a key that holds a third of all rows collapses map-side. Only keys with
    more than one row are met again: rows are dropped by a left join with that
    table, and rows that tie at the first place of a key are reduced to one."""
    h = F.md5(F.to_json(F.struct(*[F.col(c) for c in key_cols])))
    order = F.struct(F.col(order_col).isNull().alias("none"), F.col(order_col).alias("at"))
    keys = df.groupBy(h.alias("__h")).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    many = stored(keys.where("__n > 1").select("__h", "__first"), "dedup-keys")
    tied = (
        df.select(h.alias("__h"), order.alias("__first")).join(many, ["__h", "__first"], "left_semi")
        .groupBy("__h").agg(F.count(F.lit(1)).alias("__k")).where("__k > 1").select("__h")
    )
    kept = df.withColumn("__h", h).join(many.select("__h", "__first"), "__h", "left").where(
        F.col("__first").isNull() | (F.col("__first") == order))
    tied = stored(tied, "dedup-ties")
    if tied.isEmpty():
        return kept.drop("__h", "__first")
    single = kept.join(tied, "__h", "left_anti")
    return single.unionByName(kept.join(tied, "__h", "left_semi").dropDuplicates(["__h"])).drop("__h", "__first")


def cap_per_language(
    df: DataFrame, cap: int, min_count: int, key: str = "language", id_col: str = "doc_id", seed: int = 42
) -> DataFrame:
    """Over the md5 order, keep a row when its group has >= min_count
    rows and fewer than ``cap`` rows of the group were kept before it."""
    keyed = df.withColumn("__h", md5_order(id_col, seed))
    flagged = head_flag(
        keyed, [key], "__h", id_col, lambda n: F.when(n >= min_count, F.least(n, F.lit(cap))).otherwise(F.lit(0))
    )
    return flagged.filter("in_head").drop("in_head", "__h")


def split_by_rank(
    df: DataFrame,
    fraction: float,
    part_cols: list[str] | None = None,
    id_col: str = "doc_id",
    seed: int = 42,
    head: str = "train",
    tail: str = "dev",
) -> DataFrame:
    """First ``floor(n * fraction)`` rows (md5 order) of each part -> head, rest -> tail.

    With no ``part_cols`` this is the global split; the boundary is still found
    from a hash histogram, never by a single-partition window."""
    keyed = df.withColumn("__h", md5_order(id_col, seed))
    flagged = head_flag(keyed, part_cols or [], "__h", id_col, lambda n: F.floor(n * F.lit(fraction)))
    return flagged.withColumn("split", F.when(F.col("in_head"), F.lit(head)).otherwise(F.lit(tail))).drop(
        "in_head", "__h"
    )


def hash_threshold(p: float) -> str:
    """8-hex-digit threshold so that ``substr(md5, 1, 8) < t`` has probability p."""
    return "g" if p >= 1 else format(int(p * 2**32), "08x")  # "g" is above every hex digit


def bernoulli_keep(id_col: str, p: float, seed: int | str) -> F.Column:
    """Deterministic independent keep with probability ``p``."""
    return F.substring(md5_order(id_col, seed), 1, 8) < F.lit(hash_threshold(p))


def source_policy(
    df: DataFrame,
    drop: list[str],
    downsample: list[str],
    p: float = 0.3,
    source_col: str = "dataset",
    id_col: str = "doc_id",
    seed: str = "sample:42",
) -> DataFrame:
    """Drop some sources, keep a fraction ``p`` of others, keep the rest (rows without a source too)."""
    src = F.coalesce(F.col(source_col), F.lit(""))
    return df.filter(
        ~src.isin(*drop) & (~src.isin(*downsample) | bernoulli_keep(id_col, p, seed))
    )


def label_counts(df: DataFrame, label: str = "languages") -> DataFrame:
    """Count and percentage of total per label, most frequent first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).first()[0] or 1
    return counts.withColumn("percentage", F.round(F.col("count") * 100.0 / F.lit(total), 6)).orderBy(F.desc("count"), label)


def min_count_filter(df: DataFrame, label: str, n: int, part_cols: list[str] | None = None) -> DataFrame:
    """Keep rows whose label has >= n rows (within ``part_cols``).

    Aggregate + semi join: the count table has one row per label, and the
    filter never gathers a label's rows into one task."""
    keys = [*(part_cols or []), label]
    keep = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n).drop("__n")
    return df.join(keep, on=keys, how="left_semi")


def drop_prefixed_columns(df: DataFrame, prefix: str) -> DataFrame:
    """Drop columns whose name starts with ``prefix`` (e.g. after a merge)."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P14."""
    return df.withColumnsRenamed(mapping)


def with_literals(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Constant label / source columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """Number of distinct labels and their sorted list (the list is a
    dimension-size result: one entry per label)."""
    return df.agg(F.countDistinct(label).alias("nunique"), F.array_sort(F.collect_set(label)).alias("unique"))


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int | str = 42) -> DataFrame:
    """N rows in reproducible md5 order (a top-n, so Spark keeps a bounded heap per task)."""
    return df.withColumn("__h", md5_order(id_col, seed)).orderBy("__h", id_col).limit(n).drop("__h")


def shuffle_rows(df: DataFrame, id_col: str, seed: int | str = 42, local: bool = False) -> DataFrame:
    """Reproducible permutation by ``md5('<seed>:<id>')``.

    ``local=True`` is the chunk shuffle: each partition is permuted in place
    (``sortWithinPartitions``, no exchange), like shuffling fixed-size chunks
    and concatenating them. The default is a full permutation: a range-partitioned
    global sort, which is distributed (sampled range bounds, no single task)."""
    keyed = df.withColumn("__h", md5_order(id_col, seed))
    out = keyed.sortWithinPartitions("__h", id_col) if local else keyed.orderBy("__h", id_col)
    return out.drop("__h")
