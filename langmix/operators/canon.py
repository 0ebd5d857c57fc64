"""Declarative source specs and one canonicaliser per corpus kind (C1-C31, UD4, P1, P5, P7, P9, J1, J2).

A source is described by data, not code: which column holds the sentence, where
its language code comes from and which rule turns the code into ISO 639-3.
``canonicalise(df, spec, codes)`` returns the canonical rows and the row-level
rejects of a strict lookup (a miss rejects the row, not the whole shard, D5).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions.codes import prefix_before
from langmix.functions.text import clean_tweet, strip_ws
from langmix.operators.corpus import dedup_first


@dataclass(frozen=True)
class SourceSpec:
    dataset: str
    sentence: str
    code: str | None = None  # column holding the source's language code
    code_literal: str | None = None  # or a fixed data_lang
    rule: str = "identity"  # identity | literal | prefix | lenient | strict
    sep: str | None = None  # prefix separator for prefix / strict rules
    language_literal: str | None = None
    layout: str = "column"  # column | zipped (parallel arrays) | map (translation[code])
    trim: bool = False
    nonempty: bool = False
    single_language: bool = False  # P7: drop labels matching [+/]
    dataset_suffix_col: str | None = None  # dataset = '<dataset>_<col>'


# --- fixed values: the reference's monolingual sources (C1-C13) -----------
SOURCE_SPECS = {
    "minds14": SourceSpec("minds14", "transcription", code="lang_code", rule="strict", sep="-"),
    "ted_multi": SourceSpec("ted_multi", "translation", code="language", rule="strict", sep="-", layout="zipped"),
    "ccaligned": SourceSpec("ccaligned", "translation", code="lang_code", rule="strict", sep="_", layout="map"),
    "glot500": SourceSpec("glot500", "text", code="lang_code", rule="prefix", sep="_"),
    "bloom": SourceSpec("bloom", "text", code="lang_code"),
    "common_voice": SourceSpec("common_voice", "sentence", code="lang_code"),
    "afrisenti": SourceSpec("afrisenti", "tweet", code="lang_code"),
    "naijasenti": SourceSpec("naijasenti", "tweet", code="lang_code"),
    "catalan_youtube": SourceSpec("catalan_youtube", "candidate_1", code_literal="catalan", rule="literal",
                                  language_literal="cat"),
    "cantonese_youtube": SourceSpec("cantonese_youtube", "transcript_whisper", code_literal="cantonese",
                                    rule="literal", language_literal="yue", trim=True, nonempty=True),
    "voxpopuli": SourceSpec("voxpopuli", "normalized_text", code="lang_code", rule="strict"),
    "openlid": SourceSpec("openlid", "text", code="language", rule="prefix", sep="_", trim=True, nonempty=True,
                          dataset_suffix_col="source"),
    "tweetlid": SourceSpec("tweetlid", "text", code="language", rule="strict", trim=True, single_language=True),
}
# ---------------------------------------------------------------------------


def canonicalise(df: DataFrame, spec: SourceSpec, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentence, data_lang, language, dataset) rows plus strict-lookup rejects."""
    extra = [spec.dataset_suffix_col] if spec.dataset_suffix_col else []
    if spec.layout == "zipped":
        z = df.select(*extra, F.explode(F.arrays_zip(spec.code, spec.sentence)).alias("__z"))
        base = z.select(*extra, F.col(f"__z.{spec.code}").alias("__code"), F.col(f"__z.{spec.sentence}").alias("__sent"))
    elif spec.layout == "map":
        base = df.select(*extra, F.col(spec.code).alias("__code"),
                         F.try_element_at(F.col(spec.sentence), F.col(spec.code)).alias("__sent"))
    else:
        code = F.col(spec.code) if spec.code else F.lit(spec.code_literal)
        base = df.select(*extra, code.alias("__code"), F.col(spec.sentence).alias("__sent"))
    if spec.trim:
        base = base.withColumn("__sent", strip_ws("__sent"))
    if spec.nonempty:
        base = base.filter(F.col("__sent").isNotNull() & (F.col("__sent") != "") & F.col("__code").isNotNull())
    if spec.single_language:
        base = base.filter(~F.col("__code").rlike("[+/]"))

    rejects = base.limit(0)
    if spec.rule == "identity":
        base = base.withColumn("__lang", F.col("__code"))
    elif spec.rule == "literal":
        base = base.withColumn("__lang", F.lit(spec.language_literal))
    elif spec.rule == "prefix":
        base = base.withColumn("__lang", prefix_before(F.col("__code"), spec.sep))
    else:
        key = prefix_before(F.col("__code"), spec.sep) if spec.sep else F.col("__code")
        dim = F.broadcast(codes.select(F.col("iso_1").alias("__k"), F.col("iso_3").alias("__m")))
        keyed = base.withColumn("__k", key)
        if spec.rule == "lenient":
            base = keyed.join(dim, "__k", "left").withColumn("__lang", F.coalesce("__m", "__code"))
        elif spec.rule == "strict":
            rejects = keyed.join(dim.select("__k"), "__k", "left_anti").drop("__k")
            base = keyed.join(dim, "__k", "inner").withColumnRenamed("__m", "__lang")
        else:
            raise ValueError(f"unknown rule {spec.rule}")
    dataset = (
        F.concat(F.lit(spec.dataset + "_"), F.col(spec.dataset_suffix_col)) if spec.dataset_suffix_col else F.lit(spec.dataset)
    )
    rows = base.select(
        F.col("__sent").alias("sentence"), F.col("__code").alias("data_lang"), F.col("__lang").alias("language"),
        dataset.alias("dataset"),
    )
    return rows, rejects


@dataclass(frozen=True)
class CodeSwitchSpec:
    source: str  # dataset_source value
    sentence: str  # input column
    languages: str | None = None  # literal label; None -> label_col
    label_col: str | None = None
    drop_category: tuple[str, str] | None = None  # P5: (column, value), compared trimmed (D9)
    equals: tuple[str, str] | None = None  # P9: (column, value)
    explode: bool = False  # multi-valued cell (one row per element)
    clean: bool = False  # F12
    nonempty: bool = False
    trim: bool = False
    dedup: bool = False  # U2/W5 on the sentence, first by ``order_col``
    head: int | None = None  # T3: first n rows by ``order_col``
    order_col: str = "ordinal"


# --- fixed values: the reference's code-switch sources (C17-C31) -----------
CS_SPECS = {
    "basco": CodeSwitchSpec("BaSCo", "text", "Basque–Spanish", dedup=True, trim=True),
    "malayalam": CodeSwitchSpec("Dravidian-CodeMix", "text", "Malayalam–English",
                                drop_category=("category", "not-malayalam"), dedup=True),
    "tamil": CodeSwitchSpec("Dravidian-CodeMix", "text", "Tamil–English", drop_category=("category", "not-Tamil")),
    "crocosum": CodeSwitchSpec("CroCoSum", "post_text", "Chinese–English", dedup=True),
    "ascend": CodeSwitchSpec("ASCEND", "transcription", "English-Chinese", equals=("language", "mixed"), dedup=True),
    "hinge": CodeSwitchSpec("HinGE", "references", "Hindi-English", explode=True),
    "semeval_hinglish": CodeSwitchSpec("SemEval", "codeswitch_sentence", "Hindi-English"),
    "semeval_spanglish": CodeSwitchSpec("SemEval", "codeswitch_sentence", "Spanish-English"),
    "turkish": CodeSwitchSpec("yirmibesoglu-eryigit-2018-detecting", "codeswitch_sentence", "Turkish-English", trim=True),
    "tweetlid_pairs": CodeSwitchSpec("Tweetlid", "codeswitch_sentence", None, label_col="languages"),
    "tongueswitcher": CodeSwitchSpec("TongueSwitcher", "text", "German-English"),
    "indonesian": CodeSwitchSpec("barik-etal-2019-normalization", "raw_tweet", "Indonesian-English", clean=True),
    "msa_egyptian": CodeSwitchSpec("EDC", "codeswitch_sentence", "MSA-Egyptian", trim=True, nonempty=True),
    "egyptian_english": CodeSwitchSpec("ArzEn-ST", "codeswitch_sentence", "Egyptian-English"),
    "saudi": CodeSwitchSpec("Saudilang", "codeswitch_sentence", "Saudi-English"),
    "arabizi": CodeSwitchSpec("sabty2021language", "codeswitch_sentence", "Arabizi-English"),
}
# ---------------------------------------------------------------------------


def canonicalise_cs(df: DataFrame, spec: CodeSwitchSpec, keep_order: bool = False) -> DataFrame:
    """(codeswitch_sentence, languages, dataset_source) for one code-switch source, and its order column if asked."""
    out = df
    if spec.drop_category:
        col, value = spec.drop_category
        out = out.filter(F.coalesce(F.trim(F.col(col)) != value.strip(), F.lit(True)))
    if spec.equals:
        col, value = spec.equals
        out = out.filter(F.col(col) == value)
    keep = [spec.order_col] if spec.order_col in df.columns else []
    label = F.lit(spec.languages) if spec.languages is not None else F.col(spec.label_col)
    sent = F.explode(spec.sentence) if spec.explode else F.col(spec.sentence)
    out = out.select(*keep, sent.alias("codeswitch_sentence"), label.alias("languages"))
    if spec.clean:
        out = out.withColumn("codeswitch_sentence", clean_tweet("codeswitch_sentence"))
    if spec.trim:
        out = out.withColumn("codeswitch_sentence", strip_ws("codeswitch_sentence"))
    if spec.nonempty:
        out = out.filter(F.col("codeswitch_sentence") != "")
    if spec.head is not None and not keep:
        raise ValueError(f"the first {spec.head} rows need the column {spec.order_col}")
    if spec.dedup and keep:
        out = dedup_first(out, ["codeswitch_sentence"], spec.order_col)
    elif spec.dedup:
        out = out.dropDuplicates(["codeswitch_sentence"])
    if spec.head is not None:
        out = out.orderBy(spec.order_col).limit(spec.head)
    order = keep if keep_order else []
    return out.select("codeswitch_sentence", "languages", F.lit(spec.source).alias("dataset_source"), *order)
