"""Registered query keys and their DuckDB oracle SQL.

Every query reads the driver's tables (or data Spark derives from them) whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.operators import corpus as C
from langmix.operators.coderules import apply_code_rules
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.sources.tables import code_dimension

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


# Parameters of the fixture-scale jobs (the reference's are 1,000,000 / 100).
CAP, MIN_COUNT = 250, 110
TRAIN_FRACTION = 0.9
CS_TRAIN_FRACTION = 0.7
POLICY_DROP = ["src0", "src1"]
POLICY_DOWNSAMPLE = ["src2", "src3", "src4", "src5", "src6", "src7", "src8"]
POLICY_P = 0.3

# ---------------------------------------------------------------- 1 corpus_canonical


@register(
    "corpus_canonical",
    S.base() + "SELECT doc_id, sentence, data_lang, language, dataset FROM corpus",
)
def corpus_canonical(spark, sf_dir):
    return X.corpus(spark, sf_dir).select("doc_id", *C.CANONICAL)


# ---------------------------------------------------------------- 2 corpus_code_rules


def decorated_codes(spark, sf_dir) -> DataFrame:
    """Documents' codes decorated into the forms the rules must handle:
    region-suffixed (``en-EN``), script-suffixed ISO-3 (``eng_Latn``), unknown
    two-letter (``xx``), unknown three-letter (``zzz``) and plain."""
    docs = X.documents(spark, sf_dir)
    codes = code_dimension(spark)
    d = docs.join(codes, docs["lang"] == codes["iso_1"], "left")
    v = F.substring(F.md5(F.concat(F.lit("code:"), docs["doc_id"].cast("string"))), 1, 1)
    code = (
        F.when(v.isin("0", "1", "2", "3"), F.concat(docs["lang"], F.lit("-"), F.upper(docs["lang"])))
        .when(v.isin("4", "5", "6", "7"), F.concat(F.coalesce(codes["iso_3"], docs["lang"]), F.lit("_Latn")))
        .when(v.isin("8", "9"), F.lit("xx"))
        .when(v.isin("a", "b"), F.lit("zzz"))
        .otherwise(docs["lang"])
    )
    return d.select(docs["doc_id"], code.alias("code"))


_DECORATED = f"""decorated AS (
  SELECT d.doc_id,
    CASE WHEN substr(md5('code:' || CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('0','1','2','3') THEN d.lang || '-' || upper(d.lang)
         WHEN substr(md5('code:' || CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('4','5','6','7') THEN COALESCE(c.iso_3, d.lang) || '_Latn'
         WHEN substr(md5('code:' || CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('8','9') THEN 'xx'
         WHEN substr(md5('code:' || CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('a','b') THEN 'zzz'
         ELSE d.lang END AS code
  FROM documents d LEFT JOIN codes c ON d.lang = c.iso_1)"""


@register(
    "corpus_code_rules",
    S.with_ctes(S.CODES, _DECORATED)
    + """, r AS (
  SELECT doc_id, code, regexp_extract(code, '^[^-_]*', 0) AS stripped FROM decorated)
SELECT r.doc_id, r.code,
  COALESCE(f.iso_3, r.code) AS iso3_lenient,
  p.iso_3 AS iso3_strict,
  CASE WHEN length(r.code) = 2 THEN COALESCE(f.iso_3, r.code) ELSE r.code END AS iso3_two_letter,
  r.stripped,
  CASE WHEN length(r.stripped) = 2 THEN COALESCE(s.iso_3, r.stripped) ELSE r.stripped END AS normalised,
  (length(r.code) IN (2, 3) AND (length(r.code) = 3 OR f.iso_3 IS NOT NULL)) AS valid_code,
  (length(CASE WHEN length(r.stripped) = 2 THEN COALESCE(s.iso_3, r.stripped) ELSE r.stripped END) <> 3) AS malformed
FROM r
LEFT JOIN codes f ON r.code = f.iso_1
LEFT JOIN codes p ON split_part(r.code, '-', 1) = p.iso_1
LEFT JOIN codes s ON r.stripped = s.iso_1""",
)
def corpus_code_rules(spark, sf_dir):
    return apply_code_rules(decorated_codes(spark, sf_dir), code_dimension(spark), "code")


# ---------------------------------------------------------------- 3 label_text_roundtrip


def label_text(corpus: DataFrame) -> DataFrame:
    """K3: one ``__label__<lang> <sentence>`` line per row (whole sentence)."""
    return corpus.select("doc_id", T.label_line("language", "sentence").alias("value"))


def parse_label_text(lines: DataFrame) -> DataFrame:
    """Keep label lines, split on the first space."""
    lang, sent = T.parse_label_line("value")
    return lines.filter(T.is_label_line("value")).select("doc_id", lang.alias("language"), sent.alias("sentence"))


_LABEL_SQL = S.base(
    f"""lines AS (
  SELECT doc_id, '__label__' || language || ' ' ||
    {S.strip(f"replace({S.strip('sentence')}, chr(10), ' ')")} AS value FROM corpus)"""
)


@register(
    "label_text_roundtrip",
    _LABEL_SQL
    + f"""SELECT doc_id, regexp_extract(value, '^__label__([^ ]*) ', 1) AS language,
  md5(regexp_extract(value, '^__label__[^ ]* (.*)$', 1)) AS sentence_md5,
  {S.ntok("regexp_extract(value, '^__label__[^ ]* (.*)$', 1)")} AS num_tokens
FROM lines WHERE starts_with(value, '__label__') AND contains(value, ' ')""",
)
def label_text_roundtrip(spark, sf_dir):
    parsed = parse_label_text(label_text(X.corpus(spark, sf_dir)))
    return parsed.select(
        "doc_id", "language", F.md5("sentence").alias("sentence_md5"), T.num_tokens("sentence").alias("num_tokens")
    )


# ---------------------------------------------------------------- 4/5 profile


@register(
    "corpus_language_summary",
    S.base()
    + f"""SELECT language, CAST(count(*) AS BIGINT) AS num_sentences,
  CAST(sum({S.ntok('sentence')}) AS BIGINT) AS total_tokens,
  CAST(sum(length(sentence)) AS BIGINT) AS total_chars,
  CAST(sum(CASE WHEN {S.ntok('sentence')} <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS short_sentences,
  CAST(sum(CASE WHEN {S.special('sentence')} THEN 1 ELSE 0 END) AS BIGINT) AS special_char_sentences,
  round(avg({S.ntok('sentence')}), 6) AS mean_tokens,
  CAST(median({S.ntok('sentence')}) AS DOUBLE) AS median_tokens,
  CAST(min({S.ntok('sentence')}) AS BIGINT) AS min_tokens,
  CAST(max({S.ntok('sentence')}) AS BIGINT) AS max_tokens
FROM corpus GROUP BY language""",
)
def corpus_language_summary(spark, sf_dir):
    return C.language_summary(X.corpus(spark, sf_dir))


@register(
    "corpus_dataset_summary",
    S.base() + "SELECT dataset, CAST(count(*) AS BIGINT) AS num_sentences FROM corpus GROUP BY dataset",
)
def corpus_dataset_summary(spark, sf_dir):
    return C.dataset_summary(X.corpus(spark, sf_dir))


@register(
    "corpus_global_summary",
    S.base()
    + """SELECT CAST(count(*) AS BIGINT) AS total_sentences, CAST(count(DISTINCT language) AS BIGINT) AS total_languages,
  CAST(count(DISTINCT dataset) AS BIGINT) AS total_datasets FROM corpus""",
)
def corpus_global_summary(spark, sf_dir):
    return C.global_summary(X.corpus(spark, sf_dir))


# ---------------------------------------------------------------- 6/9 cap

_CAPPED = f"""capped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY language ORDER BY {S.md5_order('doc_id')}, doc_id) AS rn,
           count(*) OVER (PARTITION BY language) AS cnt FROM corpus)
  WHERE cnt >= {MIN_COUNT} AND rn <= {CAP})"""


@register(
    "cap_per_language",
    S.base(_CAPPED) + "SELECT doc_id, language, dataset FROM capped",
)
def cap_per_language(spark, sf_dir):
    return C.cap_per_language(X.corpus(spark, sf_dir), CAP, MIN_COUNT).select("doc_id", "language", "dataset")


@register(
    "capped_language_summary",
    S.base(
        _CAPPED,
        f"""lines AS (SELECT '__label__' || language || ' ' ||
    {S.strip(f"replace({S.strip('sentence')}, chr(10), ' ')")} AS value FROM capped)""",
        """parsed AS (SELECT regexp_extract(value, '^__label__([^ ]*) ', 1) AS language,
    regexp_extract(value, '^__label__[^ ]* (.*)$', 1) AS sentence FROM lines
    WHERE starts_with(value, '__label__') AND contains(value, ' '))""",
    )
    + f"""SELECT language, CAST(count(*) AS BIGINT) AS num_sentences, CAST(sum({S.ntok('sentence')}) AS BIGINT) AS num_tokens,
  round(sum({S.ntok('sentence')}) / count(*), 6) AS avg_tokens_per_sentence
FROM parsed GROUP BY language""",
)
def capped_language_summary(spark, sf_dir):
    capped = C.cap_per_language(X.corpus(spark, sf_dir), CAP, MIN_COUNT)
    parsed = parse_label_text(label_text(capped)).withColumn("t", T.num_tokens("sentence"))
    return parsed.groupBy("language").agg(
        F.count(F.lit(1)).alias("num_sentences"),
        F.sum("t").alias("num_tokens"),
        F.round(F.sum("t") / F.count(F.lit(1)), 6).alias("avg_tokens_per_sentence"),
    )


# ---------------------------------------------------------------- 7/8 duplicates


@register(
    "duplicate_stats",
    S.base()
    + """SELECT CAST(count(*) AS BIGINT) AS total_sentences, CAST(count(DISTINCT sentence) AS BIGINT) AS unique_sentences,
  CAST(count(*) - count(DISTINCT sentence) AS BIGINT) AS duplicates,
  round((count(*) - count(DISTINCT sentence)) * 100.0 / count(*), 6) AS duplicates_percentage FROM corpus""",
)
def duplicate_stats(spark, sf_dir):
    return C.duplicate_stats(X.corpus(spark, sf_dir))


@register(
    "dedup_first",
    S.base()
    + """SELECT doc_id, language, dataset FROM corpus
WHERE doc_id IN (SELECT min(doc_id) FROM corpus GROUP BY sentence)""",
)
def dedup_first(spark, sf_dir):
    return C.dedup_first(X.corpus(spark, sf_dir), ["sentence"], "doc_id").select("doc_id", "language", "dataset")


# ---------------------------------------------------------------- 10/11/12 split, sample


@register(
    "train_dev_split",
    S.base()
    + f"""SELECT doc_id, language,
  CASE WHEN row_number() OVER (ORDER BY {S.md5_order('doc_id')}, doc_id) <= floor(count(*) OVER () * {TRAIN_FRACTION})
       THEN 'train' ELSE 'dev' END AS split
FROM corpus""",
)
def train_dev_split(spark, sf_dir):
    return C.split_by_rank(X.corpus(spark, sf_dir), TRAIN_FRACTION).select("doc_id", "language", "split")


@register(
    "source_split_70_30",
    S.base()
    + f"""SELECT doc_id, dataset,
  CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY {S.md5_order('doc_id')}, doc_id)
            <= floor(count(*) OVER (PARTITION BY dataset) * {CS_TRAIN_FRACTION})
       THEN 'train' ELSE 'test' END AS split
FROM corpus""",
)
def source_split_70_30(spark, sf_dir):
    return C.split_by_rank(X.corpus(spark, sf_dir), CS_TRAIN_FRACTION, ["dataset"], tail="test").select(
        "doc_id", "dataset", "split"
    )


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@register(
    "source_policy_sample",
    S.base()
    + f"""SELECT doc_id, dataset FROM corpus
WHERE dataset NOT IN ({_in(POLICY_DROP)})
  AND (dataset NOT IN ({_in(POLICY_DOWNSAMPLE)})
       OR substr({S.md5_order('doc_id', 'sample:42')}, 1, 8) < '{C.hash_threshold(POLICY_P)}')""",
)
def source_policy_sample(spark, sf_dir):
    return C.source_policy(X.corpus(spark, sf_dir), POLICY_DROP, POLICY_DOWNSAMPLE, POLICY_P).select(
        "doc_id", "dataset"
    )
