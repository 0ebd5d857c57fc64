"""Query keys of small operators over whole tables: stored predictions, label functions, comparison tables, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions import codes as D
from langmix.operators import codeswitch as CS
from langmix.operators import corpus as C
from langmix.operators.coderules import null_codes
from langmix.operators.udf import map_rows, safe_map
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import ORACLE, register
from langmix.plans.q_detect import SYSTEMS
from langmix.plans.q_labels import _metric
from langmix.plans.q_pairs import CS_SQL, cs_corpus_df
from langmix.sources.tables import table

_NAMES = [f"char{n}" for n in SYSTEMS]


def _compare_sql(key: str, value: str) -> str:
    cols = ", ".join(f"max(CASE WHEN system = '{n}' THEN {value} END) AS {n}" for n in _NAMES)
    return f"SELECT label, {cols} FROM ({ORACLE[key]}) GROUP BY label"


@register("labelset_compare_fpr", _compare_sql("labelset_fpr", "fpr"))
def labelset_compare_fpr(spark, sf_dir):
    """E14 of E10."""
    return CS.compare_systems(_metric(spark, sf_dir, "fpr"), "fpr", systems=_NAMES)


@register("labelset_compare_iou", _compare_sql("labelset_partial_iou", "partial_iou"))
def labelset_compare_iou(spark, sf_dir):
    """E14 of E12."""
    return CS.compare_systems(_metric(spark, sf_dir, "partial_iou"), "partial_iou", systems=_NAMES)


@register("labelset_compare_top", _compare_sql("labelset_top_language", "top_language"))
def labelset_compare_top(spark, sf_dir):
    """E14 of E13."""
    return CS.compare_systems(_metric(spark, sf_dir, "top_language"), "top_language", systems=_NAMES)


@register("label_counts", CS_SQL + "SELECT languages, CAST(count(*) AS BIGINT) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM cs), 6) AS percentage FROM cs GROUP BY languages")
def label_counts(spark, sf_dir):
    """A7."""
    return C.label_counts(cs_corpus_df(spark, sf_dir))


def _preds(spark, sf_dir) -> DataFrame:
    """A stored prediction for each document: three labels with tenths that repeat; every eleventh has none."""
    at = lambda k: F.format_string("%.1f", F.pmod(F.col("doc_id") * k, F.lit(10)) / 10)
    text = F.concat(F.lit("{'"), "lang", F.lit("': "), at(3), F.lit(", 'zz': "), at(7), F.lit(", 'yy': "), at(1), F.lit("}"))
    listed = F.concat(F.lit("["), "lang", F.lit(":"), at(3), F.lit(", zz:"), at(7), F.lit("]"))
    have = F.pmod("doc_id", F.lit(11)) != 0
    return X.documents(spark, sf_dir).select("doc_id", F.when(have, text).alias("text"), F.when(have, listed).alias("listed"))


@register("stored_top2", """WITH d AS (SELECT doc_id, lang, doc_id * 3 % 10 AS a, doc_id * 7 % 10 AS b, doc_id % 10 AS c, doc_id % 11 <> 0 AS have FROM documents)
SELECT doc_id, CASE WHEN have THEN lang || '-zz' ELSE '' END AS first_two,
  CASE WHEN have THEN (SELECT string_agg(l, '-' ORDER BY r) FROM (SELECT l, row_number() OVER (ORDER BY p DESC, i) AS r
    FROM (VALUES (lang, a, 0), ('zz', b, 1), ('yy', c, 2)) AS t(l, p, i)) WHERE r <= 2) ELSE '' END AS best_two,
  CASE WHEN have THEN lang || '-zz' ELSE '' END AS listed_two FROM d""")
def stored_top2(spark, sf_dir):
    """F14 in its three text forms."""
    join = lambda c: F.array_join(c, "-")
    return _preds(spark, sf_dir).select("doc_id", join(D.stored_top2("text")).alias("first_two"), join(D.stored_top2_by_probability("text")).alias("best_two"),
                                        join(D.listed_top2("listed")).alias("listed_two"))


@register("label_functions", """SELECT doc_id, concat_ws('-', CASE WHEN doc_id % 10 >= 8 THEN 'a' END, CASE WHEN doc_id % 7 >= 6 THEN 'b' END) AS reached,
  CASE WHEN doc_id % 10 >= 8 THEN 'a' ELSE '' END AS best_reached, CASE lang WHEN 'en' THEN 'old' WHEN 'de' THEN 'deu' ELSE 'unknown' END || ',unknown' AS pair_codes,
  source AS model FROM documents""")
def label_functions(spark, sf_dir):
    """F21, F22, F24, F25 (the later of two names wins) and F27 on every document."""
    preds = F.array(F.struct(F.lit("a").alias("lang"), (F.pmod("doc_id", F.lit(10)) / 10).alias("prob")), F.struct(F.lit("b").alias("lang"), (F.pmod("doc_id", F.lit(7)) / 7.5).alias("prob")))
    names = D.invert_last_wins([("eng", "English"), ("deu", "German"), ("old", "English")])
    pair = F.concat(F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").otherwise(F.lit("Other")), F.lit("-None"))
    return X.documents(spark, sf_dir).select(
        "doc_id", F.array_join(D.threshold_labels(preds, 0.8), "-").alias("reached"), F.array_join(D.topk_threshold_labels(preds, 1, 0.8), "-").alias("best_reached"),
        F.array_join(D.map_pair_codes(pair, names), ",").alias("pair_codes"), D.model_from_path(F.concat(F.lit("out/x/"), "source", F.lit("_results_1.csv"))).alias("model"))


@register("union_by_name", "SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), NULL, url FROM pages")
def union_by_name(spark, sf_dir):
    """Columns that one side lacks are null."""
    docs = X.documents(spark, sf_dir).select("lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")
    return CS.union_all_by_name([docs, pages]).select("id", "lang", "url")


@register("null_codes", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def null_codes_q(spark, sf_dir):
    """P12, second half: documents without a label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("code"))
    return null_codes(X.documents(spark, sf_dir).select("doc_id").join(labels, "doc_id", "left")).select("doc_id")


@register("mapped_rows", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source ELSE substr(source, 4) END AS number, doc_id % 4 = 0 AS failed, length(text) AS chars FROM documents""")
def mapped_rows(spark, sf_dir):
    """UD1 (a pandas function of each batch) and UD2 (a failed row keeps its value and is reported)."""
    docs = map_rows(X.documents(spark, sf_dir).select("doc_id", "source", "text"), lambda b: b.assign(chars=b["text"].str.len()).drop(columns="text"), "doc_id long, source string, chars long")
    number = F.when(F.pmod("doc_id", F.lit(4)) != 0, F.expr("try_cast(substring(source, 4) as int)")).cast("string")
    mapped, rejects = safe_map(docs, "source", number, "number")
    failed = rejects.select("doc_id", F.lit(True).alias("failed"))
    return mapped.join(failed, "doc_id", "left").select("doc_id", "number", F.coalesce("failed", F.lit(False)).alias("failed"), "chars")
