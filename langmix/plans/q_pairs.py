"""Query keys 13-19: parallel arrays, translation pairs, tagged blocks, pair
discovery and cover, code-switch corpus and its label statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.functions.codes import PAIR_LABEL_MAP, PAIR_RENAME, iso3_lenient, prefix_before
from langmix.operators import codeswitch as CS
from langmix.operators import pairs as P
from langmix.operators.corpus import split_by_rank
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import _DECORATED, CS_TRAIN_FRACTION, decorated_codes, register
from langmix.sources.tables import code_dimension, lang_name_dimension, table

CS_MIN_COUNT = 35
PAIR_HUB = "src0:en"

# ---------------------------------------------------------------- shared fixtures


def doc_pairs(spark, sf_dir) -> DataFrame:
    """Document pairs; ``variety_*`` = ``dataset:data_lang`` is the key of the pair-discovery jobs."""
    pairs = P.doc_pairs(X.corpus(spark, sf_dir))
    return pairs.withColumn("variety_a", F.concat_ws(":", "dataset_a", "data_lang_a")).withColumn(
        "variety_b", F.concat_ws(":", "dataset_b", "data_lang_b")
    )


PAIRS_SQL = """pairs AS (
  SELECT a.doc_id AS pair_id, a.doc_id AS doc_id_a, b.doc_id AS doc_id_b,
         a.sentence AS sentence_a, b.sentence AS sentence_b, a.data_lang AS data_lang_a, b.data_lang AS data_lang_b,
         a.language AS language_a, b.language AS language_b, a.dataset AS dataset_a, b.dataset AS dataset_b
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM corpus) a
  JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM corpus) b ON a.k % 2 = 1 AND b.k = a.k + 1),
two AS (SELECT * FROM pairs WHERE language_a <> language_b)"""


# ---------------------------------------------------------------- 13 parallel_segments


def parallel_arrays(spark, sf_dir, bundle: int = 8) -> DataFrame:
    """Parallel-array source rows: bundles of ``bundle`` documents carry
    ``language`` and ``translation`` arrays (bounded size by construction)."""
    docs = X.documents(spark, sf_dir).select("doc_id", "text")
    base = docs.join(decorated_codes(spark, sf_dir), "doc_id")
    items = base.groupBy(F.expr(f"doc_id div {bundle}").alias("bundle_id")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "code", "text"))).alias("items")
    )
    return items.select(
        "bundle_id",
        F.transform("items", lambda x: x["code"]).alias("language"),
        F.transform("items", lambda x: x["text"]).alias("translation"),
    )


def explode_parallel(arrays: DataFrame, codes: DataFrame) -> DataFrame:
    """C2/UD3: one row per (language, translation) position; strict ISO-3 on the
    prefix before '-' (misses are row-level rejects, D5)."""
    z = arrays.select("bundle_id", F.posexplode(F.arrays_zip("language", "translation")).alias("pos", "z"))
    z = z.select("bundle_id", F.col("pos").cast("long").alias("pos"), F.col("z.language").alias("data_lang"),
                 F.col("z.translation").alias("sentence"))
    z = z.withColumn("__k", prefix_before(F.col("data_lang"), "-"))
    return z.join(F.broadcast(codes.select(F.col("iso_1").alias("__k"), F.col("iso_3").alias("language"))), "__k").drop(
        "__k"
    )


@register(
    "parallel_segments",
    S.with_ctes(S.CODES, _DECORATED)
    + """, z AS (
  SELECT d.doc_id // 8 AS bundle_id, row_number() OVER (PARTITION BY d.doc_id // 8 ORDER BY d.doc_id) - 1 AS pos,
         dc.code AS data_lang, d.text AS sentence
  FROM documents d JOIN decorated dc ON d.doc_id = dc.doc_id)
SELECT bundle_id, pos, data_lang, c.iso_3 AS language, sentence
FROM z JOIN codes c ON split_part(data_lang, '-', 1) = c.iso_1""",
)
def parallel_segments(spark, sf_dir):
    return explode_parallel(parallel_arrays(spark, sf_dir), code_dimension(spark)).select(
        "bundle_id", "pos", "data_lang", "language", "sentence"
    )


# ---------------------------------------------------------------- 14 translation_pairs


def translation_rows(pairs: DataFrame, codes: DataFrame, dataset: str = "pairs") -> DataFrame:
    """Translation maps {lang: text}. With English in the pair only the
    other side is emitted; otherwise both sides, each tagged with its own code (D1)."""
    m = pairs.select(
        "pair_id", F.create_map("data_lang_a", "sentence_a", "data_lang_b", "sentence_b").alias("translation")
    )
    has_en = F.array_contains(F.map_keys("translation"), "en")
    sides = m.select("pair_id", has_en.alias("has_en"), F.explode("translation").alias("data_lang", "sentence"))
    sides = sides.filter(~F.col("has_en") | (F.col("data_lang") != "en"))
    dim = F.broadcast(codes.select(F.col("iso_1").alias("data_lang"), F.col("iso_3").alias("__m")))
    return sides.join(dim, "data_lang", "left").select(
        "pair_id", "data_lang", iso3_lenient("data_lang", "__m").alias("language"), "sentence", F.lit(dataset).alias("dataset")
    )


@register(
    "translation_pairs",
    S.base(PAIRS_SQL)
    + """, sides AS (
  SELECT pair_id, data_lang_b AS data_lang, sentence_b AS sentence FROM two WHERE data_lang_a = 'en'
  UNION ALL SELECT pair_id, data_lang_a, sentence_a FROM two WHERE data_lang_b = 'en'
  UNION ALL SELECT pair_id, data_lang_a, sentence_a FROM two WHERE data_lang_a <> 'en' AND data_lang_b <> 'en'
  UNION ALL SELECT pair_id, data_lang_b, sentence_b FROM two WHERE data_lang_a <> 'en' AND data_lang_b <> 'en')
SELECT pair_id, data_lang, COALESCE(c.iso_3, data_lang) AS language, sentence, 'pairs' AS dataset
FROM sides LEFT JOIN codes c ON sides.data_lang = c.iso_1""",
)
def translation_pairs(spark, sf_dir):
    return translation_rows(P.two_languages(doc_pairs(spark, sf_dir)), code_dimension(spark))


# ---------------------------------------------------------------- 15 tagged_block_filter


def tagged_blocks(rows: DataFrame, block: str, order: str, tag: str, word: str, required: list[str]) -> DataFrame:
    """S10 on a table of tagged lines: keep a block iff every required tag occurs;
    its text is the words joined in order. The tag test is a partial aggregate;
    only qualifying blocks have their words gathered."""
    flags = rows.groupBy(block).agg(*[F.max((F.col(tag) == t).cast("int")).alias(f"__t{i}") for i, t in enumerate(required)])
    keep = flags.filter(" AND ".join(f"__t{i} = 1" for i in range(len(required)))).select(block)
    kept = rows.join(keep, block, "left_semi")
    return kept.groupBy(block).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ").alias("text"),
        F.count(F.lit(1)).alias("n_turns"),
    )


@register(
    "tagged_block_filter",
    """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_turns
FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system') AND bool_or(role = 'user')""",
)
def tagged_block_filter(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return tagged_blocks(conv, "conv_id", "turn", "role", "text", ["system", "user"])


# ---------------------------------------------------------------- 16/17 pairs over sources

_PW = """vp AS (SELECT dataset_a || ':' || data_lang_a AS va, dataset_b || ':' || data_lang_b AS vb FROM pairs),
pw AS (SELECT least(va, vb) AS l1, greatest(va, vb) AS l2, count(*) AS n_rows FROM vp WHERE va <> vb GROUP BY 1, 2)"""


@register(
    "pair_product",
    S.base(PAIRS_SQL, _PW)
    + "SELECT l1, l2, CAST(n_rows AS BIGINT) AS n_rows FROM pw UNION ALL SELECT l2, l1, CAST(n_rows AS BIGINT) FROM pw",
)
def pair_product(spark, sf_dir):
    return P.pair_product(doc_pairs(spark, sf_dir), "variety_a", "variety_b")


@register(
    "pair_uncovered",
    S.base(PAIRS_SQL, _PW)
    + f""", covered AS (
  SELECT CASE WHEN l1 = '{PAIR_HUB}' THEN l2 ELSE l1 END AS lang FROM pw WHERE l1 = '{PAIR_HUB}' OR l2 = '{PAIR_HUB}'
  UNION SELECT '{PAIR_HUB}')
SELECT l1, l2, CAST(n_rows AS BIGINT) AS n_rows FROM pw
WHERE l1 NOT IN (SELECT lang FROM covered) AND l2 NOT IN (SELECT lang FROM covered)""",
)
def pair_uncovered(spark, sf_dir):
    return P.pair_uncovered(doc_pairs(spark, sf_dir), "variety_a", "variety_b", PAIR_HUB)


_COVER_SQL = f"""pr AS (SELECT l1, l2, row_number() OVER (ORDER BY first_pair, l1, l2) AS rank FROM (
  SELECT least(va, vb) AS l1, greatest(va, vb) AS l2, min(pair_id) AS first_pair
  FROM (SELECT pair_id, dataset_a || ':' || data_lang_a AS va, dataset_b || ':' || data_lang_b AS vb FROM pairs)
  WHERE va <> vb GROUP BY 1, 2)),
scan(i, seen, took) AS (
  SELECT 0, CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT s.i + 1,
    CASE WHEN t.take THEN list_concat(s.seen, t.ends) ELSE s.seen END,
    CASE WHEN t.take THEN t.rank END
  FROM scan s JOIN (
    SELECT rank, l1, l2,
      CASE WHEN l1 = '{PAIR_HUB}' THEN [l2] WHEN l2 = '{PAIR_HUB}' THEN [l1] ELSE [l1, l2] END AS ends
    FROM pr) p ON p.rank = s.i + 1,
  LATERAL (SELECT p.rank AS rank, p.ends AS ends,
    NOT list_has_any(s.seen, p.ends) AS take) t)"""


@register(
    "pair_cover",
    "WITH RECURSIVE " + S.base(PAIRS_SQL)[len("WITH "):] + ", " + _COVER_SQL
    + " SELECT l1, l2, CAST(rank AS BIGINT) AS rank FROM pr WHERE rank IN (SELECT took FROM scan WHERE took IS NOT NULL)",
)
def pair_cover(spark, sf_dir):
    ranked = P.ranked_pairs(doc_pairs(spark, sf_dir), "variety_a", "variety_b")
    return P.greedy_pair_cover(ranked, PAIR_HUB)


# ---------------------------------------------------------------- 18/19 code-switch corpus


def cs_raw(spark, sf_dir) -> DataFrame:
    """Code-switch source rows from document pairs. Label spellings vary the way
    the merged sources do: en-dash names, hyphen names, tweet-style code pairs
    (``de+en``) and three-language tweet labels that P8 must drop."""
    pairs = P.two_languages(doc_pairs(spark, sf_dir))
    names = lang_name_dimension(spark)
    na = names.select(F.col("code").alias("data_lang_a"), F.col("name").alias("name_a"))
    nb = names.select(F.col("code").alias("data_lang_b"), F.col("name").alias("name_b"))
    p = pairs.join(na, "data_lang_a", "left").join(nb, "data_lang_b", "left")
    v = F.substring(F.md5(F.concat(F.lit("label:"), F.col("pair_id").cast("string"))), 1, 1)
    lo, hi = F.least("data_lang_a", "data_lang_b"), F.greatest("data_lang_a", "data_lang_b")
    label = (
        F.when(v.isin(*"01234"), F.concat("name_a", F.lit("–"), "name_b"))
        .when(v.isin(*"56789"), F.concat("name_a", F.lit("-"), "name_b"))
        .when(v.isin(*"abcde"), F.concat(lo, F.lit("+"), hi))
        .otherwise(F.concat("data_lang_a", F.lit("+"), "data_lang_b", F.lit("+en")))
    )
    return p.select(
        "pair_id",
        F.concat_ws(" ", "sentence_a", "sentence_b").alias("codeswitch_sentence"),
        label.alias("languages"),
        F.col("dataset_a").alias("dataset_source"),
    )


def cs_corpus_df(spark, sf_dir) -> DataFrame:
    rows = CS.normalise_labels(cs_raw(spark, sf_dir))
    return split_by_rank(rows, CS_TRAIN_FRACTION, ["dataset_source"], id_col="pair_id", tail="test")


_CS_SQL = f"""raw AS (
  SELECT p.pair_id, p.sentence_a || ' ' || p.sentence_b AS codeswitch_sentence, p.dataset_a AS dataset_source,
    CASE WHEN substr(md5('label:' || CAST(p.pair_id AS VARCHAR)), 1, 1) IN ('0','1','2','3','4') THEN na.name || '–' || nb.name
         WHEN substr(md5('label:' || CAST(p.pair_id AS VARCHAR)), 1, 1) IN ('5','6','7','8','9') THEN na.name || '-' || nb.name
         WHEN substr(md5('label:' || CAST(p.pair_id AS VARCHAR)), 1, 1) IN ('a','b','c','d','e')
           THEN least(p.data_lang_a, p.data_lang_b) || '+' || greatest(p.data_lang_a, p.data_lang_b)
         ELSE p.data_lang_a || '+' || p.data_lang_b || '+en' END AS languages
  FROM two p LEFT JOIN names na ON p.data_lang_a = na.code LEFT JOIN names nb ON p.data_lang_b = nb.code),
pairmap AS (SELECT * FROM {S.values(list(PAIR_LABEL_MAP.items()), 'k, v')}),
renamed AS (SELECT * FROM {S.values(list(PAIR_RENAME.items()), 'k, v')}),
mapped AS (
  SELECT r.pair_id, r.codeswitch_sentence, r.dataset_source,
         replace(replace(COALESCE(rn.v, COALESCE(pm.v, r.languages)), '–', '-'), '—', '-') AS lab
  FROM raw r LEFT JOIN pairmap pm ON r.languages = pm.k
  LEFT JOIN renamed rn ON COALESCE(pm.v, r.languages) = rn.k
  WHERE len(string_split(r.languages, '+')) <= 2),
normed AS (
  SELECT pair_id, codeswitch_sentence, dataset_source,
    CASE WHEN len(string_split(lab, '-')) = 2 THEN array_to_string(list_sort(string_split(lab, '-')), '-') ELSE lab END
      AS languages
  FROM mapped),
cs AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset_source ORDER BY {S.md5_order('pair_id')}, pair_id)
                      <= floor(count(*) OVER (PARTITION BY dataset_source) * {CS_TRAIN_FRACTION})
                 THEN 'train' ELSE 'test' END AS split
  FROM normed)"""

CS_SQL = S.base(S.NAMES, PAIRS_SQL, _CS_SQL)


@register("cs_corpus", CS_SQL + "SELECT pair_id, codeswitch_sentence, languages, dataset_source, split FROM cs")
def cs_corpus(spark, sf_dir):
    return cs_corpus_df(spark, sf_dir).select("pair_id", "codeswitch_sentence", "languages", "dataset_source", "split")


@register(
    "cs_label_distribution",
    CS_SQL
    + """SELECT split, languages, CAST(count(*) AS BIGINT) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS percentage
FROM cs GROUP BY split, languages""",
)
def cs_label_distribution(spark, sf_dir):
    counts = cs_corpus_df(spark, sf_dir).groupBy("split", "languages").agg(F.count(F.lit(1)).alias("count"))
    # one row per (split, label): the window is over the label table, not the data
    return counts.withColumn(
        "percentage", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy("split")), 6)
    )


_CS_KEPT = f"""kept AS (
  SELECT * FROM cs WHERE (split, languages) IN (
    SELECT (split, languages) FROM cs GROUP BY split, languages HAVING count(*) >= {CS_MIN_COUNT}))"""


def cs_kept(spark, sf_dir) -> DataFrame:
    from langmix.operators.corpus import min_count_filter

    return min_count_filter(cs_corpus_df(spark, sf_dir), "languages", CS_MIN_COUNT, ["split"])


@register("cs_min_count", CS_SQL + ", " + _CS_KEPT + " SELECT pair_id, languages, split FROM kept")
def cs_min_count(spark, sf_dir):
    return cs_kept(spark, sf_dir).select("pair_id", "languages", "split")


@register(
    "cs_source_counts",
    CS_SQL + ", " + _CS_KEPT + " SELECT dataset_source, CAST(count(*) AS BIGINT) AS count FROM kept GROUP BY dataset_source",
)
def cs_source_counts(spark, sf_dir):
    return cs_kept(spark, sf_dir).groupBy("dataset_source").agg(F.count(F.lit(1)).alias("count"))
