"""Query keys 21-24: char n-gram detection, scoring, corpus metrics and the
resource-class report. Three "systems" are the detector with n = 1, 2, 3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.operators import metrics as M
from langmix.operators.corpus import split_by_rank
from langmix.operators.detect import detect_all, fit_char_ngram_multi
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import TRAIN_FRACTION, register
from langmix.sources.tables import code_dimension, resource_class_dimension

SYSTEMS = (1, 2, 3)
MAIN_N = 3

# ---------------------------------------------------------------- Spark side


def split_corpus(spark, sf_dir) -> DataFrame:
    return split_by_rank(X.corpus(spark, sf_dir), TRAIN_FRACTION)


def predictions(spark, sf_dir, systems=SYSTEMS) -> DataFrame:
    """Dev-split predictions of each system: doc_id, dataset, gold, pred_lang, pred_prob, top_preds, system."""
    sp = split_corpus(spark, sf_dir)
    train = X.spread(sp.filter(F.col("split") == "train"), "doc_id")
    dev = X.spread(sp.filter(F.col("split") == "dev"), "doc_id")
    models = fit_char_ngram_multi(train, "sentence", "language", systems)
    out = detect_all(models, dev, "doc_id", "sentence")
    out = out.withColumn("system", F.concat(F.lit("char"), F.col("n").cast("string"))).drop("n")
    meta = dev.select("doc_id", "dataset", F.col("language").alias("gold"))
    return meta.join(out, "doc_id")


def _flat_topk(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "gold",
        "pred_lang",
        F.round("pred_prob", 6).alias("pred_prob"),
        F.col("top_preds")[1]["lang"].alias("lang2"),
        F.round(F.col("top_preds")[1]["prob"], 6).alias("prob2"),
        F.col("top_preds")[2]["lang"].alias("lang3"),
        F.round(F.col("top_preds")[2]["prob"], 6).alias("prob3"),
    )


# ---------------------------------------------------------------- SQL side


def _gram_expr(n: int) -> str:
    return " || ".join(["c"] + [f"lead(c, {k}) OVER w" for k in range(1, n)])


def detector_ctes(n: int, train: str, label: str, evalset: str, id_col: str, text: str, name: str,
                  train_text: str = "sentence") -> list[str]:
    """The same smoothed char n-gram model in SQL; ``name`` has (id, lang, prob, r).
    Grams come from the code points of the padded text and ``lead()``."""
    pad = "regexp_extract_all(' ' || lower(regexp_replace({t}, '\\s+', ' ', 'g')) || ' ', '.')"
    return [
        f"{name}_tch AS (SELECT row_number() OVER () AS rid, {label} AS label, {pad.format(t=train_text)} AS ch FROM {train})",
        f"""{name}_c AS (SELECT label, g, count(*) AS c FROM (
  SELECT label, {_gram_expr(n)} AS g FROM (
    SELECT rid, label, unnest(ch) AS c, generate_subscripts(ch, 1) AS i FROM {name}_tch)
  WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE g IS NOT NULL GROUP BY label, g)""",
        f"{name}_fl AS (SELECT label, -ln(sum(c) + (SELECT count(DISTINCT g) FROM {name}_c)) AS fl FROM {name}_c GROUP BY label)",
        f"{name}_ech AS (SELECT {id_col} AS id, {pad.format(t=text)} AS ch FROM {evalset})",
        f"""{name}_dg AS (SELECT id, g, count(*) AS k FROM (
  SELECT id, {_gram_expr(n)} AS g FROM (
    SELECT id, unnest(ch) AS c, generate_subscripts(ch, 1) AS i FROM {name}_ech)
  WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE g IS NOT NULL GROUP BY id, g)""",
        f"{name}_tot AS (SELECT id, CAST(greatest(len(ch) - {n} + 1, 0) AS DOUBLE) AS t FROM {name}_ech)",
        f"""{name}_seen AS (SELECT dg.id, c.label, sum(dg.k * ln(c.c + 1)) AS s
  FROM {name}_dg dg JOIN {name}_c c ON dg.g = c.g GROUP BY dg.id, c.label)""",
        f"""{name}_sc AS (SELECT t.id, f.label AS lang, t.t * f.fl + COALESCE(s.s, 0) AS score
  FROM {name}_tot t CROSS JOIN {name}_fl f LEFT JOIN {name}_seen s ON s.id = t.id AND s.label = f.label)""",
        f"{name}_mx AS (SELECT id, lang, score, max(score) OVER (PARTITION BY id) AS mx FROM {name}_sc)",
        f"""{name} AS (SELECT id, lang, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY id) AS prob,
  row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS r FROM {name}_mx)""",
    ]


SPLIT_SQL = f"""sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {S.md5_order('doc_id')}, doc_id)
    <= floor(count(*) OVER () * {TRAIN_FRACTION}) THEN 'train' ELSE 'dev' END AS split FROM corpus),
train AS (SELECT * FROM sp WHERE split = 'train'),
dev AS (SELECT * FROM sp WHERE split = 'dev')"""


def preds_sql(systems=SYSTEMS) -> list[str]:
    ctes = []
    for n in systems:
        ctes += detector_ctes(n, "train", "language", "dev", "doc_id", "sentence", f"det{n}")
    union = " UNION ALL ".join(
        f"""SELECT 'char{n}' AS system, d.doc_id, d.dataset, d.language AS gold, d.sentence, p.lang AS pred_lang,
  p.prob AS pred_prob FROM dev d JOIN det{n} p ON p.id = d.doc_id AND p.r = 1"""
        for n in systems
    )
    ctes.append(f"preds AS ({union})")
    return ctes


def detect_base(systems=SYSTEMS) -> str:
    return S.base(SPLIT_SQL, *preds_sql(systems))


# ---------------------------------------------------------------- 21 detect_char_ngram


@register(
    "detect_char_ngram",
    S.base(SPLIT_SQL, *detector_ctes(MAIN_N, "train", "language", "dev", "doc_id", "sentence", "det"))
    + """SELECT d.doc_id, d.language AS gold,
  max(CASE WHEN p.r = 1 THEN p.lang END) AS pred_lang, round(max(CASE WHEN p.r = 1 THEN p.prob END), 6) AS pred_prob,
  max(CASE WHEN p.r = 2 THEN p.lang END) AS lang2, round(max(CASE WHEN p.r = 2 THEN p.prob END), 6) AS prob2,
  max(CASE WHEN p.r = 3 THEN p.lang END) AS lang3, round(max(CASE WHEN p.r = 3 THEN p.prob END), 6) AS prob3
FROM dev d JOIN det p ON p.id = d.doc_id GROUP BY d.doc_id, d.language""",
)
def detect_char_ngram(spark, sf_dir):
    return _flat_topk(predictions(spark, sf_dir, (MAIN_N,)))


# ---------------------------------------------------------------- 22 score_predictions

_F3 = """CASE WHEN length({c}) = 2 THEN COALESCE((SELECT iso_3 FROM codes WHERE iso_1 = {c}), {c}) ELSE {c} END"""


@register(
    "score_predictions",
    detect_base()
    + f""", scored AS (
  SELECT system, CAST({_F3.format(c='gold')} = {_F3.format(c='pred_lang')} AS DOUBLE) AS acc FROM preds
  WHERE gold IS NOT NULL AND pred_lang IS NOT NULL AND gold NOT IN ('und', 'other'))
SELECT system, 'documents' AS data_name, round(avg(acc) * 100, 4) AS acc, round(avg(acc) * 100, 4) AS f1,
  round(avg(1 - acc) * 100, 4) AS fpr, CAST(count(*) AS BIGINT) AS n_rows FROM scored GROUP BY system""",
)
def score_predictions(spark, sf_dir):
    return M.score_predictions(predictions(spark, sf_dir), code_dimension(spark), "gold", data_name="documents")


# ---------------------------------------------------------------- 23 corpus metrics

_CONF = """conf AS (SELECT system, gold, pred_lang AS pred, count(*) AS n FROM preds GROUP BY 1, 2, 3),
marg AS (
  SELECT l.system, l.label,
    COALESCE((SELECT sum(n) FROM conf c WHERE c.system = l.system AND c.gold = l.label), 0) AS row_n,
    COALESCE((SELECT sum(n) FROM conf c WHERE c.system = l.system AND c.pred = l.label), 0) AS col_n,
    COALESCE((SELECT sum(n) FROM conf c WHERE c.system = l.system AND c.gold = l.label AND c.pred = l.label), 0) AS tp,
    (SELECT sum(n) FROM conf c WHERE c.system = l.system) AS total
  FROM (SELECT system, gold AS label FROM conf UNION SELECT system, pred FROM conf) l),
pc AS (SELECT system, label,
    CASE WHEN row_n + col_n > 0 THEN 2.0 * tp / (row_n + col_n) ELSE 0.0 END AS f1,
    CASE WHEN (col_n - tp) + (total - (row_n + col_n - tp)) > 0
         THEN (col_n - tp) / ((col_n - tp) + (total - (row_n + col_n - tp))) ELSE 0.0 END AS fpr
  FROM marg)"""


def _conf(spark, sf_dir):
    p = predictions(spark, sf_dir).checkpoint()
    return p, M.confusion(p, "gold", "pred_lang")


@register("confusion", detect_base() + ", " + _CONF + " SELECT system, gold, pred, CAST(n AS BIGINT) AS n FROM conf")
def confusion(spark, sf_dir):
    return _conf(spark, sf_dir)[1]


@register("macro_f1", detect_base() + ", " + _CONF + " SELECT system, round(avg(f1), 6) AS macro_f1 FROM pc GROUP BY system")
def macro_f1(spark, sf_dir):
    return M.macro_f1(_conf(spark, sf_dir)[1])


@register("classwise_fpr", detect_base() + ", " + _CONF + " SELECT system, label, round(fpr, 6) AS fpr FROM pc")
def classwise_fpr(spark, sf_dir):
    return M.per_class(_conf(spark, sf_dir)[1]).select("system", "label", F.round("fpr", 6).alias("fpr"))


@register(
    "micro_fpr",
    detect_base()
    + ", "
    + _CONF
    + """, mac AS (SELECT system, round(avg(fpr), 6) AS macro_fpr FROM pc GROUP BY system),
mic AS (SELECT system, round(COALESCE(avg(CAST(gold <> pred_lang AS DOUBLE)), 0.0), 6) AS micro_fpr FROM preds GROUP BY system)
SELECT mac.system, macro_fpr, micro_fpr FROM mac JOIN mic ON mac.system = mic.system""",
)
def micro_fpr(spark, sf_dir):
    p, conf = _conf(spark, sf_dir)
    return M.fpr_summary(p, conf, "gold", "pred_lang")


# ---------------------------------------------------------------- 24 resource classes


def result_rows(spark, sf_dir) -> DataFrame:
    """E15 input: the main system's rows, one "result file" (model) per source."""
    p = predictions(spark, sf_dir, (MAIN_N,))
    return p.select(
        F.col("dataset").alias("model"),
        F.col("gold").alias("lang_code"),
        M.code_stripped_f1(F.col("gold"), F.col("pred_lang")).alias("f1"),
        (F.col("gold") != F.col("pred_lang")).cast("double").alias("fpr"),
    )


_RESULT_ROWS = """rows AS (
  SELECT d.dataset AS model, d.language AS lang_code,
    CAST(regexp_extract(d.language, '^[^-_]*', 0) = split_part(replace(p.lang, '__label__', ''), '_', 1) AS DOUBLE) AS f1,
    CAST(d.language <> p.lang AS DOUBLE) AS fpr
  FROM dev d JOIN det p ON p.id = d.doc_id AND p.r = 1),
lg AS (SELECT model, lang_code, class, avg(f1) AS f1, avg(fpr) AS fpr, CAST(count(*) AS BIGINT) AS sample_size
  FROM rows JOIN classes USING (lang_code) WHERE class IS NOT NULL GROUP BY model, lang_code, class)"""

_RES_BASE = S.base(S.CLASSES, SPLIT_SQL, *detector_ctes(MAIN_N, "train", "language", "dev", "doc_id", "sentence", "det"), _RESULT_ROWS)


@register("resource_lang_report", _RES_BASE + "SELECT model, lang_code, class, round(f1, 6) AS f1, round(fpr, 6) AS fpr, sample_size FROM lg")
def resource_lang_report(spark, sf_dir):
    groups = M.resource_lang_groups(result_rows(spark, sf_dir), resource_class_dimension(spark))
    return groups.withColumns({c: F.round(c, 6) for c in ("f1", "fpr")})


@register(
    "resource_class_report",
    _RES_BASE
    + """SELECT model, class, round(avg(f1), 6) AS avg_f1, CAST(count(*) AS BIGINT) AS num_languages,
  CAST(sum(sample_size) AS BIGINT) AS total_samples FROM lg GROUP BY model, class""",
)
def resource_class_report(spark, sf_dir):
    lang = M.resource_lang_groups(result_rows(spark, sf_dir), resource_class_dimension(spark))
    return M.resource_class_groups(lang)


@register(
    "class_micro_report",
    _RES_BASE
    + """SELECT model, class, round(avg(f1), 6) AS avg_f1, CAST(count(*) AS BIGINT) AS count
FROM rows JOIN classes USING (lang_code) GROUP BY model, class""",
)
def class_micro_report(spark, sf_dir):
    return M.class_micro_groups(result_rows(spark, sf_dir), resource_class_dimension(spark))


@register(
    "class_low5",
    _RES_BASE
    + """SELECT * FROM (SELECT class, lang_code, round(f1_mean, 6) AS f1_mean, sample_data,
    row_number() OVER (PARTITION BY class ORDER BY f1_mean, lang_code) AS rank
  FROM (SELECT class, lang_code, avg(f1) AS f1_mean, CAST(count(*) AS BIGINT) AS sample_data
        FROM rows JOIN classes USING (lang_code) GROUP BY class, lang_code)) WHERE rank <= 5""",
)
def class_low5(spark, sf_dir):
    low = M.lowest_per_class(result_rows(spark, sf_dir), resource_class_dimension(spark))
    return low.withColumn("f1_mean", F.round("f1_mean", 6))


@register(
    "class_top5",
    _RES_BASE
    + """SELECT * FROM (SELECT class, lang_code, count,
    row_number() OVER (PARTITION BY class ORDER BY count DESC, lang_code) AS rank
  FROM (SELECT class, lang_code, CAST(count(*) AS BIGINT) AS count
        FROM rows JOIN classes USING (lang_code) GROUP BY class, lang_code)) WHERE rank <= 5""",
)
def class_top5(spark, sf_dir):
    return M.largest_per_class(result_rows(spark, sf_dir), resource_class_dimension(spark))
