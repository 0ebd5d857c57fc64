"""Query keys of the evaluation sets: each by its spec with its metadata (E17-E22), and all together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.operators.detect import fit_char_ngram
from langmix.operators.evaluate import EVAL_SPECS, evaluate, evaluate_all
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import register
from langmix.plans.q_detect import MAIN_N, SPLIT_SQL, detector_ctes, split_corpus
from langmix.plans.q_pairs import CS_SQL, cs_corpus_df
from langmix.sources.readers import read_first_available
from langmix.sources.tables import code_dimension, table
from langmix.streaming import jobs as ST

SENTENCE_LEVEL_LANGS = ("eng", "fra")  # languages whose sentence-level rows exist (S15)
_STRIP_HTML = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"


def _model(spark, sf_dir):
    return fit_char_ngram(X.spread(split_corpus(spark, sf_dir).filter(F.col("split") == "train"), "doc_id"), "sentence", "language", MAIN_N)


def _dev(spark, sf_dir) -> DataFrame:
    return split_corpus(spark, sf_dir).filter(F.col("split") == "dev")


def flores(dev: DataFrame) -> DataFrame:
    """Flores-like rows: dev documents; the script is known from the language."""
    return dev.select("doc_id", F.col("sentence").alias("text"), F.col("language").alias("iso_639_3"), F.col("dataset").alias("domain"),
                      F.col("data_lang").alias("topic"), F.lit("Latn").alias("iso_15924"))


def smol(dev: DataFrame) -> DataFrame:
    """Smol-like rows (S15): single lines where sentence-level rows exist, else documents as arrays of segments."""
    lines = dev.where(F.col("language").isin(*SENTENCE_LEVEL_LANGS)).select("doc_id", "language", F.posexplode(F.split("sentence", "\n")).alias("i", "line"))
    primary = lines.where(T.strip_ws("line") != "").select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("id"), F.col("language").alias("tl"),
        F.array("line").alias("trg"), F.lit("sentence").alias("domain"))
    whole = dev.select(F.col("doc_id").cast("string").alias("id"), F.col("language").alias("tl"), F.split("sentence", "\n").alias("trg"))
    return read_first_available(primary, whole, "tl")


def stories(pages: DataFrame) -> DataFrame:
    """Story-like rows: the page's text without markup, its own language mark, and what a story brings along."""
    body = F.regexp_replace(F.regexp_replace("html", _STRIP_HTML, " "), "<[^>]+>", " ")
    return pages.select(
        "page_id", T.strip_ws(F.regexp_replace(body, r"\s+", " ")).alias("text"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("language_code"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("language"),
        F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("copyright"),
        F.regexp_count("html", F.lit("<p>")).cast("long").alias("pageCount"), F.col("page_id").cast("string").alias("bookInstanceId"),
        F.col("url").alias("bookLineage"))


def tweets(dev: DataFrame) -> DataFrame:
    """Tweet-like rows: each dev document whole, its two-letter code, and all other columns."""
    return dev.select("doc_id", F.col("sentence").alias("tweet"), F.col("data_lang").alias("lang_code"), F.col("dataset").alias("user"))


def voice(spark, sf_dir, dev: DataFrame) -> DataFrame:
    """Voice-like rows: each dev document whole; votes from its labels, missing where it has none."""
    votes = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("up_votes"), F.col("toxic").cast("long").alias("down_votes"))
    rows = dev.select(
        "doc_id", "sentence", F.col("data_lang").alias("language_code"), F.lit(None).cast("string").alias("age"), F.lit(None).cast("string").alias("gender"),
        F.col("dataset").alias("accent"))
    return rows.join(votes, "doc_id", "left")


_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"
_FLORES = "flores AS (SELECT doc_id, language AS gold, dataset AS domain, data_lang AS topic, 'Latn' AS iso_15924, replace(sentence, chr(10), '') AS text FROM dev)"
_SMOL = f"""lines AS (SELECT doc_id, language, unnest(string_split(sentence, chr(10))) AS line, generate_subscripts(string_split(sentence, chr(10)), 1) - 1 AS i FROM dev),
prim AS (SELECT CAST(doc_id AS VARCHAR) || '/' || CAST(i AS VARCHAR) AS id, language AS gold, {S.strip('line')} AS text, 'sentence' AS domain
  FROM lines WHERE language IN ('eng', 'fra') AND {S.strip('line')} <> ''),
smol AS (SELECT * FROM prim UNION ALL SELECT CAST(doc_id AS VARCHAR), language, {S.strip("replace(sentence, chr(10), ' ')")}, 'document' FROM dev
  WHERE language NOT IN (SELECT gold FROM prim))"""
_STORIES = f"""stories AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS gold, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url,
  len(regexp_extract_all(html, '<p>')) AS pages, {S.strip(_HTML)} AS text FROM pages)"""
_TWEETS = "tweets AS (SELECT doc_id, sentence AS tweet, data_lang AS lang_code, dataset AS user FROM dev)"
_VOICE = """voice AS (SELECT d.doc_id, sentence, data_lang AS language_code, dataset AS accent,
  CAST(quality AS BIGINT) AS up_votes, CAST(toxic AS BIGINT) AS down_votes FROM dev d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _sql(rows: str, target: str, id_col: str, text: str, select: str) -> str:
    return S.base(SPLIT_SQL, rows, *detector_ctes(MAIN_N, "train", "language", target, id_col, text, "det")) + select


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_prob", F.round("pred_prob", 6))


_PRED = "p.lang AS pred_lang, round(p.prob, 6) AS pred_prob"


@register("eval_flores", _sql(_FLORES, "flores", "doc_id", "text", f"SELECT f.*, {_PRED}, 'flores' AS data_name FROM flores f JOIN det p ON p.id = f.doc_id AND p.r = 1"))
def eval_flores(spark, sf_dir):
    return _rounded(evaluate(flores(_dev(spark, sf_dir)), EVAL_SPECS["flores"], _model(spark, sf_dir), "doc_id"))


@register("eval_smol", _sql(_SMOL, "smol", "id", "text", f"SELECT s.*, {_PRED}, 'smol' AS data_name FROM smol s JOIN det p ON p.id = s.id AND p.r = 1"))
def eval_smol(spark, sf_dir):
    return _rounded(evaluate(smol(_dev(spark, sf_dir)), EVAL_SPECS["smol"], _model(spark, sf_dir), "id"))


@register("eval_stories", _sql(_STORIES, "stories", "page_id", "text", f"""SELECT s.page_id, s.gold, s.title, s.gold AS language, CAST(NULL AS VARCHAR) AS license,
  CAST(NULL AS VARCHAR) AS copyright, CAST(s.pages AS BIGINT) AS "pageCount", CAST(s.page_id AS VARCHAR) AS "bookInstanceId", s.url AS "bookLineage", s.text, {_PRED},
  'bloom_stories' AS data_name FROM stories s JOIN det p ON p.id = s.page_id AND p.r = 1"""))
def eval_stories(spark, sf_dir):
    pages = X.spread(table(spark, sf_dir, "pages"), "page_id")
    return _rounded(evaluate(stories(pages), EVAL_SPECS["bloom_stories"], _model(spark, sf_dir), "page_id"))


@register("eval_tweets", _sql(_TWEETS, "tweets", "doc_id", "tweet", f"""SELECT t.doc_id, t.lang_code AS gold, t.tweet, t.user, {_PRED},
  'tweetlid' AS data_name FROM tweets t JOIN det p ON p.id = t.doc_id AND p.r = 1"""))
def eval_tweets(spark, sf_dir):
    return _rounded(evaluate(tweets(_dev(spark, sf_dir)), EVAL_SPECS["tweetlid"], _model(spark, sf_dir), "doc_id"))


@register("eval_voice", _sql(_VOICE, "voice", "doc_id", "sentence", f"""SELECT v.doc_id, v.language_code AS gold, CAST(NULL AS VARCHAR) AS age,
  CAST(NULL AS VARCHAR) AS gender, v.accent, v.up_votes, v.down_votes, v.sentence AS text, {_PRED}, 'common_voice' AS data_name
FROM voice v JOIN det p ON p.id = v.doc_id AND p.r = 1"""))
def eval_voice(spark, sf_dir):
    return _rounded(evaluate(voice(spark, sf_dir, _dev(spark, sf_dir)), EVAL_SPECS["common_voice"], _model(spark, sf_dir), "doc_id"))


@register("eval_code_switch", CS_SQL + ", " + ",\n".join([
    SPLIT_SQL, "target AS (SELECT * FROM cs WHERE split = 'test')", *detector_ctes(MAIN_N, "train", "language", "target", "pair_id", "codeswitch_sentence", "det")])
    + f"""
SELECT t.pair_id, t.languages AS gold, t.codeswitch_sentence, t.dataset_source, t.split, {_PRED.replace('p.', 'a.')}, 'code_switch' AS data_name,
  a.lang || ':' || CAST(round(a.prob, 6) > 0.5 AS VARCHAR) || ',' || b.lang || ',' || c.lang AS top3
FROM target t JOIN det a ON a.id = t.pair_id AND a.r = 1 JOIN det b ON b.id = t.pair_id AND b.r = 2 JOIN det c ON c.id = t.pair_id AND c.r = 3""")
def eval_code_switch(spark, sf_dir):
    """All input columns and the ranked alternatives beside the top label."""
    test = X.spread(cs_corpus_df(spark, sf_dir).where("split = 'test'"), "pair_id")
    out = _rounded(evaluate(test, EVAL_SPECS["code_switch"], _model(spark, sf_dir), "pair_id", top_k=True))
    at = lambda i: F.col("top_preds")[i]["lang"]
    sure = (F.round(F.col("top_preds")[0]["prob"], 6) > 0.5).cast("string")
    return out.withColumn("top3", F.concat(at(0), F.lit(":"), sure, F.lit(","), at(1), F.lit(","), at(2))).drop("top_preds")


@register("stream_eval_voice", _sql(
    "voice AS (SELECT doc_id, coalesce(text, '') AS sentence, lang AS language_code, source AS accent FROM documents)", "voice", "doc_id", "sentence",
    f"""SELECT v.doc_id, v.language_code AS gold, '' AS age, '' AS gender, v.accent, CAST(0 AS BIGINT) AS up_votes, CAST(0 AS BIGINT) AS down_votes,
  v.sentence AS text, {_PRED}, 'common_voice' AS data_name FROM voice v JOIN det p ON p.id = v.doc_id AND p.r = 1"""))
def stream_eval_voice(spark, sf_dir):
    """ST5/E21: the streamed form; fields that the source lacks take their defaults."""
    model, spec = _model(spark, sf_dir), EVAL_SPECS["common_voice_stream"]
    stream = ST.parquet_stream(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("sentence"), F.col("lang").alias("language_code"), F.col("source").alias("accent"))
    folder = ST.job_folder(spark, "stream-voice", [f"{sf_dir.rstrip('/')}/documents.parquet"], n=MAIN_N)
    return ST.stream_map(spark, stream, lambda batch: _rounded(evaluate(batch, spec, model, "doc_id")), folder)


_F3 = """CASE WHEN length({c}) = 2 THEN COALESCE((SELECT iso_3 FROM codes WHERE iso_1 = {c}), {c}) ELSE {c} END"""


@register("evaluate_all", S.base(
    SPLIT_SQL, _FLORES, _SMOL, _STORIES, _TWEETS, _VOICE,
    """evalset AS (
  SELECT 'flores:' || CAST(doc_id AS VARCHAR) AS id, 'flores' AS data_name, gold, text FROM flores
  UNION ALL SELECT 'smol:' || id, 'smol', gold, text FROM smol
  UNION ALL SELECT 'stories:' || CAST(page_id AS VARCHAR), 'bloom_stories', gold, text FROM stories
  UNION ALL SELECT 'tweetlid:' || CAST(doc_id AS VARCHAR), 'tweetlid', lang_code, tweet FROM tweets
  UNION ALL SELECT 'common_voice:' || CAST(doc_id AS VARCHAR), 'common_voice', language_code, sentence FROM voice)""",
    *detector_ctes(MAIN_N, "train", "language", "evalset", "id", "text", "det"))
    + f""", scored AS (
  SELECT e.data_name, CAST({_F3.format(c='e.gold')} = {_F3.format(c='p.lang')} AS DOUBLE) AS acc
  FROM evalset e JOIN det p ON p.id = e.id AND p.r = 1
  WHERE e.gold IS NOT NULL AND p.lang IS NOT NULL AND e.gold NOT IN ('und', 'other'))
SELECT data_name, 'char{MAIN_N}' AS model, round(avg(acc) * 100, 4) AS acc, round(avg(acc) * 100, 4) AS f1,
  round(avg(1 - acc) * 100, 4) AS fpr, CAST(count(*) AS BIGINT) AS n_rows FROM scored GROUP BY data_name""")
def evaluate_all_q(spark, sf_dir):
    """The five sets by their specs, met by the detector as one frame."""
    split = split_corpus(spark, sf_dir)
    model = fit_char_ngram(X.spread(split.where("split = 'train'"), "doc_id"), "sentence", "language", MAIN_N)
    dev = split.where("split = 'dev'")
    sets = [(flores(dev), EVAL_SPECS["flores"], "doc_id"), (smol(dev), EVAL_SPECS["smol"], "id"),
            (stories(table(spark, sf_dir, "pages")), EVAL_SPECS["bloom_stories"], "page_id"),
            (tweets(dev), EVAL_SPECS["tweetlid"], "doc_id"), (voice(spark, sf_dir, dev), EVAL_SPECS["common_voice"], "doc_id")]
    return evaluate_all(sets, model, code_dimension(spark), f"char{MAIN_N}")
