"""Query keys 31-33: streaming profile / ingest / evaluation, resume by
manifest, and the three-set evaluation report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.operators import metrics as M
from langmix.operators.corpus import canonicalise_documents
from langmix.operators.detect import fit_char_ngram
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import ORACLE, register
from langmix.plans.q_detect import MAIN_N, SPLIT_SQL, detector_ctes, split_corpus
from langmix.session import ensure_checkpoint_dir, scratch_path
from langmix.sources.sinks import write_shards
from langmix.sources.tables import code_dimension, table
from langmix.streaming import jobs as ST

# ---------------------------------------------------------------- 31 streaming


def _doc_stream(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    raw = ST.parquet_stream(spark, sf_dir, "documents")
    # ST5 field defaults: a missing text is the empty string
    return raw.withColumn("text", F.coalesce("text", F.lit("")))


def _folder(spark, sf_dir, job: str, *tables: str, **parameters) -> str:
    """The job's folder for these tables (documents, if none is named): a killed run's batches are not done again."""
    return ST.job_folder(spark, job, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in tables or ("documents",)], **parameters)


@register("stream_profile", ORACLE["corpus_language_summary"])
def stream_profile(spark, sf_dir):
    stream = canonicalise_documents(_doc_stream(spark, sf_dir), code_dimension(spark))
    return ST.stream_profile(spark, stream, _folder(spark, sf_dir, "stream-profile"))["language"]


@register("stream_ingest", ORACLE["corpus_canonical"])
def stream_ingest(spark, sf_dir):
    stream = canonicalise_documents(_doc_stream(spark, sf_dir), code_dimension(spark))
    return ST.stream_ingest(spark, stream, _folder(spark, sf_dir, "stream-ingest")).select("doc_id", "sentence", "data_lang", "language", "dataset")


@register(
    "stream_eval",
    S.base(SPLIT_SQL, *detector_ctes(MAIN_N, "train", "language", "corpus", "doc_id", "sentence", "det"))
    + """SELECT c.doc_id, c.language AS gold, p.lang AS pred_lang, round(p.prob, 6) AS pred_prob
FROM corpus c JOIN det p ON p.id = c.doc_id AND p.r = 1""",
)
def stream_eval(spark, sf_dir):
    sp = split_corpus(spark, sf_dir)
    model = fit_char_ngram(X.spread(sp.filter(F.col("split") == "train"), "doc_id"), "sentence", "language", MAIN_N)
    stream = canonicalise_documents(_doc_stream(spark, sf_dir), code_dimension(spark))

    def score(batch: DataFrame) -> DataFrame:
        pred = model.transform(batch, "doc_id", "sentence")
        return batch.select("doc_id", F.col("language").alias("gold")).join(pred, "doc_id").select(
            "doc_id", "gold", "pred_lang", F.round("pred_prob", 6).alias("pred_prob")
        )

    return ST.stream_map(spark, stream, score, _folder(spark, sf_dir, "stream-eval", n=MAIN_N))


@register(
    "stream_ingest_events",
    """SELECT event_id, user_id, event_type, value, trim(props) AS props FROM events
WHERE props IS NOT NULL AND trim(props) <> ''""",
)
def stream_ingest_events(spark, sf_dir):
    """ST1/ST4 on the ``events`` table: drop empty records, trim, append grouped by type."""
    ensure_checkpoint_dir(spark)
    raw = ST.parquet_stream(spark, sf_dir, "events")
    clean = raw.filter(F.col("props").isNotNull() & (F.trim("props") != "")).select(
        "event_id", "user_id", "event_type", "value", F.trim("props").alias("props")
    )
    out = _folder(spark, sf_dir, "stream-events", "events")

    def sink(batch, batch_id):
        ST._overwrite_batch(batch, f"{out}/data", batch_id, ("event_type",))

    ST.run_available(clean, sink, f"{out}/_checkpoint")
    return spark.read.parquet(f"{out}/data").select("event_id", "user_id", "event_type", "value", "props")


@register(
    "benchmark_predictions",
    S.base(SPLIT_SQL, *detector_ctes(MAIN_N, "train", "language", "benchmark", "item_id", "text", "det"))
    + """SELECT b.item_id, p.lang AS pred_lang, round(p.prob, 6) AS pred_prob
FROM benchmark b JOIN det p ON p.id = b.item_id AND p.r = 1""",
)
def benchmark_predictions(spark, sf_dir):
    """The held-out ``benchmark`` items scored by the main detector (M1 on an external set)."""
    sp = split_corpus(spark, sf_dir)
    model = fit_char_ngram(X.spread(sp.filter(F.col("split") == "train"), "doc_id"), "sentence", "language", MAIN_N)
    items = table(spark, sf_dir, "benchmark")
    pred = model.transform(items, "item_id", "text")
    return pred.select("item_id", "pred_lang", F.round("pred_prob", 6).alias("pred_prob"))


# ---------------------------------------------------------------- 32 resume


def _first_run_key(dataset, language):
    return F.substring(F.md5(F.concat(F.lit("resume:"), dataset, F.lit(":"), language)), 1, 1) < F.lit("8")


@register(
    "resume_left_anti",
    S.base()
    + """SELECT doc_id, dataset, language,
  CASE WHEN substr(md5('resume:' || dataset || ':' || language), 1, 1) < '8' THEN 1 ELSE 2 END AS run FROM corpus""",
)
def resume_left_anti(spark, sf_dir):
    """K1 + K9: a first run writes the shards of part of the (dataset, language)
    keys; the manifest is read back from the written partitions; the second
    run processes ``corpus left_anti manifest`` and appends. The result is the
    whole corpus, each row written once."""
    corpus = X.corpus(spark, sf_dir).select("doc_id", "dataset", "language")
    out = scratch_path(spark, "shards")
    write_shards(corpus.filter(_first_run_key(F.col("dataset"), F.col("language"))).withColumn("run", F.lit(1)), out)
    done = spark.read.parquet(out).select("dataset", "language").distinct()
    remaining = corpus.join(done, ["dataset", "language"], "left_anti")
    write_shards(remaining.withColumn("run", F.lit(2)), out)
    return spark.read.parquet(out).select("doc_id", "dataset", "language", "run")


# ---------------------------------------------------------------- 33 eval sets

SENTENCE_LEVEL_LANGS = ("eng", "fra")  # languages whose sentence-level config exists (S15 spec)
_STRIP_HTML = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"


def eval_sets(spark, sf_dir) -> DataFrame:
    """E17-E19 restated on the driver's tables:
    * flores-like: dev documents, newlines deleted (F13);
    * smol-like (S15): sentence-level rows (lines) for languages that have them,
      document-level rows (segments joined, F23) for the others, domain set;
    * pages: tag-stripped page text, gold = the page's ``lang`` attribute.
    Rows: eval_id, data_name, gold, text, domain."""
    dev = split_corpus(spark, sf_dir).filter(F.col("split") == "dev")
    flores = dev.select(
        F.concat(F.lit("flores:"), F.col("doc_id").cast("string")).alias("eval_id"),
        F.lit("flores").alias("data_name"), F.col("language").alias("gold"),
        T.delete_newlines("sentence").alias("text"), F.lit("document").alias("domain"),
    )
    lines = dev.select("doc_id", "language", F.posexplode(F.split("sentence", "\n")).alias("i", "line"))
    primary = lines.filter(F.col("language").isin(*SENTENCE_LEVEL_LANGS)).select(
        F.concat(F.lit("smol:"), F.col("doc_id").cast("string"), F.lit("/"), F.col("i").cast("string")).alias("eval_id"),
        F.lit("smol").alias("data_name"), F.col("language").alias("gold"),
        T.strip_ws("line").alias("text"), F.lit("sentence").alias("domain"),
    ).filter(F.col("text") != "")
    fallback = dev.select(
        F.concat(F.lit("smol:"), F.col("doc_id").cast("string")).alias("eval_id"),
        F.lit("smol").alias("data_name"), F.col("language").alias("gold"),
        T.newlines_to_space(T.join_segments(F.split("sentence", "\n"))).alias("text"), F.lit("document").alias("domain"),
    )
    smol = primary.unionByName(fallback.join(primary.select("gold").distinct(), "gold", "left_anti"))
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace(F.col("html"), _STRIP_HTML, " "), "<[^>]+>", " ")
    page_rows = pages.select(
        F.concat(F.lit("pages:"), F.col("page_id").cast("string")).alias("eval_id"),
        F.lit("pages").alias("data_name"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("gold"),
        T.strip_ws(F.regexp_replace(body, r"\s+", " ")).alias("text"),
        F.lit("page").alias("domain"),
    )
    return reduce(DataFrame.unionByName, [flores, smol, page_rows])


_EVAL_SQL = f"""flores AS (SELECT 'flores:' || CAST(doc_id AS VARCHAR) AS eval_id, 'flores' AS data_name, language AS gold,
    replace(sentence, chr(10), '') AS text FROM dev),
lines AS (SELECT doc_id, language, unnest(string_split(sentence, chr(10))) AS line,
    generate_subscripts(string_split(sentence, chr(10)), 1) - 1 AS i FROM dev),
prim AS (SELECT 'smol:' || CAST(doc_id AS VARCHAR) || '/' || CAST(i AS VARCHAR) AS eval_id, 'smol' AS data_name,
    language AS gold, {S.strip('line')} AS text FROM lines WHERE language IN ('eng', 'fra') AND {S.strip('line')} <> ''),
fb AS (SELECT 'smol:' || CAST(doc_id AS VARCHAR) AS eval_id, 'smol' AS data_name, language AS gold,
    {S.strip("replace(sentence, chr(10), ' ')")} AS text FROM dev WHERE language NOT IN (SELECT gold FROM prim)),
pg AS (SELECT 'pages:' || CAST(page_id AS VARCHAR) AS eval_id, 'pages' AS data_name,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS gold,
    {S.strip("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")} AS text
    FROM pages),
evalset AS (SELECT * FROM flores UNION ALL SELECT * FROM prim UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM pg)"""

_F3 = """CASE WHEN length({c}) = 2 THEN COALESCE((SELECT iso_3 FROM codes WHERE iso_1 = {c}), {c}) ELSE {c} END"""


@register(
    "eval_sets_report",
    S.base(SPLIT_SQL, _EVAL_SQL, *detector_ctes(MAIN_N, "train", "language", "evalset", "eval_id", "text", "det"))
    + f""", scored AS (
  SELECT e.data_name, CAST({_F3.format(c='e.gold')} = {_F3.format(c='p.lang')} AS DOUBLE) AS acc
  FROM evalset e JOIN det p ON p.id = e.eval_id AND p.r = 1
  WHERE e.gold IS NOT NULL AND p.lang IS NOT NULL AND e.gold NOT IN ('und', 'other'))
SELECT data_name, 'char{MAIN_N}' AS model, round(avg(acc) * 100, 4) AS acc, round(avg(acc) * 100, 4) AS f1,
  round(avg(1 - acc) * 100, 4) AS fpr, CAST(count(*) AS BIGINT) AS n_rows FROM scored GROUP BY data_name""",
)
def eval_sets_report(spark, sf_dir):
    """Every set scored by the same model in one grouped job (no per-set loop)."""
    sp = split_corpus(spark, sf_dir)
    model = fit_char_ngram(X.spread(sp.filter(F.col("split") == "train"), "doc_id"), "sentence", "language", MAIN_N)
    sets = X.spread(eval_sets(spark, sf_dir), "eval_id").checkpoint()
    pred = model.transform(sets, "eval_id", "text")
    rows = sets.join(pred, "eval_id").withColumn("model", F.lit(f"char{MAIN_N}"))
    summary = M.score_predictions(rows, code_dimension(spark), "gold", data_name=None, group="data_name")
    return summary.select("data_name", F.lit(f"char{MAIN_N}").alias("model"), "acc", "f1", "fpr", "n_rows")
