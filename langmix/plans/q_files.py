"""Query keys of files: documents written by the library's sinks and read back by its readers (S1, S3, S5-S7, S9, S12, S13, S17,
K2-K5, K7, K8), rows joined by position (J5), code-switch splits row by row (T6), and the monolingual sources (C1-C13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.functions.codes import multi_hot
from langmix.operators import corpus as C
from langmix.operators.mono_sources import MONO_SOURCES, load_mono
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import register
from langmix.plans.q_sources import FILED, _sql as source_rows_sql, _named, cs_sources
from langmix.session import scratch_path
from langmix.sources import readers as R
from langmix.sources import sinks as K
from langmix.sources.lines import number_rows, positional_join, with_place
from langmix.sources.tables import code_dimension, table


def _docs(spark, sf_dir) -> DataFrame:
    return X.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _in_order(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Files in order of the key: names of written files follow the ranges."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"

# ---------------------------------------------------------------- one file format each


@register("csv_multiline", S.with_ctes(_DOCS) + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(nullif(text, '')) AS text_md5, lang FROM docs")
def csv_multiline(spark, sf_dir):
    """Texts with line breaks and quote marks in quoted fields; one file is read by many tasks."""
    path = scratch_path(spark, "csv")
    K.write_csv(_docs(spark, sf_dir).select("doc_id", "text", "lang"), path)
    return R.read_csv(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@register("jsonl_roundtrip", S.with_ctes(_DOCS) + "SELECT md5(text) AS text_md5, lang, source FROM docs")
def jsonl_roundtrip(spark, sf_dir):
    """K2 in two appends, S3."""
    path, docs = scratch_path(spark, "jsonl"), _docs(spark, sf_dir)
    for side in (0, 1):
        K.append_jsonl(docs.where(F.pmod("doc_id", F.lit(2)) == side), path)
    return R.read_jsonl(spark, path, ["text", "lang", "source"]).select(F.md5("text").alias("text_md5"), "lang", "source")


@register("label_file", S.base() + f"""SELECT language, md5({S.strip(f"replace({S.strip('sentence')}, chr(10), ' ')")}) AS sentence_md5 FROM corpus""")
def label_file(spark, sf_dir):
    """One label line for each sentence."""
    path = scratch_path(spark, "labels")
    K.write_label_text(X.corpus(spark, sf_dir), path)
    return R.read_label_text(spark, path).select("language", F.md5("sentence").alias("sentence_md5"))


@register("parquet_parts", S.with_ctes(_DOCS) + "SELECT source, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS ids FROM docs GROUP BY source")
def parquet_parts(spark, sf_dir):
    """Parts written one after another, those of another prefix left alone."""
    path, docs = scratch_path(spark, "parts"), _docs(spark, sf_dir)
    for k in range(3):
        docs.where(F.pmod("doc_id", F.lit(3)) == k).write.parquet(f"{path}/stats_{k}.parquet")
    docs.write.parquet(f"{path}/other_0.parquet")
    return R.read_parquet_parts(spark, path, "stats").groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"))


@register("line_sources", S.with_ctes(_DOCS, """lines AS (SELECT unnest(string_split(text, chr(10))) AS l FROM docs)""") + f"""
SELECT 'Turkish-English' AS languages, 'kept' AS dataset_source, md5({S.strip('l')}) AS sentence_md5 FROM lines
UNION ALL SELECT 'MSA-Egyptian', 'dropped', md5({S.strip('l')}) FROM lines WHERE {S.strip('l')} <> ''""")
def line_sources(spark, sf_dir):
    """S7 in both forms, S17: blank lines kept, and dropped."""
    path = scratch_path(spark, "lines")
    _docs(spark, sf_dir).select("text").write.text(path)
    both = R.read_splits([R.read_lines(spark, path, "Turkish-English", "kept", False), R.read_lines(spark, path, "MSA-Egyptian", "dropped")])
    return both.select("languages", "dataset_source", F.md5("codeswitch_sentence").alias("sentence_md5"))


_BLOCKS = """lines AS (SELECT conv_id, turn, i, l FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)
  WHERE {strip} <> ''),
blocks AS (SELECT conv_id, string_agg({strip}, '|' ORDER BY turn, i) AS text, count(*) AS n FROM lines GROUP BY conv_id)""".format(strip=S.strip("l"))


@register("blank_blocks", S.with_ctes(_BLOCKS) + "SELECT row_number() OVER (ORDER BY conv_id) - 1 AS block, md5(text) AS text_md5, n FROM blocks")
def blank_blocks(spark, sf_dir):
    """A conversation is a block of lines, parted from the next by lines of white space with a carriage return."""
    path = scratch_path(spark, "blocks")
    conv = table(spark, sf_dir, "conversations").withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda x: T.strip_ws(x) != ""), "\n"))
    rows = conv.where(F.col("text") != "").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    _in_order(rows, "conv_id").select(F.concat("text", F.lit("\n \t\r\n\r"))).write.text(path)
    got = number_rows(R.read_blank_blocks(spark, path).withColumnRenamed("block", "place"), "block")
    return got.select("block", F.md5(F.array_join("lines", "|")).alias("text_md5"), F.size("lines").cast("long").alias("n"))


@register("label_records", S.with_ctes(_DOCS) + "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, md5(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g')) AS text_md5 FROM docs WHERE doc_id % 3 <> 0")
def label_records(spark, sf_dir):
    """Records with two labels are dropped."""
    path = scratch_path(spark, "records")
    label = F.when(F.pmod("doc_id", F.lit(6)) == 0, F.concat("lang", F.lit("+en"))).when(F.pmod("doc_id", F.lit(3)) == 0, F.concat("lang", F.lit("/en"))).otherwise(F.col("lang"))
    flat = F.regexp_replace("text", "[\t\r\n]", " ")
    _docs(spark, sf_dir).select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("source"), label, flat)).write.text(path)
    return R.read_label_records(spark, path).select("id", "language", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@register("embedding_file", "SELECT 'w' || CAST(vec_id AS VARCHAR) AS token, len(embedding) AS size, round(list_sum(embedding), 3) + 0.0 AS total FROM embeddings")
def embedding_file(spark, sf_dir):
    """A header line, then a token and its numbers on each line."""
    path = scratch_path(spark, "vectors")
    vec = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<string>").alias("e"))
    lines = vec.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join("e", " ")).alias("value"))
    lines.unionByName(vec.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size("e")).cast("string")).alias("value"))).write.text(path)
    back = R.read_embeddings(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("token", F.size("vec").cast("long").alias("size"), (F.round(total, 3) + 0.0).alias("total"))


@register("split_files", S.with_ctes(_DOCS) + "SELECT CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM docs GROUP BY 1")
def split_files(spark, sf_dir):
    """K7, and K5: a summary appended for each split."""
    path, summary = scratch_path(spark, "split"), scratch_path(spark, "summary")
    K.write_split(_docs(spark, sf_dir).withColumn("split", F.when(F.pmod("doc_id", F.lit(10)) == 0, "dev").otherwise("train")), path)
    for split in ("train", "dev"):
        rows = spark.read.parquet(path).where(F.col("split") == split)
        K.append_summary(rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text").cast("long")).alias("chars")), summary)
    return spark.read.parquet(summary)


@register("prediction_file", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'quality-toxic' WHEN quality = 1 THEN 'quality'
  WHEN toxic = 1 THEN 'toxic' ELSE '' END AS labels, CAST(quality AS INT) * 10 + CAST(toxic AS INT) AS bits FROM labels""")
def prediction_file(spark, sf_dir):
    """K8 with F20: label lists written as text, and read back."""
    path = scratch_path(spark, "predictions")
    names = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    K.write_predictions(table(spark, sf_dir, "labels").select("doc_id", names.alias("labels")), path)
    back = R.read_csv(spark, path).select("doc_id", F.from_json("labels", "array<string>").alias("names"))
    bits = multi_hot("names", ["quality", "toxic"])
    return back.select("doc_id", F.array_join("names", "-").alias("labels"), (bits[0] * 10 + bits[1]).alias("bits"))


# ---------------------------------------------------------------- rows by position


@register("positional_join", S.base() + """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, language AS gold, CASE WHEN doc_id % 7 = 0 THEN 'und' ELSE language END AS pred FROM corpus""")
def positional_join_q(spark, sf_dir):
    """Gold labels and predictions in two sets of files of different cuts, aligned by position alone."""
    gold, pred = scratch_path(spark, "gold"), scratch_path(spark, "pred")
    corpus = X.corpus(spark, sf_dir).select("doc_id", "language")
    _in_order(corpus).select("language").write.text(gold)
    guess = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("und")).otherwise(F.col("language"))
    corpus.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select(F.concat(guess, F.lit("   "))).write.text(pred)
    left = with_place(spark.read.text(gold).withColumnRenamed("value", "gold"))
    right = with_place(spark.read.text(pred).select(F.trim("value").alias("pred")))
    return positional_join(left, right).select("row", "gold", "pred")


def _split_rows_sql() -> str:
    """Rows of the sources that come as one set: numbered as they stand in files written in order of doc_id."""
    one = {n: i for i, n in enumerate(FILED) if n in ("turkish", "msa_egyptian", "saudi", "indonesian")}
    kinds = ", ".join(str(i) for i in one.values())
    tweet = S.strip("regexp_replace(regexp_replace(s, '@\\S+', '', 'g'), '\\s+', ' ', 'g')")
    return source_rows_sql() + f""", o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS ordinal,
  CASE WHEN k = {one['indonesian']} THEN {tweet} ELSE s END AS s FROM f WHERE k IN ({kinds})),
cutoff AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {S.md5_order('ordinal')}, ordinal) <= floor(count(*) OVER (PARTITION BY k) * 0.7) AS head FROM o)
SELECT name, md5(s) AS sentence_md5, CASE WHEN head THEN 'train' ELSE 'test' END AS split FROM cutoff JOIN names USING (k)"""


@register("cs_source_split_rows", _split_rows_sql())
def cs_source_split_rows(spark, sf_dir):
    """T6 row by row: which row of a source's files goes to which split (files written in order of doc_id)."""
    rows = _named(cs_sources(spark, sf_dir)).where(F.col("name").isin("turkish", "msa_egyptian", "saudi", "indonesian"))
    return rows.select("name", F.md5(T.strip_ws("codeswitch_sentence")).alias("sentence_md5"), "split")


# ---------------------------------------------------------------- monolingual sources


_MONO = list(MONO_SOURCES)


def _mono_sql() -> str:
    n = len(_MONO)
    at = {m: i for i, m in enumerate(_MONO)}
    known = "(SELECT iso_3 FROM codes WHERE iso_1 = lang)"
    rows = "\n  UNION ALL ".join([
        f"SELECT 'minds14' AS name, text AS s, lang || '-XX' AS code, {known} AS l FROM d WHERE k = {at['minds14']}",
        f"SELECT 'ted_multi', text, lang, {known} FROM d WHERE k = {at['ted_multi']}",
        f"SELECT 'ted_multi', 'second ' || text, 'en-GB', 'eng' FROM d WHERE k = {at['ted_multi']}",
        f"SELECT 'ccaligned', text, lang || '_XX', {known} FROM d WHERE k = {at['ccaligned']} AND u % 4 > 0",
        f"SELECT 'glot500', text, {known} || '_Latn', {known} FROM d WHERE k = {at['glot500']}",
        *[f"SELECT '{m}', text, lang, lang FROM d WHERE k = {at[m]}" for m in ("bloom", "common_voice", "afrisenti", "naijasenti")],
        f"SELECT 'catalan_youtube', text, 'catalan', 'cat' FROM d WHERE k = {at['catalan_youtube']}",
        f"SELECT 'cantonese_youtube', {S.strip('text')}, 'cantonese', 'yue' FROM d WHERE k = {at['cantonese_youtube']} AND {S.strip('text')} <> ''",
        f"SELECT 'voxpopuli', text, lang, {known} FROM d WHERE k = {at['voxpopuli']}",
        f"""SELECT 'openlid_' || source, {S.strip('text')}, {known} || '_Latn', {known} FROM d WHERE k = {at['openlid']} AND {S.strip('text')} <> '' AND source <> 'tatoeba'
      AND (source <> 'tep' OR substr(md5('sample:42:' || CAST(doc_id AS VARCHAR)), 1, 8) < '4ccccccc')""",
        f"SELECT 'tweetlid', {S.strip('text')}, lang, {known} FROM d WHERE k = {at['tweetlid']} AND u % 3 > 0 AND regexp_replace(text, '\\s', '', 'g') <> ''",
    ])
    return S.with_ctes(S.CODES, f"""d AS (SELECT doc_id, {S.strip("regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')")} AS text, lang, doc_id // {n} AS u, doc_id % {n} AS k,
  CASE doc_id // {n} % 3 WHEN 0 THEN 'tatoeba' WHEN 1 THEN 'tep' ELSE 'books' END AS source FROM documents)""", f"r AS ({rows})") + """
SELECT name AS dataset, code AS data_lang, l AS language, md5(s) AS sentence_md5 FROM r"""


def _mono_write(df: DataFrame, name: str, path: str) -> None:
    """Rows ``(doc_id, text, lang, iso, source, u)`` in the form of the source's files."""
    code = {"minds14": F.concat("lang", F.lit("-XX")), "ccaligned": F.concat("lang", F.lit("_XX")), "glot500": F.concat("iso", F.lit("_Latn")),
            "openlid": F.concat("iso", F.lit("_Latn"))}.get(name, F.col("lang"))
    if name == "ted_multi":
        out = df.select(F.array("lang", F.lit("en-GB")).alias("language"), F.array("text", F.concat(F.lit("second "), "text")).alias("translation"))
    elif name == "ccaligned":  # a fourth have a code whose shard fails
        bad = F.when(F.col("u") % 4 == 0, F.lit("qa_XX")).otherwise(code)
        out = df.select(bad.alias("lang_code"), F.create_map(bad, F.col("text")).alias("translation"))
    elif name == "openlid":
        out = df.select("doc_id", "text", code.alias("language"), "source")
    elif name == "tweetlid":
        label = F.when(F.col("u") % 3 == 0, F.concat("lang", F.lit("+en"))).otherwise(F.col("lang"))
        df.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit("user"), label, F.col("text"))).write.text(path)
        return
    else:
        out = df.select(F.col("text").alias(MONO_SOURCES[name].sentence), code.alias("lang_code"))
    out.write.json(path) if name != "voxpopuli" else out.write.parquet(path)


@register("mono_sources", _mono_sql())
def mono_sources(spark, sf_dir):
    """C1-C13, UD4, P6: documents dealt to the sources, written in their forms, loaded by name."""
    flat = T.strip_ws(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    codes, n = code_dimension(spark), len(_MONO)
    docs = X.documents(spark, sf_dir).join(codes, F.col("lang") == F.col("iso_1"), "left").select(
        "doc_id", flat.alias("text"), "lang", F.col("iso_3").alias("iso"), (F.col("doc_id") % n).alias("k"), F.expr(f"doc_id div {n}").alias("u"))
    docs = docs.withColumn("source", F.when(F.col("u") % 3 == 0, "tatoeba").when(F.col("u") % 3 == 1, "tep").otherwise("books"))
    out = []
    for k, name in enumerate(_MONO):
        path = scratch_path(spark, f"mono-{name}")
        _mono_write(docs.where(F.col("k") == k), name, path)
        out.append(load_mono(spark, name, path, codes)[0])
    rows = reduce(DataFrame.unionByName, out)
    return rows.select("dataset", "data_lang", "language", F.md5("sentence").alias("sentence_md5"))


# ---------------------------------------------------------------- small operators


@register("corpus_views", S.base() + f"""SELECT 'unique' AS view, CAST(count(DISTINCT language) AS BIGINT) AS n, string_agg(DISTINCT language, ',' ORDER BY language) AS ids FROM corpus
UNION ALL SELECT 'sample', count(*), string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY h, doc_id) FROM (SELECT doc_id, {S.md5_order('doc_id')} AS h FROM corpus ORDER BY h, doc_id LIMIT 10)
UNION ALL SELECT 'columns', 3, 'doc_id,name,source'""")
def corpus_views(spark, sf_dir):
    """A13 (languages and their number), T8 (rows to look at: the sample is the feature), P13-P15 (columns after a merge)."""
    corpus = X.corpus(spark, sf_dir)
    unique = C.distinct_labels(corpus, "language").select(F.lit("unique").alias("view"), F.col("nunique").alias("n"), F.array_join("unique", ",").alias("ids"))
    sample = C.sample_rows(corpus.select("doc_id"), 10, "doc_id").withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))))
    picked = sample.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("ids"))
    shaped = C.with_literals(C.rename_columns(C.drop_prefixed_columns(corpus.drop("sentence", "data_lang"), "language"), {"dataset": "name"}), {"source": "merged"})
    columns = spark.createDataFrame([("columns", len(shaped.columns), ",".join(shaped.columns))], "view string, n long, ids string")
    return unique.unionByName(picked.select(F.lit("sample").alias("view"), "n", "ids")).unionByName(columns)


@register("shuffled", S.base() + f"""SELECT doc_id, row_number() OVER (ORDER BY {S.md5_order('doc_id')}, doc_id) - 1 AS row FROM corpus""")
def shuffled(spark, sf_dir):
    """The permuted corpus written in its order; a row's place in the files is its place in the permutation."""
    path = scratch_path(spark, "shuffled")
    C.shuffle_rows(X.corpus(spark, sf_dir).select("doc_id"), "doc_id").select(F.col("doc_id").cast("string")).write.text(path)
    return number_rows(with_place(spark.read.text(path))).select(F.col("value").cast("long").alias("doc_id"), "row")
