"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.llm import maxent_lm, quality_gbt, quality_knn
from langmix.llm.common import stored
from langmix.llm.encode import tokenizer_path
from langmix.llm.exact_dedup import exact_dedup
from langmix.llm.lexical_search import ranked_search
from langmix.llm.line_dedup import drop_common_lines
from langmix.llm.mixing import mix, with_tokens
from langmix.llm.near_dedup import NearDuplicates
from langmix.llm.packing import pack
from langmix.llm.spelling import damaged_words, spelling_groups
from langmix.llm.token_count import token_counts
from langmix.llm.token_orc import token_digests, write_token_orc
from langmix.llm.url_rules import judge_urls, rule_table
from langmix.session import scratch_path
from langmix.sources.tables import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_knn.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_BPE), end_id=2, drops_space=True)
    return token_digests(spark, path)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(percent=85).run(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer_path(BYTE_BPE))
    # the text stands for itself by its hash from here on
    docs = stored(docs.select("doc_id", F.xxhash64("text").alias("text"), "source", "n_tokens"), "mix-tokens")
    mixed = mix(docs, tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_tokens", "mix_weight")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path(BYTE_BPE)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=1)


def op10_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gbt.fit(docs, table(spark, sf_dir, "labels"))
    return quality_gbt.judge(docs, model).select("doc_id", *quality_gbt.BASE, "base_failed", "kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(damaged_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=20)


def op13_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, vocabulary = maxent_lm.fit(docs)
    return maxent_lm.score(docs, model, vocabulary)


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_knn, op3_token_orc, op4_url_rules, op5_exact_dedup, op6_near_dedup, op7_mixing, op8_token_count, op9_packing,
    op10_quality_gbt, op11_spelling, op12_lexical_search, op13_maxent_lm)}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line, trim(keys[pos], {_BLANKS}) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, string_split({_NORM}, chr(10)) AS keys,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY doc_id""",
    "op4_url_rules": r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
met AS (
  SELECT page_id, host, path, h || q AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM met WHERE k = 1""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
        ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id),
roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN roots ON id = doc_id""",
    "op11_spelling": rf"""
WITH RECURSIVE
-- crc32 by its 256 remainders
steps(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
                   SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS r FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_NORM}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, n, list_transform(range(1, CAST(octet_length(encode(doc_id || ':' || run)) AS BIGINT) + 1),
                 lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i - 1, 2) AS BIGINT)) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, r[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) AS a, substr(word, CAST(i AS INT) + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
         UNION SELECT x.word, y.word, y.n FROM gaps x JOIN w y ON x.a || x.z = y.word
         UNION SELECT y.word, x.word, x.n FROM gaps x JOIN w y ON x.a || x.z = y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
          FROM w LEFT JOIN best USING (word)),
walk(word, step) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.step WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.step AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.step AND e.form IS NULL""",
    "op12_lexical_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // len) AS m FROM d, s),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, count(*) * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), s GROUP BY item_id, term, docs, df),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM w JOIN c USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
}
