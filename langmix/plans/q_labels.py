"""Query keys 20, 25-28: text cleaning, label-set metrics, vocabulary and
encoding, multi-hot labels and mean embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.functions.codes import map_literal, multi_hot
from langmix.operators import codeswitch as CS
from langmix.operators.detect import detect_all, fit_char_ngram_multi
from langmix.operators.vocab import build_vocabulary, encode_padded, text_mean_vectors
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import register
from langmix.plans.q_detect import SPLIT_SQL, SYSTEMS, detector_ctes, split_corpus
from langmix.plans.q_pairs import _CS_KEPT, CS_SQL, cs_corpus_df, cs_kept
from langmix.sources.tables import DOC_LANG_CODES, LANG_NAMES, table

MAX_LEN = 50

# ---------------------------------------------------------------- 20 cleaning


@register(
    "clean_text",
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
    lower(replace(COALESCE(text, ''), '<URL>', '')), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g'),
  '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents""",
)
def clean_text(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", T.clean_text("text").alias("cleaned"))


@register(
    "clean_tweet",
    """SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '@[^\\s\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+', '', 'g'),
  '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS cleaned FROM conversations""",
)
def clean_tweet(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_tweet("text").alias("cleaned"))


# ---------------------------------------------------------------- 25 label sets

ISO3_TO_NAME = {iso3: dict(LANG_NAMES)[iso1] for iso1, iso3 in DOC_LANG_CODES}


def cs_test(spark, sf_dir) -> DataFrame:
    """Code-switch test split (before the per-label minimum, which the fixture
    scale would empty; P11 itself is covered by ``cs_min_count``)."""
    return cs_corpus_df(spark, sf_dir).filter(F.col("split") == "test")


def labelset_scored(spark, sf_dir) -> DataFrame:
    """Each system's top-2 languages of every code-switch test sentence, mapped
    to names (J12, unmapped dropped), sorted and '-'-joined (F14, F9)."""
    sp = split_corpus(spark, sf_dir)
    train = X.spread(sp.filter(F.col("split") == "train"), "doc_id")
    test = X.spread(cs_test(spark, sf_dir), "pair_id").checkpoint()
    names = map_literal(ISO3_TO_NAME)
    models = fit_char_ngram_multi(train, "sentence", "language", SYSTEMS)
    pred = detect_all(models, test, "pair_id", "codeswitch_sentence")
    mapped = F.filter(F.transform(F.slice("top_preds", 1, 2), lambda x: F.try_element_at(names, x["lang"])), lambda x: x.isNotNull())
    out = pred.select("pair_id", F.array_join(F.array_sort(mapped), "-").alias("predicted_label"), F.concat(F.lit("char"), F.col("n").cast("string")).alias("system"))
    return test.select("pair_id", F.col("languages").alias("true_label")).join(out, "pair_id")


def _labelset_sql() -> str:
    ctes = ["cs_test AS (SELECT * FROM cs WHERE split = 'test')",
            f"lname AS (SELECT * FROM {S.values(list(ISO3_TO_NAME.items()), 'iso_3, name')})", SPLIT_SQL]
    unions = []
    for n in SYSTEMS:
        ctes += detector_ctes(n, "train", "language", "cs_test", "pair_id", "codeswitch_sentence", f"cd{n}")
        ctes.append(
            f"""pl{n} AS (SELECT id, string_agg(name, '-' ORDER BY name) AS pl
  FROM cd{n} JOIN lname ON cd{n}.lang = lname.iso_3 WHERE r <= 2 GROUP BY id)"""
        )
        unions.append(
            f"""SELECT 'char{n}' AS system, t.pair_id, t.languages AS true_label, COALESCE(p.pl, '') AS predicted_label
  FROM cs_test t LEFT JOIN pl{n} p ON p.id = t.pair_id"""
        )
    ctes.append("scored AS (" + " UNION ALL ".join(unions) + ")")
    return CS_SQL + ", " + ",\n".join(ctes) + "\n"


LABELSET_SQL = _labelset_sql()


def _metric(spark, sf_dir, name):
    return CS.label_set_metrics(labelset_scored(spark, sf_dir))[name]


@register(
    "labelset_fpr",
    LABELSET_SQL
    + """, g AS (SELECT DISTINCT system, true_label AS label FROM scored),
c AS (SELECT g.system, g.label,
    (SELECT count(*) FROM scored s WHERE s.system = g.system AND s.true_label <> g.label AND s.predicted_label = g.label) AS fp,
    (SELECT count(*) FROM scored s WHERE s.system = g.system AND s.true_label <> g.label AND s.predicted_label <> g.label) AS tn
  FROM g)
SELECT system, label, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS fpr FROM c""",
)
def labelset_fpr(spark, sf_dir):
    return _metric(spark, sf_dir, "fpr")


@register(
    "labelset_full_match",
    LABELSET_SQL
    + """SELECT system, true_label AS label, round(avg(CAST(true_label = predicted_label AS DOUBLE)), 6) AS full_match
FROM scored GROUP BY system, true_label""",
)
def labelset_full_match(spark, sf_dir):
    return _metric(spark, sf_dir, "full_match")


_SETS = """sets AS (SELECT system, true_label, list_distinct(string_split(true_label, '-')) AS gs,
    list_distinct(string_split(predicted_label, '-')) AS ps FROM scored)"""


@register(
    "labelset_partial_iou",
    LABELSET_SQL
    + ", "
    + _SETS
    + """, ov AS (SELECT system, true_label, len(list_intersect(gs, ps)) AS i,
    len(list_distinct(list_concat(gs, ps))) AS u, len(gs) AS lg, len(ps) AS lp FROM sets)
SELECT system, true_label AS label, round(avg(i / u), 6) AS partial_iou FROM ov
WHERE NOT (i = lg AND i = lp) AND i > 0 GROUP BY system, true_label""",
)
def labelset_partial_iou(spark, sf_dir):
    return _metric(spark, sf_dir, "partial_iou")


@register(
    "labelset_top_language",
    LABELSET_SQL
    + """, d AS (SELECT system, true_label, string_split(true_label, '-') AS gl, string_split(predicted_label, '-') AS pl
  FROM scored WHERE list_sort(string_split(true_label, '-')) <> list_sort(string_split(predicted_label, '-'))),
hits AS (SELECT system, true_label, lang, count(*) AS n FROM (
    SELECT system, true_label, unnest(gl) AS lang, pl FROM d) WHERE list_contains(pl, lang) GROUP BY 1, 2, 3)
SELECT system, label, top_language FROM (
  SELECT system, true_label AS label, lang AS top_language,
    row_number() OVER (PARTITION BY system, true_label ORDER BY n DESC, lang) AS r FROM hits) WHERE r = 1""",
)
def labelset_top_language(spark, sf_dir):
    return _metric(spark, sf_dir, "top_language")


@register(
    "labelset_compare",
    LABELSET_SQL
    + """, fm AS (SELECT system, true_label AS label, round(avg(CAST(true_label = predicted_label AS DOUBLE)), 6) AS v
  FROM scored GROUP BY system, true_label)
SELECT label, max(CASE WHEN system = 'char1' THEN v END) AS char1, max(CASE WHEN system = 'char2' THEN v END) AS char2,
  max(CASE WHEN system = 'char3' THEN v END) AS char3 FROM fm GROUP BY label""",
)
def labelset_compare(spark, sf_dir):
    return CS.compare_systems(_metric(spark, sf_dir, "full_match"), "full_match",
                              systems=[f"char{n}" for n in SYSTEMS])


# ---------------------------------------------------------------- 26 vocabulary / encoding

def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '" + T.TWEET_TOKEN_PATTERN.replace("'", "''") + "', 0)"


def cs_train_test(spark, sf_dir):
    kept = cs_kept(spark, sf_dir).checkpoint()
    return kept.filter(F.col("split") == "train"), kept


def vocabulary_df(spark, sf_dir) -> DataFrame:
    train, _ = cs_train_test(spark, sf_dir)
    return build_vocabulary(train, "codeswitch_sentence")


_VOCAB_SQL = (
    CS_SQL
    + ", "
    + _CS_KEPT
    + f""", toks AS (SELECT pair_id, split, {_tok('codeswitch_sentence')} AS t FROM kept),
cnt AS (SELECT tok AS token, count(*) AS cnt FROM (SELECT unnest(t) AS tok FROM toks WHERE split = 'train') GROUP BY tok),
vocab AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) + 1 AS id FROM cnt)
"""
)


@register("vocabulary", _VOCAB_SQL + "SELECT token, CAST(cnt AS BIGINT) AS cnt, CAST(id AS BIGINT) AS id FROM vocab")
def vocabulary(spark, sf_dir):
    return vocabulary_df(spark, sf_dir).select("token", "cnt", "id")


_ENC_SQL = (
    _VOCAB_SQL
    + f""", pos AS (SELECT pair_id, unnest(t[1:{MAX_LEN}]) AS tok, generate_subscripts(t[1:{MAX_LEN}], 1) AS i FROM toks),
ids AS (SELECT pos.pair_id, pos.i, COALESCE(v.id, 1) AS id FROM pos LEFT JOIN vocab v ON pos.tok = v.token),
enc AS (SELECT k.pair_id, list(COALESCE(ids.id, 0) ORDER BY ids.i) FILTER (WHERE ids.i IS NOT NULL) AS l
  FROM kept k LEFT JOIN ids ON k.pair_id = ids.pair_id GROUP BY k.pair_id)
"""
)


@register(
    "encode_padded",
    _ENC_SQL
    + f"""SELECT pair_id, array_to_string(list_concat(COALESCE(l, []), list_transform(range({MAX_LEN} - len(COALESCE(l, []))),
  lambda x: 0)), ' ') AS encoded FROM enc""",
)
def encode_padded_q(spark, sf_dir):
    train, everything = cs_train_test(spark, sf_dir)
    vocab = build_vocabulary(train, "codeswitch_sentence")
    enc = encode_padded(everything, "pair_id", "codeswitch_sentence", vocab, MAX_LEN)
    return enc.select("pair_id", F.array_join("ids", " ").alias("encoded"))


# ---------------------------------------------------------------- 27 multi-hot


@register(
    "multi_hot_labels",
    CS_SQL
    + ", "
    + _CS_KEPT
    + """, cls AS (SELECT list_sort(list(DISTINCT x)) AS classes FROM (SELECT unnest(string_split(languages, '-')) AS x
  FROM kept WHERE split = 'train'))
SELECT pair_id, languages, array_to_string(list_transform(classes,
  lambda c: CASE WHEN list_contains(string_split(languages, '-'), c) THEN '1' ELSE '0' END), '') AS multi_hot
FROM kept, cls""",
)
def multi_hot_labels(spark, sf_dir):
    kept = cs_kept(spark, sf_dir).checkpoint()
    labels = F.split("languages", "-")
    classes_df = kept.filter(F.col("split") == "train").select(F.explode(labels).alias("c")).distinct()
    # the class list of a multi-label model is a small dimension (one per language)
    classes = sorted(r["c"] for r in classes_df.collect())
    return kept.select("pair_id", "languages", F.array_join(multi_hot(labels, classes).cast("array<string>"), "").alias("multi_hot"))


@register(
    "doc_label_sets",
    S.base()
    + """, sets AS (
  SELECT c.doc_id, list_sort(list_filter([c.language, CASE WHEN l.quality = 1 THEN 'quality' END,
      CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS labels
  FROM corpus c JOIN labels l ON c.doc_id = l.doc_id),
cls AS (SELECT list_sort(list(DISTINCT x)) AS classes FROM (SELECT unnest(labels) AS x FROM sets))
SELECT doc_id, array_to_string(labels, '-') AS label_set, CAST(len(labels) AS BIGINT) AS n_labels,
  array_to_string(list_transform(classes, lambda c: CASE WHEN list_contains(labels, c) THEN '1' ELSE '0' END), '')
    AS multi_hot
FROM sets, cls""",
)
def doc_label_sets(spark, sf_dir):
    """F20 on the ``labels`` table: each labelled document's set is its language
    plus ``quality`` / ``toxic`` when flagged; multi-hot over the sorted classes."""
    lab = table(spark, sf_dir, "labels")
    sets = X.corpus(spark, sf_dir).join(lab, "doc_id").select(
        "doc_id",
        F.array_sort(F.filter(F.array(
            F.col("language"),
            F.when(F.col("quality") == 1, F.lit("quality")),
            F.when(F.col("toxic") == 1, F.lit("toxic")),
        ), lambda x: x.isNotNull())).alias("labels"),
    ).checkpoint()
    # the class list is a small dimension: languages plus two flags
    classes = sorted(r["c"] for r in sets.select(F.explode("labels").alias("c")).distinct().collect())
    return sets.select(
        "doc_id",
        F.array_join("labels", "-").alias("label_set"),
        F.size("labels").cast("long").alias("n_labels"),
        F.array_join(multi_hot("labels", classes).cast("array<string>"), "").alias("multi_hot"),
    )


# ---------------------------------------------------------------- 28 mean embeddings


@register(
    "mean_embedding",
    """SELECT label, i - 1 AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean_value FROM (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i""",
)
def mean_embedding(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    ex = emb.select("label", F.posexplode("embedding").alias("dim", "v"))
    return ex.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(
        F.round(F.avg(F.col("v").cast("double")), 6).alias("mean_value")
    )


@register(
    "doc_mean_embedding",
    _VOCAB_SQL
    + """, ids AS (SELECT pos.pair_id, COALESCE(v.id, 1) AS id FROM (SELECT pair_id, unnest(t) AS tok FROM toks) pos
  LEFT JOIN vocab v ON pos.tok = v.token),
hit AS (SELECT ids.pair_id, e.embedding FROM ids JOIN embeddings e ON e.vec_id = ids.id WHERE ids.id >= 2),
nreal AS (SELECT pair_id, count(*) AS n FROM ids GROUP BY pair_id),
dims AS (SELECT pair_id, i - 1 AS dim, sum(CAST(v AS DOUBLE)) AS s FROM (
  SELECT pair_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM hit) GROUP BY pair_id, i),
alld AS (SELECT k.pair_id, r.dim FROM kept k,
  (SELECT unnest(range(CAST((SELECT max(len(embedding)) FROM embeddings) AS BIGINT))) AS dim) r)
SELECT a.pair_id, CAST(a.dim AS BIGINT) AS dim, round(COALESCE(d.s, 0) / greatest(COALESCE(n.n, 0), 1), 6) AS value
FROM alld a LEFT JOIN dims d ON a.pair_id = d.pair_id AND a.dim = d.dim LEFT JOIN nreal n ON a.pair_id = n.pair_id""",
)
def doc_mean_embedding(spark, sf_dir):
    train, everything = cs_train_test(spark, sf_dir)
    vocab = build_vocabulary(train, "codeswitch_sentence")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    means = text_mean_vectors(everything, "pair_id", "codeswitch_sentence", vocab, vectors)
    return means.select("pair_id", F.posexplode("mean").alias("dim", "value")).select(
        "pair_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )
