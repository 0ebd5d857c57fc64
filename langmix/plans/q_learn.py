"""Query keys 29-30: classifiers trained in passes over blocks of rows. A fit is defined by its steps, so SQL takes the
same steps over (row, feature) tables; the adapter's key returns properties that hold whatever the weights are."""

from __future__ import annotations

from pyspark.sql import functions as F

from langmix.functions.text import TWEET_TOKEN_PATTERN
from langmix.operators import learn as L
from langmix.operators.vocab import build_vocabulary
from langmix.plans import fixtures as X
from langmix.plans import sql as S
from langmix.plans.catalog import register
from langmix.plans.q_detect import SPLIT_SQL, split_corpus
from langmix.plans.q_pairs import CS_SQL, cs_corpus_df
from langmix.session import fleeting, stored
from langmix.sources.tables import table

NGRAMS, STEPS, BUCKETS = 2, 8, L.DEFAULT_BUCKETS
GRID = [{"n": n, "reg": reg, "max_iter": 20} for n in (1, 2) for reg in (0.0, 0.01)]
STOP_BLOCK, STOP_TOTAL = 3, 12
THRESHOLD = 0.8

# ---------------------------------------------------------------- SQL side


def features_sql(name: str, rows: str, id_col: str, tokens: str, n: int = 1) -> str:
    """(id, f, v): hashed grams by their share of the row's grams, the constant gram among them."""
    longer = "".join(f" UNION ALL SELECT id, array_to_string(t[i:i + {k - 1}], ' ') FROM (SELECT id, t, unnest(range(1, len(t) - {k - 2})) AS i FROM {name}_t)" for k in range(2, n + 1))
    return f"""{name}_t AS MATERIALIZED (SELECT {id_col} AS id, {tokens} AS t FROM {rows}),
{name}_x AS MATERIALIZED (SELECT id, f, sum(v) AS v FROM (
  SELECT id, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % {BUCKETS} AS f, 1.0 / count(*) OVER (PARTITION BY id) AS v
  FROM (SELECT id, chr(10) AS g FROM {name}_t UNION ALL SELECT id, unnest(t) FROM {name}_t{longer})) GROUP BY id, f)"""


def _prob(source: str, kind: str) -> str:
    if kind == "sigmoid":
        return f"SELECT *, 1 / (1 + exp(-s)) AS p FROM {source}"
    return f"""SELECT id, cfg, label, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY id, cfg) AS p
  FROM (SELECT *, max(s) OVER (PARTITION BY id, cfg) AS mx FROM {source})"""


def fit_sql(name: str, x: str, labels: str, y: str, kind: str, steps: int, regs=(0.0,)) -> str:
    """``{name}_w0 ... {name}_w<steps>``: weights (f, cfg, label, w) after each pass. ``labels``: a relation (label);
    ``y``: a relation (id, label) of what is true."""
    step = L.STEPS[kind]
    reg = ", ".join(f"({i}, CAST({r} AS DOUBLE))" for i, r in enumerate(regs))
    out = [f"""{name}_m AS MATERIALIZED (SELECT f, sum(v) AS m FROM {x} GROUP BY f),
{name}_w0 AS MATERIALIZED (SELECT f, m, cfg, reg, label, CAST(0 AS DOUBLE) AS w FROM {name}_m, (VALUES {reg}) AS r(cfg, reg), {labels})"""]
    for t in range(steps):
        out.append(f"""{name}_s{t} AS (SELECT id, cfg, label, sum(v * w) AS s FROM {x} JOIN {name}_w{t} USING (f) GROUP BY id, cfg, label),
{name}_p{t} AS MATERIALIZED (SELECT p.id, p.cfg, p.label, p - CASE WHEN y.id IS NULL THEN 0 ELSE 1 END AS r
  FROM ({_prob(f'{name}_s{t}', kind)}) p LEFT JOIN {y} y ON y.id = p.id AND y.label = p.label),
{name}_g{t} AS (SELECT f, cfg, label, sum(v * r) AS g FROM {x} JOIN {name}_p{t} USING (id) GROUP BY f, cfg, label),
{name}_w{t + 1} AS MATERIALIZED (SELECT f, m, cfg, reg, label, w - {step} * (g / m + reg * w) AS w FROM {name}_w{t} JOIN {name}_g{t} USING (f, cfg, label))""")
    return ",\n".join(out)


def predict_sql(name: str, x: str, weights: str, kind: str) -> str:
    """(id, cfg, label, p, r): classes of every row with their rank."""
    return f"""{name}_s AS (SELECT id, cfg, label, sum(v * w) AS s FROM {x} JOIN {weights} USING (f) GROUP BY id, cfg, label),
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id, cfg ORDER BY p DESC, label) AS r FROM ({_prob(f'{name}_s', kind)}))"""


_WORDS = "regexp_extract_all(lower(sentence), '\\S+')"
_LABELS = "labels_of AS (SELECT DISTINCT language AS label FROM train), gold AS (SELECT doc_id AS id, language AS label FROM train)"


def _words_sql(n: int, tag: str = "") -> str:
    return ",\n".join([features_sql(f"tr{tag}", "train", "doc_id", _WORDS, n), features_sql(f"dv{tag}", "dev", "doc_id", _WORDS, n)])


def _classifier_sql() -> str:
    return S.base(SPLIT_SQL, _LABELS, _words_sql(NGRAMS), fit_sql("k", "tr_x", "labels_of", "gold", "softmax", STEPS), predict_sql("pr", "dv_x", f"k_w{STEPS}", "softmax")) + """
SELECT d.doc_id, d.language AS gold, max(label) FILTER (WHERE r = 1) AS pred_lang, round(max(p) FILTER (WHERE r = 1), 6) AS pred_prob,
  max(label) FILTER (WHERE r = 2) AS lang2, round(max(p) FILTER (WHERE r = 2), 6) AS prob2, max(label) FILTER (WHERE r = 3) AS lang3, round(max(p) FILTER (WHERE r = 3), 6) AS prob3
FROM dev d JOIN pr ON pr.id = d.doc_id GROUP BY d.doc_id, d.language"""


_RIGHT = "avg(CAST(label = language AS DOUBLE)) * 100"


def _grid_sql() -> str:
    ctes, out = [], []
    for n in sorted({c["n"] for c in GRID}):
        own = [c for c in GRID if c["n"] == n]
        steps = own[0]["max_iter"]
        ctes += [_words_sql(n, str(n)), fit_sql(f"k{n}", f"tr{n}_x", "labels_of", "gold", "softmax", steps, [c["reg"] for c in own]),
                 predict_sql(f"pr{n}", f"dv{n}_x", f"k{n}_w{steps}", "softmax")]
        for i, c in enumerate(own):
            out.append(f"""SELECT {n} AS ngrams, CAST({c['reg']} AS DOUBLE) AS reg_param, {steps} AS max_iter,
  round((SELECT {_RIGHT} FROM pr{n} JOIN dev ON id = doc_id WHERE r = 1 AND cfg = {i}), 4) AS dev_accuracy""")
    return S.base(SPLIT_SQL, _LABELS, *ctes) + " UNION ALL ".join(out)


def _stop_sql() -> str:
    at = list(range(STOP_BLOCK, STOP_TOTAL + 1, STOP_BLOCK))
    preds = [predict_sql(f"pr{t}", "dv_x", f"k_w{t}", "softmax") for t in at]
    accs = " UNION ALL ".join(f"SELECT {t} AS max_iter, (SELECT {_RIGHT} FROM pr{t} JOIN dev ON id = doc_id WHERE r = 1) AS acc" for t in at)
    return S.base(SPLIT_SQL, _LABELS, _words_sql(NGRAMS), fit_sql("k", "tr_x", "labels_of", "gold", "softmax", STOP_TOTAL), *preds, f"accs AS ({accs})",
                  "better AS (SELECT *, acc > coalesce(max(acc) OVER (ORDER BY max_iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS improved FROM accs)") + """
SELECT max_iter, round(acc, 4) AS dev_accuracy, improved FROM better
WHERE max_iter <= coalesce((SELECT min(max_iter) FROM better WHERE NOT improved), max_iter)"""


_TWEET = f"regexp_extract_all(lower(codeswitch_sentence), '{TWEET_TOKEN_PATTERN.replace(chr(39), chr(39) * 2)}')"
_CS_LABELS = """tr AS (SELECT * FROM cs WHERE split = 'train'), te AS (SELECT * FROM cs WHERE split = 'test'),
gold AS (SELECT DISTINCT pair_id AS id, unnest(string_split(languages, '-')) AS label FROM tr), labels_of AS (SELECT DISTINCT label FROM gold)"""
_LINEAR_SQL = CS_SQL + ", " + ",\n".join([
    _CS_LABELS, features_sql("tr", "tr", "pair_id", _TWEET), features_sql("te", "te", "pair_id", _TWEET),
    fit_sql("k", "tr_x", "labels_of", "gold", "sigmoid", STEPS), predict_sql("pr", "te_x", f"k_w{STEPS}", "sigmoid")]) + f"""
SELECT pair_id, languages, coalesce((SELECT string_agg(label, '-' ORDER BY label) FROM pr WHERE pr.id = pair_id AND p >= {THRESHOLD}), '') AS predicted FROM te"""

# ---------------------------------------------------------------- Spark side


def _train_dev(spark, sf_dir):
    sp = split_corpus(spark, sf_dir)
    train = X.spread(sp.filter(F.col("split") == "train"), "doc_id")
    dev = X.spread(sp.filter(F.col("split") == "dev"), "doc_id")
    return train, dev


@register("word_ngram_classifier", _classifier_sql())
def word_ngram_classifier(spark, sf_dir):
    """M3, M4: the three best labels of every dev document."""
    train, dev = _train_dev(spark, sf_dir)
    model = L.fit_word_ngram(train, "sentence", "language", n=NGRAMS, max_iter=STEPS)
    pred = model.transform(dev, "doc_id", "sentence")
    more = [c for i in (1, 2) for c in (F.try_element_at("top_preds", F.lit(i + 1))["lang"].alias(f"lang{i + 1}"),
                                        F.round(F.try_element_at("top_preds", F.lit(i + 1))["prob"], 6).alias(f"prob{i + 1}"))]
    return dev.select("doc_id", F.col("language").alias("gold")).join(pred, "doc_id").select(
        "doc_id", "gold", "pred_lang", F.round("pred_prob", 6).alias("pred_prob"), *more)


@register("grid_sweep", _grid_sql())
def grid_sweep(spark, sf_dir):
    train, dev = _train_dev(spark, sf_dir)
    rows = L.grid_sweep(train, dev, "sentence", "language", GRID)
    return spark.createDataFrame(
        [(r["n"], float(r["reg"]), r["max_iter"], float(r["dev_accuracy"])) for r in rows],
        "ngrams int, reg_param double, max_iter int, dev_accuracy double",
    )


@register("early_stop", _stop_sql())
def early_stop(spark, sf_dir):
    train, dev = _train_dev(spark, sf_dir)
    _, log = L.fit_with_early_stop(train, dev, "sentence", "language", n=NGRAMS, block=STOP_BLOCK, total=STOP_TOTAL)
    return spark.createDataFrame(
        [(r["max_iter"], float(r["dev_accuracy"]), r["improved"]) for r in log],
        "max_iter int, dev_accuracy double, improved boolean",
    )


def _cs_sets(spark, sf_dir, kept=False):
    cs = cs_corpus_df(spark, sf_dir)
    if kept:  # pairs are put together once, however many passes read their texts
        cs = stored(cs.select("pair_id", "codeswitch_sentence", "languages", "split"), "cs-texts")
    cs = cs.withColumn("labels", F.split("languages", "-"))
    train, test = cs.filter(F.col("split") == "train"), cs.filter(F.col("split") == "test")
    return cs, train, test, L.classes_of(train, F.col("labels"))


@register("multilabel_linear", _LINEAR_SQL)
def multilabel_linear(spark, sf_dir):
    """M7, M9 with F21."""
    _, train, test, classes = _cs_sets(spark, sf_dir)
    model = L.fit_multilabel(train, "codeswitch_sentence", "labels", classes, max_iter=STEPS)
    pred = L.predict_multilabel(model, test, "pair_id", "codeswitch_sentence", THRESHOLD)
    return test.select("pair_id", "languages").join(pred, "pair_id").select("pair_id", "languages", F.array_join("predicted", "-").alias("predicted"))


def _adapter(spark, sf_dir):
    with fleeting(spark):  # each step is stored, so what was moved for it may go
        return _adapter_steps(spark, sf_dir)


def _adapter_steps(spark, sf_dir):
    _, train, test, classes = _cs_sets(spark, sf_dir, kept=True)
    vocab = build_vocabulary(train, "codeswitch_sentence")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(vocab.select("id"), "id", "left_semi")
    known = lambda df, *more: L.known_tokens(df, "pair_id", "codeswitch_sentence", vocab, vectors, *more)
    model, losses = L.fit_adapter(known(train, "labels"), "labels", classes, vectors, max_iter=5)
    held = stored(known(test, "languages"), "known-tokens")  # read by both sides of the prediction
    pred = L.predict_adapter(model, held, "pair_id", vectors, THRESHOLD, 2)
    return held.select("pair_id", "languages", "known").join(pred, "pair_id"), classes, losses


@register("multilabel_embedding_labels")
def multilabel_embedding_labels(spark, sf_dir):
    """M8, M9 with F22: the labels themselves (rows only: the weights start from drawn numbers)."""
    pred, _, _ = _adapter(spark, sf_dir)
    return pred.select("pair_id", "languages", F.array_join("predicted", "-").alias("predicted"))


@register("multilabel_embedding", CS_SQL + ", " + ",\n".join([
    "tr AS (SELECT * FROM cs WHERE split = 'train')", f"tok AS (SELECT unnest({_TWEET}) AS token FROM tr)",
    "vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM tok GROUP BY token)",
    "have AS (SELECT token FROM vocab WHERE id IN (SELECT vec_id FROM embeddings))",
    f"te AS (SELECT pair_id, languages, {_TWEET} AS t FROM cs WHERE split = 'test')",
    "met AS (SELECT pair_id, count(*) AS known FROM (SELECT pair_id, unnest(t) AS token FROM te) JOIN have USING (token) GROUP BY pair_id)"])
    + " SELECT pair_id, languages, coalesce(known, 0) AS known, true AS ranked, true AS chosen, true AS loss_fell FROM te LEFT JOIN met USING (pair_id)")
def multilabel_embedding(spark, sf_dir):
    """M8: of every test row how many tokens have a vector, whether all classes are ranked by falling probability,
    whether the labels chosen are those of the two best that reach the threshold, and whether each step lowered the
    loss."""
    pred, classes, losses = _adapter(spark, sf_dir)
    probs = F.transform("preds", lambda p: p["prob"])
    ranked = (F.size("preds") == len(classes)) & (F.reverse(F.array_sort(probs)) == probs) & (F.array_min(probs) >= 0) & (F.array_max(probs) <= 1)
    best = F.array_sort(F.transform(F.filter(F.slice("preds", 1, 2), lambda p: p["prob"] >= THRESHOLD), lambda p: p["lang"]))
    fell = all(b < a for a, b in zip(losses, losses[1:]))
    return pred.select("pair_id", "languages", F.col("known").cast("long").alias("known"), ranked.alias("ranked"), (F.col("predicted") == best).alias("chosen"), F.lit(fell).alias("loss_fell"))
