"""Rows that earlier versions lost or bent: unseen labels, odd blanks, failing texts, missing folders, missing fields."""

import pytest
from pyspark.sql import functions as F

from langmix.functions import text as T
from langmix.operators import learn as L
from langmix.operators.canon import CS_SPECS, CodeSwitchSpec, canonicalise_cs
from langmix.operators.evaluate import EVAL_SPECS, evaluate
from langmix.operators.udf import pandas_detector
from langmix.operators.vocab import build_vocabulary, text_mean_vectors
from langmix.session import ensure_checkpoint_dir
from langmix.sources import readers as R
from langmix.sources import sinks as K


def test_unseen_and_missing_labels_are_predicted_and_count_as_wrong(spark):
    train = spark.createDataFrame([("red fish", "a"), ("red dog", "a"), ("blue sky", "b"), ("blue sea", "b")], "t string, y string")
    dev = spark.createDataFrame([("red", "a"), ("blue", "zz"), ("red", None), ("blue", "b")], "t string, y string")
    dev = dev.withColumn("i", F.monotonically_increasing_id())
    pred = dev.join(L.fit_word_ngram(train, "t", "y", n=1, buckets=64, max_iter=5).transform(dev, "i", "t"), "i")
    assert pred.count() == 4 and pred.where("pred_lang is null").count() == 0
    assert L.precision_at_1(pred, "y") == 50.0


def test_clean_tweet_stops_at_any_white_space(spark):
    df = spark.createDataFrame([("@you\u00a0hola \u2003 mundo",), ("a @b c",)], "t string")
    assert [r[0] for r in df.select(T.clean_tweet("t")).collect()] == ["hola mundo", "a c"]


def test_blank_lines_with_spaces_and_crlf_part_blocks(spark, tmp_dir):
    for k, body in enumerate(("a\tx\nb\ty\n \t\nc\tx\n\n\nd\ty\n", "a\tx\r\nb\ty\r\n\r\nc\tx\r\n\r\nd\ty\r\n")):
        with open(f"{tmp_dir}/{k}.txt", "w", newline="") as f:
            f.write(body)
        got = [r["lines"] for r in R.read_blank_blocks(spark, f"{tmp_dir}/{k}.txt").orderBy("block").collect()]
        assert got == [["a\tx", "b\ty"], ["c\tx"], ["d\ty"]]


def test_label_text_skips_blank_sentences(spark, tmp_dir):
    rows = [("eng", "ok"), ("eng", "\n"), ("eng", "  \n"), (None, "x"), ("", "x")]
    K.write_label_text(spark.createDataFrame(rows, "language string, sentence string"), f"{tmp_dir}/out")
    assert [r[0] for r in spark.read.text(f"{tmp_dir}/out").collect()] == ["__label__eng ok"]


def test_json_summary_takes_one_row(spark, tmp_dir):
    with pytest.raises(ValueError):
        K.write_json_summary(spark.range(2).toDF("n"), f"{tmp_dir}/s")


def test_category_filter_keeps_missing_categories_and_head_needs_an_order(spark):
    df = spark.createDataFrame([("a", "not-Tamil "), ("b", None), ("c", "Tamil")], "text string, category string")
    assert sorted(r[0] for r in canonicalise_cs(df, CS_SPECS["tamil"]).collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        canonicalise_cs(df, CodeSwitchSpec("x", "text", "l", head=1))


def test_one_failing_text_costs_one_prediction(spark):
    def predict(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [("eng", 1.0)] * len(texts)

    df = spark.createDataFrame([(i, "bad" if i == 7 else "good") for i in range(40)], "id long, t string").coalesce(1)
    got = {r["id"]: r["pred_lang"] for r in pandas_detector(df, "id", "t", predict).collect()}
    assert got.pop(7) is None and set(got.values()) == {"eng"}


def test_mean_vector_reads_the_whole_text(spark):
    df = spark.createDataFrame([(1, "a " * 80 + "b " * 80), (2, "")], "id long, t string")
    vocab = build_vocabulary(df, "t")
    vectors = vocab.select("id", F.when(F.col("token") == "a", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(2.0))).cast("array<float>").alias("embedding"))
    got = {r["id"]: r["mean"] for r in text_mean_vectors(df, "id", "t", vocab, vectors).collect()}
    assert got == {1: [0.5, 1.0], 2: [0.0, 0.0]}


class _Upper:
    """A detector that reports the text it got."""

    def transform(self, df, id_col, text_col, k=3):
        return df.select(id_col, F.upper(text_col).alias("pred_lang"), F.lit(1.0).alias("pred_prob"))


def test_evaluate_cleans_keeps_metadata_and_fills_defaults(spark):
    smol = spark.createDataFrame([(1, " a\nb ", "xx", "doc", 5)], "id long, trg string, tl string, domain string, other int")
    assert evaluate(smol, EVAL_SPECS["smol"], _Upper(), "id").select("gold", "domain", "pred_lang", "data_name").first() == ("xx", "doc", "A B", "smol")
    tweet = spark.createDataFrame([(1, "t", "es", "u")], "id long, tweet string, lang_code string, user string")
    assert set(evaluate(tweet, EVAL_SPECS["tweetlid"], _Upper(), "id").columns) == {"id", "gold", "tweet", "user", "pred_lang", "pred_prob", "data_name"}
    voice = spark.createDataFrame([(1, None, "de", None)], "id long, sentence string, language_code string, up_votes long")
    row = evaluate(voice, EVAL_SPECS["common_voice_stream"], _Upper(), "id").first()
    assert (row["pred_lang"], row["age"], row["accent"], row["up_votes"], row["down_votes"]) == ("", "", "", 0, 0)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
