"""Golden tests for column functions."""

from pyspark.sql import functions as F

from langmix.functions import codes as C
from langmix.functions import text as T
from langmix.operators.coderules import apply_code_rules
from langmix.sources.tables import code_dimension


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_num_tokens_matches_python_split(spark):
    samples = ["a b  c", "", "   ", "x y", "one\ttwo\nthree", "ideo　space", " lead trail "]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", T.num_tokens("s").alias("n")).collect()
    for r in rows:
        assert r["n"] == len(r["s"].split()), r["s"]


def test_special_chars(spark):
    for s, want in [("abc", False), ("a1", True), ("x\\y", True), ("a-b", True), ("é", False), ('q"', True), ("[", True)]:
        assert one(spark, T.has_special_char("s"), s) is want, s


def test_clean_text(spark):
    assert one(spark, T.clean_text("s"), "  Hello, <URL> World!!  \n x ") == "hello world x"
    assert one(spark, T.clean_text("s"), None) == ""


def test_clean_tweet(spark):
    assert one(spark, T.clean_tweet("s"), "@bob  hi   there @al") == "hi there"


def test_label_line_roundtrip(spark):
    df = spark.createDataFrame([("eng", " two\nlines ")], "l string, s string")
    line = df.select(T.label_line("l", "s").alias("v")).first()["v"]
    assert line == "__label__eng two lines"
    lang, sent = T.parse_label_line(F.lit(line))
    r = spark.range(1).select(lang.alias("a"), sent.alias("b")).first()
    assert (r["a"], r["b"]) == ("eng", "two lines")


def test_char_ngrams(spark):
    p = one(spark, T.ngram_text("s"), "Ab  C")
    assert p == " ab c "
    grams = one(spark, T.char_ngrams(F.col("s"), 3), p)
    assert grams == [" ab", "ab ", "b c", " c "]
    assert one(spark, T.char_ngram_count(F.col("s"), 3), p) == 4


def test_tweet_tokens(spark):
    toks = one(spark, T.tweet_tokens("s"), "Hi @Bob! see http://x.co/a :) #tag don't")
    assert toks == ["hi", "@bob", "!", "see", "http://x.co/a", ":)", "#tag", "don't"]


def test_normalise_and_map_pair(spark):
    assert one(spark, C.normalise_pair(F.col("s")), "Spanish–English") == "English-Spanish"
    assert one(spark, C.normalise_pair(F.col("s")), "A-B-C") == "A-B-C"
    assert one(spark, C.map_pair(F.col("s")), "en+es") == "English-Spanish"
    assert one(spark, C.map_pair(F.col("s")), "xx+yy") == "xx+yy"
    assert one(spark, C.rename_pair(F.col("s")), "Chinese-English") == "English-Chinese"


def test_label_list_literal(spark):
    assert one(spark, C.label_list_from_literal(F.col("s")), "['B', 'A']") == ["B", "A"]
    assert one(spark, C.label_string(C.label_list_from_literal(F.col("s"))), "['B', 'A']") == "A-B"


def test_strip_and_prefix(spark):
    assert one(spark, C.strip_script(F.col("s")), "zh-CN") == "zh"
    assert one(spark, C.strip_script(F.col("s")), "eng_Latn") == "eng"
    assert one(spark, C.strip_label_prefix(F.col("s")), "__label__fra_Latn") == "fra_Latn"


def test_code_rules(spark):
    df = spark.createDataFrame([("en",), ("en-US",), ("eng_Latn",), ("xx",), ("zzz",), ("toolong",)], "code string")
    out = {r["code"]: r for r in apply_code_rules(df, code_dimension(spark)).collect()}
    assert out["en"]["iso3_lenient"] == "eng" and out["en"]["iso3_two_letter"] == "eng"
    assert out["en-US"]["iso3_strict"] == "eng" and out["en-US"]["iso3_two_letter"] == "en-US"
    assert out["en-US"]["normalised"] == "eng"
    assert out["xx"]["iso3_strict"] is None and out["xx"]["valid_code"] is False
    assert out["zzz"]["valid_code"] is True and out["toolong"]["valid_code"] is False
    assert out["eng_Latn"]["normalised"] == "eng" and out["eng_Latn"]["malformed"] is False
    assert out["toolong"]["malformed"] is True


def test_topk_and_thresholds(spark):
    df = spark.createDataFrame(
        [([("a", 0.9), ("b", 0.85), ("c", 0.1)],)], "p array<struct<lang:string, prob:double>>"
    )
    r = df.select(
        C.top2_labels("p").alias("t2"),
        C.threshold_labels("p", 0.8).alias("th"),
        C.topk_threshold_labels("p", 1, 0.8).alias("tk"),
    ).first()
    assert r["t2"] == ["a", "b"] and r["th"] == ["a", "b"] and r["tk"] == ["a"]


def test_multi_hot_roundtrip(spark):
    classes = ["A", "B", "C"]
    df = spark.createDataFrame([(["C", "A"],)], "l array<string>")
    bits = df.select(C.multi_hot("l", classes).alias("b")).first()["b"]
    assert bits == [1, 0, 1]
    back = df.select(C.multi_hot_inverse(C.multi_hot("l", classes), classes).alias("x")).first()["x"]
    assert back == ["A", "C"]


def test_invert_last_wins():
    inv = C.invert_last_wins(C.NAME_TO_SCRIPT_CODE)
    assert inv["zho_Hant"] == "Chinese" and "zho_Hans" not in inv
    assert inv["arb_Arab"] == "MSA"


def test_map_pair_codes(spark):
    m = {"English": "eng_Latn", "German": "deu_Latn"}
    assert one(spark, C.map_pair_codes(F.col("s"), m), "English-Dutch") == ["eng_Latn", "unknown"]


def test_tweet_tokens_more(spark):
    toks = one(spark, T.tweet_tokens("s"), "Soooo gooood!!! ;-) #MeToo @a_b https://t.co/x?y=1 well-known 3.5")
    assert toks == ["soooo", "gooood", "!", "!", "!", ";-)", "#metoo", "@a_b", "https://t.co/x?y=1", "well-known",
                    "3", ".", "5"]
    assert one(spark, T.tweet_tokens("s"), "") == []
