"""One golden row set per source spec kind."""

from langmix.operators.canon import CS_SPECS, SOURCE_SPECS, CodeSwitchSpec, canonicalise, canonicalise_cs
from langmix.sources.tables import code_dimension


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_strict_prefix_with_rejects(spark):
    df = spark.createDataFrame([("hello", "en-US"), ("hallo", "de-DE"), ("x", "zz-ZZ")], "transcription string, lang_code string")
    out, rej = canonicalise(df, SOURCE_SPECS["minds14"], code_dimension(spark))
    assert rows(out) == [("hallo", "de-DE", "deu", "minds14"), ("hello", "en-US", "eng", "minds14")]
    assert [r["__code"] for r in rej.collect()] == ["zz-ZZ"]


def test_zipped_arrays(spark):
    df = spark.createDataFrame([(["en", "fr-CA"], ["hi", "salut"])], "language array<string>, translation array<string>")
    out, _ = canonicalise(df, SOURCE_SPECS["ted_multi"], code_dimension(spark))
    assert rows(out) == [("hi", "en", "eng", "ted_multi"), ("salut", "fr-CA", "fra", "ted_multi")]


def test_map_lookup(spark):
    df = spark.createDataFrame([({"es_XX": "hola", "en_XX": "hi"}, "es_XX")], "translation map<string,string>, lang_code string")
    out, _ = canonicalise(df, SOURCE_SPECS["ccaligned"], code_dimension(spark))
    assert rows(out) == [("hola", "es_XX", "spa", "ccaligned")]


def test_prefix_literal_identity(spark):
    df = spark.createDataFrame([(" a ", "eng_Latn", "wiki"), ("", "fra_Latn", "wiki")], "text string, language string, source string")
    out, _ = canonicalise(df, SOURCE_SPECS["openlid"], code_dimension(spark))
    assert rows(out) == [("a", "eng_Latn", "eng", "openlid_wiki")]
    yt = spark.createDataFrame([(" x ",), ("  ",)], "transcript_whisper string")
    out, _ = canonicalise(yt, SOURCE_SPECS["cantonese_youtube"], code_dimension(spark))
    assert rows(out) == [("x", "cantonese", "yue", "cantonese_youtube")]
    b = spark.createDataFrame([("t", "sw")], "text string, lang_code string")
    assert rows(canonicalise(b, SOURCE_SPECS["bloom"], code_dimension(spark))[0]) == [("t", "sw", "sw", "bloom")]


def test_single_language_labels(spark):
    df = spark.createDataFrame([("a", "es"), ("b", "en+es"), ("c", "ca/es")], "text string, language string")
    out, _ = canonicalise(df, SOURCE_SPECS["tweetlid"], code_dimension(spark))
    assert rows(out) == [("a", "es", "spa", "tweetlid")]


def test_code_switch_specs(spark):
    mal = spark.createDataFrame([(1, "x", "Mixed"), (2, "y", " not-malayalam "), (3, "x", "Mixed")],
                                "ordinal int, text string, category string")
    assert rows(canonicalise_cs(mal, CS_SPECS["malayalam"])) == [("x", "Malayalam–English", "Dravidian-CodeMix")]
    hinge = spark.createDataFrame([(["r1", "r2"],)], "references array<string>")
    assert len(rows(canonicalise_cs(hinge, CS_SPECS["hinge"]))) == 2
    asc = spark.createDataFrame([("a", "mixed"), ("b", "en")], "transcription string, language string")
    assert rows(canonicalise_cs(asc, CS_SPECS["ascend"])) == [("a", "English-Chinese", "ASCEND")]
    ind = spark.createDataFrame([("@u  hai   you ",)], "raw_tweet string")
    assert rows(canonicalise_cs(ind, CS_SPECS["indonesian"])) == [("hai you", "Indonesian-English", "barik-etal-2019-normalization")]
    tw = spark.createDataFrame([("s", "en+es")], "codeswitch_sentence string, languages string")
    assert rows(canonicalise_cs(tw, CS_SPECS["tweetlid_pairs"])) == [("s", "en+es", "Tweetlid")]
    head = CodeSwitchSpec("T", "text", "German-English", head=2)
    ts = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "ordinal int, text string")
    assert rows(canonicalise_cs(ts, head)) == [("a", "German-English", "T"), ("b", "German-English", "T")]
