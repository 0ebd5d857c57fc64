"""Golden tests for readers and sinks on temporary files."""

import json
import os

from pyspark.sql import functions as F

from langmix.sources import readers as R
from langmix.sources import sinks as K


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_label_text(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "l.txt"), "__label__eng hello world\n\nnot a label\n__label__fra\n__label__deu a  b \n")
    rows = sorted(tuple(r) for r in R.read_label_text(spark, p).collect())
    assert rows == [("deu", "a  b"), ("eng", "hello world")]


def test_write_label_text_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("eng", "x\ny"), ("fra", "  "), ("", "z")], "language string, sentence string")
    out = os.path.join(tmp_dir, "k3")
    K.write_label_text(df, out)
    assert [tuple(r) for r in R.read_label_text(spark, out).collect()] == [("eng", "x y")]


def test_meta_blocks(spark, tmp_dir):
    text = "meta\t1\tx\nhola\tlang1\nhi\tlang2\n\nmeta\t2\nok\tlang2\n"
    p = write(os.path.join(tmp_dir, "m.conll"), text)
    rows = [r["codeswitch_sentence"] for r in R.read_meta_blocks(spark, p, "Spanish-English", "s").collect()]
    assert sorted(rows) == sorted(["hola hi ", "ok "])


def test_tagged_blocks(spark, tmp_dir):
    text = "w1\tAR\nw2\tEN\n\nx1\tAR\nbad\nx2\tAR\n\ny\tEN\n"
    p = write(os.path.join(tmp_dir, "t.txt"), text)
    kept, malformed = R.read_tagged_blocks(spark, p, ["AR", "EN"])
    assert [r["codeswitch_sentence"] for r in kept.collect()] == ["w1 w2"]
    assert malformed.first()["malformed_lines"] == 1


def test_blank_blocks(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "b.txt"), " a \nb\n\nc\n\n\n")
    rows = [r["lines"] for r in R.read_blank_blocks(spark, p).orderBy("block").collect()]
    assert rows == [["a", "b"], ["c"]]


def test_tweet_pairs_and_records(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "tw.tsv"), "1\tu\ten+es\thola you\n2\tu\ten\tonly\n3\tshort\n")
    assert [tuple(r) for r in R.read_tweet_pairs(spark, p).collect()] == [("en+es", "hola you")]
    q = write(os.path.join(tmp_dir, "rec.tsv"), '1\tu\ten\t"quoted" text\n2\tu\ten+es\tx\n3\tu\tes/ca\ty\n')
    rows = [tuple(r) for r in R.read_label_records(spark, q).collect()]
    assert rows == [("1", "u", "en", '"quoted" text')]


def test_nested_json(spark, tmp_dir):
    data = [{"code-switching": [{"text": " a "}, {"text": "b"}]}, {"other": 1}]
    p = write(os.path.join(tmp_dir, "n.json"), json.dumps(data))
    assert sorted(r["text"] for r in R.read_nested_json(spark, p).collect()) == ["a", "b"]


def test_embeddings_header(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "v.txt"), "2 3\nthe 0.1 0.2 0.3\ncat 1 2 3\n")
    rows = {r["token"]: r["vec"] for r in R.read_embeddings(spark, p).collect()}
    assert set(rows) == {"the", "cat"} and rows["cat"] == [1.0, 2.0, 3.0]


def test_csv_keeps_nan_code(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "codes.csv"), 'iso_1,iso_3,name\n,nan,"Min, Nan"\nen,eng,English\n')
    rows = {r["iso_3"]: r for r in R.read_csv(spark, p).collect()}
    assert rows["nan"]["iso_1"] is None and rows["nan"]["name"] == "Min, Nan"


def test_results_model_from_file(spark, tmp_dir):
    write(os.path.join(tmp_dir, "glotlid_flores.csv"), "lang_code,f1\neng,1.0\n")
    write(os.path.join(tmp_dir, "openlid_flores.csv"), "lang_code,f1\nfra,0.0\n")
    rows = sorted(tuple(r) for r in R.read_results(spark, os.path.join(tmp_dir, "*_flores.csv")).select("model", "lang_code").collect())
    assert rows == [("glotlid", "eng"), ("openlid", "fra")]


def test_first_available(spark):
    prim = spark.createDataFrame([("eng", "s1")], "lang string, text string")
    fb = spark.createDataFrame([("eng", "d1"), ("fra", "d2")], "lang string, text string")
    rows = sorted((r["lang"], r["text"], r["domain"]) for r in R.read_first_available(prim, fb, "lang").collect())
    assert rows == [("eng", "s1", None), ("fra", "d2", "document")]


def test_shards_and_resume(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", "eng"), (2, "a", "fra"), (3, "b", "eng")], "id int, dataset string, language string")
    out = os.path.join(tmp_dir, "shards")
    K.write_shards(df.filter("dataset = 'a'"), out)
    done = spark.read.parquet(out).select("dataset", "language")
    rest = K.resume(df, done, ["dataset", "language"])
    assert [r["id"] for r in rest.collect()] == [3]
    K.write_shards(rest, out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_predictions_csv(spark, tmp_dir):
    df = spark.createDataFrame([("hi", ["A", "B"])], "s string, labels array<string>")
    out = os.path.join(tmp_dir, "pred")
    K.write_predictions(df, out)
    back = R.read_csv(spark, out).select(F.from_json("labels", "array<string>").alias("l")).first()["l"]
    assert back == ["A", "B"]


def test_other_sinks(spark, tmp_dir):
    df = spark.createDataFrame([("eng", "a", "train"), ("fra", "b", "dev")], "language string, sentence string, split string")
    K.append_jsonl(df, os.path.join(tmp_dir, "j"))
    K.append_jsonl(df, os.path.join(tmp_dir, "j"))
    assert spark.read.json(os.path.join(tmp_dir, "j")).count() == 4
    K.append_summary(df.limit(1), os.path.join(tmp_dir, "s"))
    K.append_summary(df.limit(1), os.path.join(tmp_dir, "s"))
    assert spark.read.parquet(os.path.join(tmp_dir, "s")).count() == 2
    K.write_json_summary(df.groupBy().count(), os.path.join(tmp_dir, "g"))
    assert spark.read.json(os.path.join(tmp_dir, "g")).first()["count"] == 2
    K.write_split(df, os.path.join(tmp_dir, "sp"))
    assert {d for d in os.listdir(os.path.join(tmp_dir, "sp")) if d.startswith("split=")} == {"split=dev", "split=train"}


def test_jsonl_lines_parts_and_splits(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "a.jsonl"), '{"text": "x", "post_text": "p1"}\n{"text": "y"}\n')
    rows = sorted((r["text"], r["post_text"]) for r in R.read_jsonl(spark, p, ["text", "post_text"]).collect())
    assert rows == [("x", "p1"), ("y", None)]
    q = write(os.path.join(tmp_dir, "l.txt"), " merhaba hello \n\nselam\n")
    kept = [r["codeswitch_sentence"] for r in R.read_lines(spark, q, "Turkish-English", "src").collect()]
    assert kept == ["merhaba hello", "selam"]
    assert R.read_lines(spark, q, "Turkish-English", "src", drop_blank=False).count() == 3
    d = os.path.join(tmp_dir, "parts")
    for i in range(2):
        spark.createDataFrame([(i,)], "b int").write.parquet(os.path.join(d, f"lang_{i}.parquet"))
    spark.createDataFrame([(9,)], "b int").write.parquet(os.path.join(d, f"other_{9}.parquet"))
    assert sorted(r["b"] for r in R.read_parquet_parts(spark, d, "lang").collect()) == [0, 1]
    a = spark.createDataFrame([("t", "x")], "text string, split string")
    b = spark.createDataFrame([("u",)], "text string")
    assert R.read_splits([a, b]).count() == 2
