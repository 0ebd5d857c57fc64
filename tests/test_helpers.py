"""Small helpers: P13-P15, A13, T8, UD1, UD2 and the user-detector wrapper."""

from pyspark.sql import functions as F

from langmix.operators import corpus as C
from langmix.operators import udf as U


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, language_x string, language_y string")
    assert C.drop_prefixed_columns(df, "language").columns == ["id"]
    assert C.rename_columns(df, {"language_x": "language"}).columns == ["id", "language", "language_y"]
    r = C.with_literals(df, {"languages": "A-B", "dataset_source": "S"}).first()
    assert (r["languages"], r["dataset_source"]) == ("A-B", "S")


def test_distinct_and_sample(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(30)], "doc_id long, label string")
    r = C.distinct_labels(df, "label").first()
    assert r["nunique"] == 3 and r["unique"] == ["x", "y", "z"]
    a = [x["doc_id"] for x in C.sample_rows(df.repartition(5), 7, "doc_id").collect()]
    b = [x["doc_id"] for x in C.sample_rows(df.repartition(2), 7, "doc_id").collect()]
    assert a == b and len(a) == 7


def test_map_rows_and_detector(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "bonjour\nle monde")], "id long, text string")
    out = U.map_rows(df, lambda b: b.assign(n=b["text"].fillna("").str.len()), "id long, text string, n long")
    assert sorted((r["id"], r["n"]) for r in out.collect()) == [(1, 11), (2, 0), (3, 16)]

    def guess(texts):
        return [("fra" if "bonjour" in t else "eng", 0.9) for t in texts]

    pred = {r["id"]: r["pred_lang"] for r in U.pandas_detector(df, "id", "text", guess).collect()}
    assert pred == {1: "eng", 2: "eng", 3: "fra"}

    def broken(texts):
        raise RuntimeError("detector down")

    assert all(r["pred_lang"] is None for r in U.pandas_detector(df, "id", "text", broken).collect())


def test_safe_map(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "s string")
    mapped, rejects = U.safe_map(df, "s", F.expr("try_cast(s AS int)").cast("string"), "v")
    assert sorted((r["s"], r["v"]) for r in mapped.collect() if r["s"]) == [("12", "12"), ("x", "x")]
    assert [r["s"] for r in rejects.collect()] == ["x"]


def test_shuffle_rows(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    full = [r["doc_id"] for r in C.shuffle_rows(df.repartition(4), "doc_id").collect()]
    again = [r["doc_id"] for r in C.shuffle_rows(df.repartition(9), "doc_id").collect()]
    assert full == again and sorted(full) == list(range(200)) and full != list(range(200))
    local = C.shuffle_rows(df.repartition(4, "doc_id"), "doc_id", local=True)
    assert local.rdd.getNumPartitions() == 4 and sorted(r["doc_id"] for r in local.collect()) == list(range(200))
