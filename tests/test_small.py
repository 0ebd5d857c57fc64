"""Dimensions from files, and the forms of stored predictions."""

from pyspark.sql import functions as F

from langmix.functions import codes as D
from langmix.sources.tables import DIMENSIONS, code_map, read_dimension


def test_dimensions(spark, tmp_dir):
    samples = {"iso": "aa,,,aar,Afar\nna,,,nan,\n", "bloom": "aeu,Akeu,47,6,5\n", "voxpopuli": "English,En,rng,543,1313,4.8M\n",
               "smol": 'am_ar,Arabic,Arab,Asia,x,"A (B); C, D",329,0,0\n', "resource_class": "eng,5,English\neng,4,Old\n"}
    for kind, body in samples.items():
        names = [c.strip().split("`")[1] if "`" in c else c.split()[0] for c in DIMENSIONS[kind].split(", ")]
        open(f"{tmp_dir}/{kind}.csv", "w").write(",".join(names) + "\n" + body)
        assert read_dimension(spark, kind, f"{tmp_dir}/{kind}.csv").columns == names
    iso = read_dimension(spark, "iso", f"{tmp_dir}/iso.csv")
    assert {r["key"]: r["value"] for r in code_map(iso, "iso_1", "iso_3").collect()} == {"aa": "aar", "na": "nan"}
    assert read_dimension(spark, "bloom", f"{tmp_dir}/bloom.csv").first()["Test Stories"] == 5


def test_stored_predictions(spark):
    rows = [("{'b': 0.2, 'a': 0.5, 'c': 0.5}", "[b:0.2, a:0.5]"), ("{}", "[]"), ("nonsense", "x"), (None, None)]
    out = spark.createDataFrame(rows, "t string, l string").select(D.stored_top2("t").alias("o"), D.stored_top2_by_probability("t").alias("p"), D.listed_top2("l").alias("l"))
    assert [tuple(r) for r in out.collect()] == [(["b", "a"], ["a", "c"], ["b", "a"]), ([], [], []), ([], [], []), ([], [], [])]
    assert out.where(F.col("o").isNull()).count() == 0
