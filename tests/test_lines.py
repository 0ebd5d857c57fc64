"""Rows and records of files, however the files are cut."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from langmix.operators.cs_sources import load_source
from langmix.sources import lines as N
from langmix.sources import readers as R


@pytest.fixture(params=["300", "128m"])
def cut(request, spark):
    """Bytes in a split: a few lines, some dozen, all."""
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, request.param if k.endswith("PartitionBytes") else "1")
    yield request.param
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def _fields(rng):
    pool = ["a", 'say "hi"', "two\nlines", "three\n\n\nlines", "nan", "", "comma, here", "\r\n in\r\n crlf", "é x", " pad ", "'"]
    return [[str(i), rng.choice(pool) + rng.choice(["", "x" * rng.randint(0, 90)]), rng.choice(pool)] for i in range(40)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_in_parallel(spark, tmp_dir, cut, end):
    for k in (1, 2):
        with open(f"{tmp_dir}/part{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerows([["id", "text", "other name"], *_fields(random.Random(k))])
    df = R.read_csv(spark, f"{tmp_dir}/part*.csv", place=True)
    assert df.columns == ["place", "id", "text", "other name"]
    got = [(r["id"], r["text"], r["other name"]) for r in N.number_rows(df).orderBy("row").collect()]
    assert got == [tuple(x or None for x in row) for k in (1, 2) for row in _fields(random.Random(k))]
    tasks = spark.read.text(f"{tmp_dir}/part1.csv").rdd.getNumPartitions()
    assert tasks > 1 or cut != "300"


def test_csv_equals_the_sequential_read(spark, tmp_dir, cut):
    with open(f"{tmp_dir}/a.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "text", "n"], *_fields(random.Random(3))])
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(f"{tmp_dir}/a.csv")
    own = [tuple((x or "").replace("\r", "") for x in r) for r in R.read_csv(spark, f"{tmp_dir}/a.csv").orderBy(F.col("id").cast("int")).collect()]
    assert own == [tuple((x or "").replace("\r", "") for x in r) for r in whole.orderBy(F.col("id").cast("int")).collect()]
    typed = R.read_csv(spark, f"{tmp_dir}/a.csv", "id int, text string, n string")
    assert typed.agg(F.sum("id")).first()[0] == sum(range(40))


def test_csv_without_rows(spark, tmp_dir):
    open(f"{tmp_dir}/h.csv", "w").write("a,b\n")
    open(f"{tmp_dir}/e.csv", "w").write("")
    assert R.read_csv(spark, f"{tmp_dir}/h.csv").columns == ["a", "b"] and R.read_csv(spark, f"{tmp_dir}/h.csv").collect() == []
    assert R.read_csv(spark, f"{tmp_dir}/e.csv").collect() == []


@pytest.mark.parametrize("end,blank", [("\r\n", ""), ("\n", " \t\u3000")])
def test_blank_blocks_in_parallel(spark, tmp_dir, cut, end, blank):
    rng = random.Random(5)
    blocks = [[f"b{i}w{j} " + "x" * rng.randint(0, 40) for j in range(rng.randint(1, 9))] for i in range(14)]
    blocks[7] = [f"long{j} " + "y" * 30 for j in range(40)]  # over several splits
    lines = [blank]
    for b in blocks:
        lines += ["  " + x for x in b] + [blank] * rng.randint(1, 3)
    if cut == "300":
        lines = lines[:-1]
    open(f"{tmp_dir}/b.txt", "w", newline="", encoding="utf-8").write(end.join(lines))
    got = [r["lines"] for r in R.read_blank_blocks(spark, f"{tmp_dir}/b.txt").orderBy("block").collect()]
    assert got == [[x.strip() for x in b] for b in blocks]
    assert [r["lines"] for r in R.read_blank_blocks(spark, f"{tmp_dir}/b.txt", limit=9).orderBy("block").collect()] == got[:9]


def test_positions_join_files_without_a_shared_id(spark, tmp_dir, cut):
    gold = [f"gold {i} " + "g" * (i % 37) for i in range(60)]
    pred = [f"pred {i} " + "p" * (i * 7 % 91) for i in range(60)]
    for name, rows in (("gold", gold), ("pred", pred)):
        for k in range(3):
            open(f"{tmp_dir}/{name}-{k}.txt", "w").write("\n".join(rows[k * 20:k * 20 + 20]) + "\n")
    left = N.with_place(spark.read.text(f"{tmp_dir}/gold-*.txt").withColumnRenamed("value", "gold"))
    right = N.with_place(spark.read.text(f"{tmp_dir}/pred-*.txt").withColumnRenamed("value", "pred"))
    got = N.positional_join(left, right).orderBy("row").collect()
    assert [(r["row"], r["gold"], r["pred"]) for r in got] == [(i, g, p) for i, (g, p) in enumerate(zip(gold, pred))]


def test_splits_do_not_follow_the_layout(spark, tmp_dir):
    """The 70/30 cut, first rows and the first of equal rows are the same at every size of split."""
    open(f"{tmp_dir}/t.txt", "w").write("\n".join(f"row {i} " + "x" * (i % 50) for i in range(3_000)))
    seen = []
    for size in ("9000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = load_source(spark, "turkish", f"{tmp_dir}/t.txt")
        seen.append({r["codeswitch_sentence"] for r in rows.where("split = 'train'").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(seen[0]) == 2_100 and seen[0] == seen[1]


def test_documents_are_dealt_to_sources_once(spark, tmp_dir, monkeypatch):
    """What a source's files are written from is its own rows, not the documents; splits and numbers stay as they were."""
    import hashlib

    from langmix.plans import q_sources as Q

    docs = [(i, f"row {i:02d}  of text" if i != 7 else None, "en", "src", 15) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    monkeypatch.setattr(Q, "FILED", ["turkish", "egyptian_english"])
    read, write = [], Q._write
    monkeypatch.setattr(Q, "_write", lambda df, *rest: (read.append(df.inputFiles()), write(df, *rest)))
    got = sorted((r.codeswitch_sentence, r.split) for r in Q.cs_sources(spark, tmp_dir).collect())
    assert len(read) == 4 and all("source-documents" in f for files in read for f in files) and any(read)
    first = sorted(range(20), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:14]
    want = [(f"row {2 * i:02d} of text", "train" if i in first else "test") for i in range(20)]
    want += [(f"row {2 * u + 1:02d} of text", "train" if u % 4 > 1 else "test") for u in range(20) if 2 * u + 1 != 7]
    assert got == sorted(want)
