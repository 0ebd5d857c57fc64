"""A job killed half-way goes on in its folder; other inputs are another job."""

import os

import pytest
from pyspark.sql import functions as F

from langmix.streaming import jobs as J


def test_killed_job_goes_on(spark, tmp_dir):
    src = f"{tmp_dir}/docs.parquet"
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "'x' AS language").coalesce(1).write.mode("append").parquet(src)
    folder = J.job_folder(spark, "resume-test", [src], size=1)
    assert folder == J.job_folder(spark, "resume-test", [src], size=1) != J.job_folder(spark, "resume-test", [src], size=2)
    done = []

    def run(stop_at):
        def fn(batch):
            if len(done) == stop_at:
                raise RuntimeError("killed")
            done.append(sorted(r["id"] for r in batch.select("id").collect()))
            return batch.withColumn("twice", F.col("id") * 2)

        return J.stream_map(spark, J.parquet_stream(spark, tmp_dir, "docs", max_files=1), fn, folder)

    with pytest.raises(Exception, match="killed"):
        run(2)
    assert len(done) == 2
    out = run(None)
    assert len(done) == 4 and sorted(x for b in done for x in b) == list(range(40))  # no batch was done again
    assert sorted((r["id"], r["twice"]) for r in out.collect()) == [(i, 2 * i) for i in range(40)]
    again = run(0)  # all is done: nothing runs
    assert again.count() == 40 and len(done) == 4
    assert any(n == "_manifest" for n in os.listdir(folder.removeprefix("file:")))
    spark.range(5).selectExpr("id", "'y' AS language").write.mode("append").parquet(src)
    assert J.job_folder(spark, "resume-test", [src], size=1) != folder
