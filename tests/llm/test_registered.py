import pytest

import __spark_entry__ as E
import corpus_pipeline
from tests.conftest import SF_SMALL

OPS = [k for k in E.queries() if k.startswith("op")]


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in OPS) == list(range(1, 14))
    assert "pipeline" in E.queries() and corpus_pipeline.ORACLE_SQL is None
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5


@pytest.mark.parametrize("key", ["op1_line_dedup", "op4_url_rules", "op5_exact_dedup", "op11_spelling", "op12_lexical_search"])
def test_oracle(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = E.queries()[key](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(map(str, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect()))) == sorted(
        map(str, rel.project(", ".join(sorted(got.columns))).fetchall()))


def test_pipeline_keeps_what_no_stage_drops(spark):
    from langmix.sources.tables import table

    docs = table(spark, SF_SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packed":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kept["quality"] == kept["lines"] >= kept["near"] == kept["mixed"] == kept["packed"]
    assert len(kept["near"]) > 100
