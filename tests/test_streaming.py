"""Streaming jobs equal their batch counterparts and survive a restart (ST2, ST3)."""

from langmix.operators.corpus import canonicalise_documents, language_summary
from langmix.plans import fixtures as X
from langmix.session import scratch_path
from langmix.sources.tables import code_dimension
from langmix.streaming import jobs as ST
from tests.conftest import SF_SMALL


def test_stream_profile_equals_batch_and_restart_is_idempotent(spark):
    out = scratch_path(spark, "test-profile")
    stream = canonicalise_documents(ST.parquet_stream(spark, SF_SMALL, "documents"), code_dimension(spark))
    first = sorted(map(tuple, ST.stream_profile(spark, stream, out)["language"].collect()))
    batch = sorted(map(tuple, language_summary(X.corpus(spark, SF_SMALL)).collect()))
    assert first == batch
    # restart on the same checkpoint: nothing new is read, nothing is duplicated
    again = canonicalise_documents(ST.parquet_stream(spark, SF_SMALL, "documents"), code_dimension(spark))
    second = sorted(map(tuple, ST.stream_profile(spark, again, out)["language"].collect()))
    assert second == first


def test_stream_profile_dataset_and_global_equal_batch(spark):
    from langmix.operators.corpus import dataset_summary, global_summary

    stream = canonicalise_documents(ST.parquet_stream(spark, SF_SMALL, "documents"), code_dimension(spark))
    prof = ST.stream_profile(spark, stream)
    corpus = X.corpus(spark, SF_SMALL)
    assert sorted(map(tuple, prof["dataset"].collect())) == sorted(map(tuple, dataset_summary(corpus).collect()))
    g, b = prof["global"].first(), global_summary(corpus).first()
    assert (g["total_sentences"], g["total_languages"], g["total_datasets"]) == tuple(b)
