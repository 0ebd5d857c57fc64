"""From documents to packed training sequences, stage by stage.

Each stage works on all that the one before it kept. ``run`` writes every stage's rows to the shared folder and reads
them again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.llm import quality_knn
from langmix.llm.common import stored
from langmix.llm.encode import tokenizer_path
from langmix.llm.line_dedup import drop_common_lines
from langmix.llm.mixing import mix, with_tokens
from langmix.llm.near_dedup import near_dedup
from langmix.llm.packing import pack
from langmix.sources.tables import table

VOCABULARY = "byte_bpe_50k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote rejects go."""
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_knn.classify(docs, model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more of the documents left share go; ``n_chars`` follows the text."""
    return drop_common_lines(docs, min_docs=10).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id."""
    return near_dedup(docs, percent=80).where("kept").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated towards the target weights, at most twice; every document stays at least once. Weights are of
    the tokens that ``packed`` places: the encoder's and one end id for each document. Rows are stored in the order
    of the mix."""
    order = ("mix_epoch", "mix_block", "mix_place")
    docs = stored(with_tokens(docs, tokenizer_path(VOCABULARY)), "mixed-tokens")
    dealt = mix(docs, tokens=F.col("n_tokens") + 1).select(*COLUMNS, *order)
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    return pack(docs, tokenizer_path(VOCABULARY), end_id=1)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixed", mixed), ("packed", packed)]

#: SQL cannot express the vote, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
