"""Vocabulary, encoding and embedding lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from langmix.functions.text import tweet_tokens
from langmix.operators.blocks import Block, Blocks, with_vectors
from langmix.operators.ranking import global_rank
from langmix.session import stored

PAD_ID, UNK_ID = 0, 1


def build_vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """A14 + W7: token counts over the training texts; ids by descending count
    (ties by token) starting at 2 (0 = <pad>, 1 = <unk>).

    The ranking is global but never single-partition (:func:`global_rank`). The
    vocabulary is written to the shared folder: it is counted once however often
    it is joined, and the planner knows its size."""
    toks = df.select(F.explode(tweet_tokens(text_col)).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = global_rank(counts, [F.col("cnt").desc(), F.col("token").asc()])
    return stored(ranked.select("token", "cnt", (F.col("rank") + 1).alias("id")), "vocabulary")


def encode_padded(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, max_len: int = 50) -> DataFrame:
    """First ``max_len`` tokens -> vocabulary ids (miss -> <unk>), right-padded with <pad>.

    Positions are exploded (at most ``max_len`` per row), joined with the
    vocabulary and re-gathered per row -- a bounded group."""
    pos = df.select(id_col, F.posexplode(F.slice(tweet_tokens(text_col), 1, max_len)).alias("pos", "token"))
    looked = pos.join(vocab.select("token", "id"), "token", "left").select(id_col, "pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    gathered = looked.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("__ids")
    )
    ids = F.coalesce(F.col("__ids"), F.array().cast("array<bigint>"))
    return (
        df.select(id_col)
        .join(gathered, id_col, "left")
        .select(id_col, F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.lit(max_len) - F.size(ids))).alias("ids"))
    )


def text_mean_vectors(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sum of the vectors of a whole text's known tokens over its number of tokens, min 1.

    ``vectors`` is ``(id, embedding array<float>)``. A token is counted once per
    text before it meets the vocabulary; texts are cut into blocks, and a block
    meets the vector of each of its distinct tokens once, so what moves is a number
    for a text's token and not its vector. Rows without any known token get the
    zero vector."""
    dim = vectors.select(F.size("embedding").alias("d")).agg(F.max("d")).first()[0] or 0
    toks = df.select(id_col, tweet_tokens(text_col).alias("__t"))
    lengths = toks.select(id_col, F.size("__t").alias("__n"))
    have = vocab.join(vectors.select("id"), "id", "left_semi").select("token", F.col("id").cast("long").alias("f"))
    counts = toks.select(id_col, F.explode("__t").alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).cast("double").alias("x"))
    features = counts.join(have, "token").groupBy(id_col).agg(F.collect_list(F.struct("f", "x")).alias("__f"))
    blocks = Blocks.cut(features, id_col, [], max(1, dim), features=F.col("__f"))
    table, kind = with_vectors(blocks, vectors, dim)
    schema = StructType([StructField(id_col, blocks.id_type), StructField("__s", ArrayType(DoubleType()))])

    def sums(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block.read(batch, r, 0)
                w = np.zeros((len(block.features), dim))
                of, e = (np.frombuffer(batch.column(c)[r].as_buffer(), k) for c, k in (("of", np.int32), ("e", kind)))
                np.add.at(w, of, e.reshape(len(of), dim))  # an id that comes twice counts twice
                flat = pa.array(block.times(w).ravel())
                ends = pa.array(np.arange(len(block.ends) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([block.ids, pa.ListArray.from_arrays(ends, flat)], names=schema.names)

    zero = F.array_repeat(F.lit(0.0), dim)
    return lengths.join(table.mapInArrow(sums, schema), id_col, "left").select(
        id_col, F.transform(F.coalesce("__s", zero), lambda s: s / F.greatest(F.col("__n"), F.lit(1))).alias("mean"))
