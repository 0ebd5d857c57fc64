"""Operator 1: drop lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import BLANKS, ascii_lower, stored, without

#: Lines with over a HOT-th of all rows of common lines are broadcast: there are at most HOT of them.
HOT = 10_000


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose normalised form stands in at least ``min_docs`` distinct documents.

    Lines are exploded with their position and reduced to two independently seeded 64-bit hashes. One grouped
    distinct count finds the common hashes (a line that a third of all documents hold collapses in the partial
    aggregate). The few hottest lines, whose number has a bound, are met by broadcast, all others by a hash join. The hits become a set of positions per document, and each document is put together again from the
    positions left. Only hashes are shuffled by line; the texts move once, to meet their positions.

    Returns all input columns with the text replaced, and ``n_lines``, ``n_dropped`` (both replace input columns of
    that name). Null and empty texts are one empty line; an empty line is never dropped. Rows with the same id
    count as one document; a null id is one document of its own. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(text)  # tells rows with the same id apart
    keyed = docs.select(
        F.col(id_col).alias("d"), mark.alias("m"),
        F.posexplode(F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))).alias("pos", "key"),
    ).where(F.col("key") != "").select("d", "m", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    common = stored(
        keyed.groupBy("h1", "h2").agg(F.count_distinct(F.struct("d")).alias("n")).where(F.col("n") >= min_docs), "common-lines")
    # Counts add up to the total, so at most HOT lines reach this share of it: they may be broadcast. No other line
    # has more rows than a HOT-th of all, so the join of the rest by hash has no hot key.
    total = common.agg(F.sum("n")).first()[0] or 0
    hot = common.where(F.col("n") * HOT >= total).select("h1", "h2", F.lit(True).alias("hot"))
    rest = common.where(F.col("n") * HOT < total).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    marked = keyed.join(F.broadcast(hot), ["h1", "h2"], "left")
    spread = F.when(F.col("hot"), F.xxhash64("d", "m", "pos")).otherwise(F.col("h1"))  # hot rows need no partner
    found = marked.withColumn("h1", spread).join(rest, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
    drops = found.where("hot or r1 is not null").groupBy("d", "m").agg(F.collect_set("pos").alias("__drop"))

    held = docs.select(
        F.struct(*without(docs, text_col, "n_lines", "n_dropped")).alias("__row"), F.col(id_col).alias("__d"), mark.alias("__m"),
        F.split(text, "\n").alias("__lines"),
    )
    both = held.join(drops, F.col("__d").eqNullSafe(F.col("d")) & (F.col("__m") == F.col("m")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.transform(left, lambda i: F.col("__lines")[i])
    out = {
        text_col: F.array_join(F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept), "\n"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long"),
    }
    cols = [out.pop(text_col).alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return both.select(*cols, *(v.alias(k) for k, v in out.items()))
