"""Exact rank-based selection without single-task windows.

``row_number() over (partition by g order by h)`` puts every row of a group in
one task; a language that holds a third of the corpus would then be sorted by a
single core. :func:`head_flag` finds the cutoff of each group instead:

1. histogram the rows on a short prefix of the (uniform) order hash:
   ``groupBy(g, prefix).count()`` -- partial aggregation, tiny output;
2. a running sum over that small table finds, per group, the bucket that holds
   the boundary rank;
3. inside that bucket the same is done with a longer prefix, and only the rows
   of the last bucket (about ``1/16^(2 * prefix_len)`` of the group) are ranked.

The cutoffs, one row per group, are joined to the rows, which are not shuffled
as long as the planner finds the cutoffs small enough to broadcast.
:func:`global_rank` deals rows by ranges of the order and adds the sizes of the
ranges before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmix.session import stored

#: Above every hex digit: closes a prefix from above.
_TOP = "g"


def md5_order(id_col, seed: int | str = 42) -> Column:
    """Reproducible order key ``md5('<seed>:<id>')`` (same text in DuckDB)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def _reach(hist: DataFrame) -> DataFrame:
    """Per part of ``hist(part, limit, bucket, n)``, the last bucket that the limit reaches into: its ``n`` rows, of
    which the first ``limit`` are within the limit. Parts with a limit of 0 have none."""
    run = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("cum", F.sum("n").over(run)).withColumn("left", F.col("limit") - (F.col("cum") - F.col("n")))
    last = Window.partitionBy("part").orderBy(F.desc("bucket"))
    reached = cum.where("left > 0").withColumn("k", F.row_number().over(last)).where("k = 1")
    return reached.select("part", "bucket", F.col("left").alias("limit"), "n")


def head_flag(
    df: DataFrame,
    part_cols: Sequence[str],
    order_col: str,
    tie_col: str,
    limit_fn: Callable[[Column], Column],
    flag: str = "in_head",
    prefix_len: int = 3,
) -> DataFrame:
    """Add boolean ``flag``: row's rank within ``part_cols`` (by order_col, tie_col) <= limit.

    ``limit_fn`` receives the group's total row count and returns its limit
    (e.g. ``lambda n: F.floor(n * 0.9)``). ``order_col`` must be a uniform hex
    hash string, so its prefixes spread rows evenly; ``tie_col`` must be unique
    per row. Rows with null group columns form groups like any other.
    """
    part = F.struct(*[F.col(c) for c in part_cols]) if part_cols else F.lit(0)
    rows = df.select(part.alias("part"), F.col(order_col).alias("o"), F.col(tie_col).alias("t"))
    # two scans find the cutoffs: a histogram of all rows, and the rows of each part's boundary bucket
    counts = stored(rows.groupBy("part", F.substring("o", 1, prefix_len).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "rank-buckets")
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"))
    limits = totals.select(F.col("part").alias("__p"), limit_fn(F.col("total")).cast("long").alias("limit"))
    hist = counts.join(limits, F.col("part").eqNullSafe(F.col("__p"))).select("part", "limit", "bucket", "n")
    first = stored(_reach(hist), "rank-limits")
    open_first = first.where("limit < n").select(F.col("part").alias("__p"), "bucket", "limit")
    near = rows.withColumn("bucket", F.substring("o", 1, prefix_len)).join(open_first, ["bucket"]).where(F.col("part").eqNullSafe(F.col("__p")))
    near = stored(near.select("part", "o", "t", "limit"), "rank-open")
    finer = near.groupBy("part", "limit", F.substring("o", 1, 2 * prefix_len).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    second = stored(_reach(finer), "rank-limits")
    open_second = second.where("limit < n").select(F.col("part").alias("__p"), "bucket", "limit")
    last = near.drop("limit").withColumn("bucket", F.substring("o", 1, 2 * prefix_len)).join(open_second, ["bucket"]).where(F.col("part").eqNullSafe(F.col("__p"))).drop("__p")
    ranked = last.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("o", "t")))
    cuts = ranked.where("rn = limit").select("part", F.col("o").alias("cut"), F.col("t").alias("cut_tie"))
    whole = F.concat("bucket", F.lit(_TOP)).alias("cut")
    none = F.lit(None).cast(rows.schema["t"].dataType).alias("cut_tie")
    cuts = cuts.unionByName(first.where("limit >= n").select("part", whole, none)).unionByName(second.where("limit >= n").select("part", whole, none))
    cuts = stored(cuts, "rank-cutoffs").select(F.col("part").alias("__part"), F.col("cut").alias("__cut"), F.col("cut_tie").alias("__tie"))
    o, t = F.col(order_col), F.col(tie_col)
    inside = (o < F.col("__cut")) | ((o == F.col("__cut")) & (t <= F.col("__tie")))
    return (
        df.join(cuts, part == F.col("__part"), "left").withColumn(flag, F.coalesce(inside, F.lit(False))).drop("__part", "__cut", "__tie")
    )


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Exact 1-based global rank by ``order`` without a single-partition window.

    Rows are dealt by ranges of ``order`` (which should be unique), so no key can
    crowd a task; the offset of a range is the number of rows in the ranges
    before it, from a running sum over one row for each range."""
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "rank-ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy("__range").orderBy(*order)
    # one row for each range: bounded by the number of shuffle partitions
    return (
        dealt.join(F.broadcast(offsets), "__range")
        .withColumn(rank_col, F.col("__off") + F.row_number().over(inner))
        .drop("__off", "__range")
    )
