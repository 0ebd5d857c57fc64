"""Pairing jobs: document pairs, language-pair discovery and greedy pair cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.operators.ranking import global_rank
from langmix.session import stored


def doc_pairs(corpus: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Pair the documents with their neighbours in the order of their ids: the first with the second, the third with
    the fourth, and so on, so at most the last one has no partner, whatever gaps the ids have.

    Ids alone are ranked (:func:`global_rank`) and paired; each side then meets its text by the id. Pairs of one
    language are kept: jobs that need two languages say so. Output: ``pair_id`` (= first doc), both docs' id,
    language, data_lang, dataset and sentence as ``*_a`` / ``*_b``. Ids are unique; a null id has no pair.
    """
    cols = ["doc_id", "sentence", "data_lang", "language", "dataset", *(extra or [])]
    ranked = global_rank(corpus.select("doc_id").where("doc_id is not null"), [F.col("doc_id")])
    place = ranked.select("doc_id", F.expr("(rank - 1) div 2").alias("pair"), ((F.col("rank") - 1) % 2).alias("side"))
    both = place.groupBy("pair").agg(F.min_by("doc_id", "side").alias("pair_id"), F.max_by("doc_id", "side").alias("other"), F.count(F.lit(1)).alias("n"))
    both = stored(both.where("n = 2").select("pair_id", "other"), "pair-ids")
    first = corpus.select(*[F.col(c).alias(f"{c}_a") for c in cols]).join(both.select("pair_id"), F.col("doc_id_a") == F.col("pair_id"))
    second = corpus.select(*[F.col(c).alias(f"{c}_b") for c in cols]).join(both.select(F.col("pair_id").alias("__pair"), "other"), F.col("doc_id_b") == F.col("other"))
    return first.join(second.drop("other"), F.col("pair_id") == F.col("__pair")).drop("__pair")


def two_languages(pairs: DataFrame) -> DataFrame:
    """The pairs whose sides differ in language."""
    return pairs.where(F.col("language_a") != F.col("language_b"))


def pairs_with_data(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs (l1 < l2) that occur in the data, with their row count."""
    return (
        pairs.filter(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("l1"), F.greatest(a, b).alias("l2"), "pair_id")
        .groupBy("l1", "l2")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("pair_id").alias("first_pair"))
    )


def pair_product(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Ordered pairs (l1, l2), l1 != l2, that have data.

    The reference probes every ordered pair of a language list and keeps those
    with data; the pairs with data are exactly the distinct pairs present, so
    this groups the data instead of forming a product."""
    u = pairs_with_data(pairs, a, b)
    return u.unionByName(u.select(F.col("l2").alias("l1"), F.col("l1").alias("l2"), "n_rows", "first_pair")).drop(
        "first_pair"
    )


def pair_uncovered(pairs: DataFrame, a: str, b: str, hub: str) -> DataFrame:
    """Languages covered by a hub pair with data are removed; the pairs
    (l1 < l2) among the remaining languages that have data are returned."""
    u = pairs_with_data(pairs, a, b)
    covered = (
        u.filter((F.col("l1") == hub) | (F.col("l2") == hub))
        .select(F.when(F.col("l1") == hub, F.col("l2")).otherwise(F.col("l1")).alias("lang"))
        .union(pairs.sparkSession.createDataFrame([(hub,)], "lang string"))
        .distinct()
    )
    rest = u.filter((F.col("l1") != hub) & (F.col("l2") != hub))
    rest = rest.join(covered.withColumnRenamed("lang", "l1"), "l1", "left_anti")
    rest = rest.join(covered.withColumnRenamed("lang", "l2"), "l2", "left_anti")
    return rest.select("l1", "l2", "n_rows")


def ranked_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with data in scan order: first occurrence in the pair table, then names."""
    u = pairs_with_data(pairs, a, b)
    return global_rank(u, [F.col("first_pair"), F.col("l1"), F.col("l2")]).select("l1", "l2", "rank")


def greedy_pair_cover(ranked: DataFrame, hub: str) -> DataFrame:
    """Sequential greedy cover, computed in parallel rounds.

    Sequential rule (scan by ``rank``): a hub pair (hub, X) is taken when X is
    unseen; any other pair only when both ends are unseen; taken ends become seen.

    Round rule: a live pair is taken when, at every non-hub endpoint, it has
    the smallest rank among live pairs touching that endpoint. Taken ends are
    marked seen and every pair touching a seen end dies. Every pair taken in a
    round is one the sequential scan takes (all smaller-ranked pairs at its
    ends are already dead), so the rounds reproduce the sequential result.
    Each round's live set is ``checkpoint()``-ed to the shared folder, which cuts
    the lineage (the plan would otherwise grow geometrically with rounds).
    """
    spark = ranked.sparkSession
    live = ranked.select("l1", "l2", "rank").checkpoint()
    taken = []
    while not live.isEmpty():  # each round takes the smallest live rank at least
        ends = live.select(F.col("l1").alias("v"), "rank").union(live.select(F.col("l2").alias("v"), "rank"))
        best = ends.filter(F.col("v") != hub).groupBy("v").agg(F.min("rank").alias("best"))
        cand = live.join(best.withColumnRenamed("v", "l1").withColumnRenamed("best", "b1"), "l1", "left")
        cand = cand.join(best.withColumnRenamed("v", "l2").withColumnRenamed("best", "b2"), "l2", "left")
        ok1 = (F.col("l1") == hub) | (F.col("b1") == F.col("rank"))
        ok2 = (F.col("l2") == hub) | (F.col("b2") == F.col("rank"))
        # ``now`` hangs off the checkpointed ``live`` (short lineage), so caching
        # is enough; a lost block is recomputed from that checkpoint.
        now = cand.filter(ok1 & ok2).select("l1", "l2", "rank").cache()
        taken.append(now)
        seen = now.select(F.col("l1").alias("v")).union(now.select(F.col("l2").alias("v"))).filter(F.col("v") != hub)
        live = live.join(seen.withColumnRenamed("v", "l1"), "l1", "left_anti")
        live = live.join(seen.withColumnRenamed("v", "l2"), "l2", "left_anti").checkpoint()
    if not taken:
        return spark.createDataFrame([], "l1 string, l2 string, rank int")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out
