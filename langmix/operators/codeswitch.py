"""Code-switch label sets: corpus assembly and set-match metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.functions.codes import map_pair, normalise_pair, rename_pair

CS_COLUMNS = ["codeswitch_sentence", "languages", "dataset_source"]


def union_all_by_name(frames: list[DataFrame]) -> DataFrame:
    """Concat by column name, missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def at_most_two_languages(label) -> F.Column:
    """Keep labels with at most one '+'."""
    return F.size(F.split(label, r"\+")) <= 2


def normalise_labels(df: DataFrame, label: str = "languages") -> DataFrame:
    """Label pipeline after the merge of all sources: pair map (F8), rename (F8),
    dash normalisation and sorting (F7). Rows whose tweet label names more than
    two languages are dropped first (P8)."""
    out = df.filter(at_most_two_languages(F.col(label)))
    return out.withColumn(label, normalise_pair(rename_pair(map_pair(F.col(label)))))


def label_set_metrics(scored: DataFrame, gold: str = "true_label", pred: str = "predicted_label",
                      system: str = "system") -> dict[str, DataFrame]:
    """E10-E13 per system. ``gold``/``pred`` are '-'-joined sorted label strings.

    * fpr (E10): for each gold label L, fp / (fp + tn) where fp = rows with
      gold != L predicted L, tn = rows with gold != L not predicted L.
    * full_match (E11): share of rows with pred == gold, by gold.
    * partial_iou (E12): rows with unequal but overlapping sets: mean |inter| / |union|.
    * top_language (E13): over rows whose sorted lists differ, the gold language
      most often found in the prediction (ties -> smallest name); groups with no hit absent.
    """
    g, p = F.col(gold), F.col(pred)
    totals = scored.groupBy(system).agg(F.count(F.lit(1)).alias("__total"))
    gold_n = scored.groupBy(system, gold).agg(F.count(F.lit(1)).alias("__g"))
    pred_n = scored.groupBy(system, p.alias(gold)).agg(
        F.count(F.lit(1)).alias("__p"), F.sum((g == p).cast("long")).alias("__tp")
    )
    fpr = (
        gold_n.join(pred_n, [system, gold], "left")
        .join(totals, system)
        .select(
            system,
            F.col(gold).alias("label"),
            (F.coalesce("__p", F.lit(0)) - F.coalesce("__tp", F.lit(0))).alias("fp"),
            (F.col("__total") - F.col("__g") - (F.coalesce("__p", F.lit(0)) - F.coalesce("__tp", F.lit(0)))).alias("tn"),
        )
        .select(
            system,
            "label",
            F.round(F.when((F.col("fp") + F.col("tn")) > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).otherwise(0.0), 6)
            .alias("fpr"),
        )
    )
    full = scored.groupBy(system, F.col(gold).alias("label")).agg(
        F.round(F.avg((g == p).cast("double")), 6).alias("full_match")
    )
    gs, ps = F.array_distinct(F.split(g, "-")), F.array_distinct(F.split(p, "-"))
    inter, union = F.array_intersect(gs, ps), F.array_union(gs, ps)
    same_set = F.size(F.array_except(gs, ps)) + F.size(F.array_except(ps, gs)) == 0
    partial = (
        scored.filter(~same_set & (F.size(inter) > 0))
        .groupBy(system, F.col(gold).alias("label"))
        .agg(F.round(F.avg(F.size(inter) / F.size(union)), 6).alias("partial_iou"))
    )
    gl, pl = F.split(g, "-"), F.split(p, "-")
    differs = F.array_join(F.array_sort(gl), "\u0001") != F.array_join(F.array_sort(pl), "\u0001")
    hits = (
        scored.filter(differs)
        .select(system, F.col(gold).alias("label"), F.explode(gl).alias("lang"), pl.alias("__pl"))
        .filter(F.array_contains("__pl", F.col("lang")))
        .groupBy(system, "label", "lang")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(system, "label").orderBy(F.desc("n"), "lang")
    top = hits.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(
        system, "label", F.col("lang").alias("top_language")
    )
    return {"fpr": fpr, "full_match": full, "partial_iou": partial, "top_language": top}


def compare_systems(metric: DataFrame, value: str, system: str = "system", systems: list[str] | None = None) -> DataFrame:
    """Labels x systems table; null where a system has no value."""
    return metric.groupBy("label").pivot(system, systems).agg(F.first(value))
