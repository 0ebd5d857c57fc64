"""Evaluation metrics as grouped DataFrame jobs.

Inputs are prediction tables with a ``system`` (model) column, a gold and a
predicted label column. Corpus-level metrics come from the sparse confusion
table ``(system, gold, pred, n)`` and its marginals -- never from a dense matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.functions.codes import RESERVED_LABELS, iso3_if_two_letter, strip_label_prefix, strip_script


def normalise_codes(df: DataFrame, codes: DataFrame, cols: list[str]) -> DataFrame:
    """F3 on each column: two-letter codes -> ISO-3 via the (broadcast) dimension."""
    dim = F.broadcast(codes.select("iso_1", "iso_3"))
    for c in cols:
        m = dim.select(F.col("iso_1").alias(f"__k_{c}"), F.col("iso_3").alias(f"__m_{c}"))
        df = df.join(m, F.col(c) == F.col(f"__k_{c}"), "left")
        df = df.withColumn(c, iso3_if_two_letter(c, f"__m_{c}")).drop(f"__k_{c}", f"__m_{c}")
    return df


def row_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Per-row accuracy; single-pair macro-F1 equals accuracy; FPR = 1 - accuracy."""
    acc = (F.col(gold) == F.col(pred)).cast("double")
    return df.withColumn("acc", acc).withColumn("f1", acc).withColumn("fpr", 1.0 - acc)


def score_predictions(df: DataFrame, codes: DataFrame, gold: str, pred: str = "pred_lang",
                      data_name: str | None = "data", group: str = "system") -> DataFrame:
    """P3 (drop nulls), P4 (drop und/other), F3 both sides, E1-E3, summary x100 rounded to 4."""
    clean = df.na.drop(subset=[gold, pred]).filter(~F.col(gold).isin(*RESERVED_LABELS))
    scored = row_scores(normalise_codes(clean, codes, [gold, pred]), gold, pred)
    extra = [F.lit(data_name).alias("data_name")] if data_name is not None and group != "data_name" else []
    return scored.groupBy(group).agg(
        *extra,
        F.round(F.avg("acc") * 100, 4).alias("acc"),
        F.round(F.avg("f1") * 100, 4).alias("f1"),
        F.round(F.avg("fpr") * 100, 4).alias("fpr"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def confusion(df: DataFrame, gold: str, pred: str, group: str = "system") -> DataFrame:
    """Sparse confusion counts."""
    return df.groupBy(group, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _marginals(conf: DataFrame, group: str) -> DataFrame:
    """Per (group, label) over gold U pred: row (gold) count, column (pred) count, diagonal, total."""
    rows = conf.groupBy(group, F.col("gold").alias("label")).agg(F.sum("n").alias("row"))
    cols = conf.groupBy(group, F.col("pred").alias("label")).agg(F.sum("n").alias("col"))
    diag = conf.filter(F.col("gold") == F.col("pred")).select(group, F.col("gold").alias("label"), F.col("n").alias("tp"))
    total = conf.groupBy(group).agg(F.sum("n").alias("total"))
    return (
        rows.join(cols, [group, "label"], "full")
        .join(diag, [group, "label"], "left")
        .join(total, group)
        .select(
            group,
            "label",
            F.coalesce("row", F.lit(0)).alias("row"),
            F.coalesce("col", F.lit(0)).alias("col"),
            F.coalesce("tp", F.lit(0)).alias("tp"),
            "total",
        )
    )


def per_class(conf: DataFrame, group: str = "system") -> DataFrame:
    """E6/E7 per label: F1 = 2tp/(row+col) and FPR = fp/(fp+tn), 0 on zero division."""
    m = _marginals(conf, group)
    fp = F.col("col") - F.col("tp")
    tn = F.col("total") - (F.col("row") + F.col("col") - F.col("tp"))
    return m.select(
        group,
        "label",
        F.when(F.col("row") + F.col("col") > 0, 2.0 * F.col("tp") / (F.col("row") + F.col("col"))).otherwise(0.0).alias("f1"),
        F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0).alias("fpr"),
    )


def macro_f1(conf: DataFrame, group: str = "system") -> DataFrame:
    """Unweighted mean of per-class F1 over gold U pred."""
    return per_class(conf, group).groupBy(group).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def fpr_summary(df: DataFrame, conf: DataFrame, gold: str, pred: str, group: str = "system") -> DataFrame:
    """E8 macro FPR (mean of E7) and E9 micro FPR (mismatch share, 0 if empty)."""
    macro = per_class(conf, group).groupBy(group).agg(F.round(F.avg("fpr"), 6).alias("macro_fpr"))
    micro = df.groupBy(group).agg(
        F.round(F.coalesce(F.avg((F.col(gold) != F.col(pred)).cast("double")), F.lit(0.0)), 6).alias("micro_fpr")
    )
    return macro.join(micro, group)


def code_stripped_f1(gold, pred) -> F.Column:
    """E5: strip ``__label__`` and the script from the prediction, the region/script from gold."""
    p = F.split(strip_label_prefix(pred), "_", 2).getItem(0)
    g = strip_script(gold)
    return (g == p).cast("double")


def resource_lang_groups(df: DataFrame, classes: DataFrame, model: str = "model") -> DataFrame:
    """Per (model, lang_code, class) mean f1, mean fpr, sample size.
    Rows whose class is null are dropped (as a pandas group-by does)."""
    joined = df.join(F.broadcast(classes), "lang_code", "left").filter(F.col("class").isNotNull())
    return joined.groupBy(model, "lang_code", "class").agg(
        F.avg("f1").alias("f1"),
        F.avg("fpr").alias("fpr"),
        F.count(F.lit(1)).alias("sample_size"),
    )


def resource_class_groups(lang_groups: DataFrame, model: str = "model") -> DataFrame:
    """Per (model, class) macro mean over languages, language count, samples."""
    return lang_groups.groupBy(model, "class").agg(
        F.round(F.avg("f1"), 6).alias("avg_f1"),
        F.count(F.lit(1)).alias("num_languages"),
        F.sum("sample_size").alias("total_samples"),
    )


def class_micro_groups(df: DataFrame, classes: DataFrame, model: str = "model") -> DataFrame:
    """Per (model, class) mean f1 over rows and row count."""
    joined = df.join(F.broadcast(classes), "lang_code", "left").filter(F.col("class").isNotNull())
    return joined.groupBy(model, "class").agg(F.round(F.avg("f1"), 6).alias("avg_f1"), F.count(F.lit(1)).alias("count"))


def lowest_per_class(df: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """Per class the k languages with the lowest mean f1 (ties by code)."""
    joined = df.join(F.broadcast(classes), "lang_code", "left").filter(F.col("class").isNotNull())
    g = joined.groupBy("class", "lang_code").agg(
        F.avg("f1").alias("f1_mean"), F.count(F.lit(1)).alias("sample_data")
    )
    w = Window.partitionBy("class").orderBy("f1_mean", "lang_code")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def largest_per_class(df: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """Per class the k languages with the most rows (ties by code)."""
    joined = df.join(F.broadcast(classes), "lang_code", "left").filter(F.col("class").isNotNull())
    g = joined.groupBy("class", "lang_code").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("class").orderBy(F.desc("count"), "lang_code")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
