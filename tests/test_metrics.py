"""Metric identities and hand-checked values."""

from langmix.operators import codeswitch as CS
from langmix.operators import metrics as M
from langmix.sources.tables import code_dimension


def test_row_metrics_and_summary(spark):
    df = spark.createDataFrame(
        [("s", "en", "eng"), ("s", "fra", "deu"), ("s", "und", "eng"), ("s", None, "eng"), ("s", "deu", "deu")],
        "system string, gold string, pred_lang string",
    )
    r = M.score_predictions(df, code_dimension(spark), "gold").first()
    assert r["n_rows"] == 3
    assert r["acc"] == r["f1"] == round(2 / 3 * 100, 4)
    assert r["fpr"] == round(100 - r["acc"], 4)


def test_per_class_and_micro(spark):
    df = spark.createDataFrame([("s", "a", "a"), ("s", "a", "b"), ("s", "b", "b"), ("s", "c", "b")],
                               "system string, gold string, pred string")
    conf = M.confusion(df, "gold", "pred")
    pc = {r["label"]: r for r in M.per_class(conf).collect()}
    assert abs(pc["a"]["f1"] - 2 / 3) < 1e-12 and abs(pc["b"]["f1"] - 2 * 1 / 4) < 1e-12 and pc["c"]["f1"] == 0.0
    # b: fp = col - tp = 3 - 1 = 2; tn = total - (row + col - tp) = 4 - (1 + 3 - 1) = 1
    assert abs(pc["b"]["fpr"] - 2 / 3) < 1e-12
    s = M.fpr_summary(df, conf, "gold", "pred").first()
    assert s["micro_fpr"] == 0.5


def test_label_set_metrics(spark):
    rows = [("s", "A-B", "A-B"), ("s", "A-B", "A"), ("s", "A-B", "B-C"), ("s", "B-C", "A-B"), ("s", "B-C", "")]
    df = spark.createDataFrame(rows, "system string, true_label string, predicted_label string")
    m = {k: {r["label"]: r for r in v.collect()} for k, v in CS.label_set_metrics(df).items()}
    assert m["full_match"]["A-B"]["full_match"] == round(1 / 3, 6)
    assert m["partial_iou"]["A-B"]["partial_iou"] == round((1 / 2 + 1 / 3) / 2, 6)
    assert m["top_language"]["A-B"]["top_language"] == "A"  # A hit once, B hit once -> tie by name
    assert m["top_language"]["B-C"]["top_language"] == "B"
    # label A-B: rows with true != A-B predicted A-B = 1 (fp); true != A-B and pred != A-B = 1 (tn)
    assert m["fpr"]["A-B"]["fpr"] == 0.5
