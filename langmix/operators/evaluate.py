"""Evaluation sets as specs over one operator."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from langmix.functions import text as T
from langmix.operators import metrics as M


@dataclass(frozen=True)
class EvalSpec:
    """How a set is read: its text and gold columns, the text's cleaning, the columns kept beside the prediction
    (None: all), whether the cleaned text is kept as ``text``, and the values of missing fields (E21's streamed
    form)."""

    data_name: str
    text: str = "text"
    gold: str = "language"
    clean: str = "none"  # none | delete (newlines go) | space (newlines become spaces, trimmed)
    metadata: tuple[str, ...] | None = ()
    keep_text: bool = False
    defaults: Mapping[str, object] = field(default_factory=dict)

    def cleaned(self, df: DataFrame) -> Column:
        """The set's text, cleaned; an array of segments is joined first."""
        c = F.col(self.text)
        c = T.join_segments(c) if isinstance(df.schema[self.text].dataType, ArrayType) else c
        return {"none": c, "delete": T.delete_newlines(c), "space": T.newlines_to_space(c)}[self.clean]


# --- fixed values: the sets, their gold columns and metadata ----------------
_VOICE = ("age", "gender", "accent", "up_votes", "down_votes")
EVAL_SPECS = {
    "flores": EvalSpec("flores", "text", "iso_639_3", "delete", ("domain", "topic", "iso_15924"), True),
    "smol": EvalSpec("smol", "trg", "tl", "space", ("domain",), True),
    "bloom_stories": EvalSpec("bloom_stories", "text", "language_code", "none",
                              ("title", "language", "license", "copyright", "pageCount", "bookInstanceId", "bookLineage"), True),
    "tweetlid": EvalSpec("tweetlid", "tweet", "lang_code", "none", None),
    "common_voice": EvalSpec("common_voice", "sentence", "language_code", "none", _VOICE, True),
    "common_voice_stream": EvalSpec("common_voice", "sentence", "language_code", "none", _VOICE, True,
                                    {"sentence": "", "age": "", "gender": "", "accent": "", "up_votes": 0, "down_votes": 0}),
    "code_switch": EvalSpec("code_switch", "codeswitch_sentence", "languages", "none", None),
}
# ---------------------------------------------------------------------------


def evaluate(df: DataFrame, spec: EvalSpec, model, id_col: str, top_k: bool = False) -> DataFrame:
    """One set through one detector (E17-E22): id, data_name, the set's own columns, gold, pred_lang, pred_prob (and
    ``top_preds``). ``model`` has the M1 interface. Fields named in ``defaults`` are filled, and added where the
    source lacks them. The prediction comes back by the id; texts are not shuffled for it."""
    for name, value in spec.defaults.items():
        have = F.col(name) if name in df.columns else F.lit(None).cast("string" if isinstance(value, str) else "long")
        df = df.withColumn(name, F.coalesce(have, F.lit(value)))
    names = spec.metadata if spec.metadata is not None else tuple(c for c in df.columns if c not in (id_col, spec.gold))
    text = [spec.cleaned(df).alias("text")] if spec.keep_text else []
    rows = df.select(id_col, F.col(spec.gold).alias("gold"), *names, *text)
    pred = model.transform(df.select(id_col, spec.cleaned(df).alias("__text")), id_col, "__text")
    got = ["pred_lang", "pred_prob", *(["top_preds"] if top_k else [])]
    return rows.join(pred.select(id_col, *got), id_col).withColumn("data_name", F.lit(spec.data_name))


def evaluate_all(sets: list[tuple[DataFrame, EvalSpec, str]], model, codes: DataFrame, model_name: str) -> DataFrame:
    """The summary line of each set ``(rows, spec, id column)``. The sets' texts are one frame that the detector
    meets once; a row's gold label travels in its id, so no text is joined or shuffled."""
    rows = reduce(DataFrame.unionByName, [
        df.select(F.struct(F.lit(spec.data_name).alias("data_name"), F.col(id_col).cast("string").alias("id"), F.col(spec.gold).alias("gold")).alias("key"),
                  spec.cleaned(df).alias("text")) for df, spec, id_col in sets])
    pred = model.transform(rows, "key", "text").select("key.data_name", "key.gold", "pred_lang", F.lit(model_name).alias("model"))
    summary = M.score_predictions(pred, codes, "gold", data_name=None, group="data_name")
    return summary.select("data_name", F.lit(model_name).alias("model"), "acc", "f1", "fpr", "n_rows")
