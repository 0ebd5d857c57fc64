"""Language-code and label-set column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from langmix.functions.text import col_

# --- fixed values (must equal the reference's behaviour) -------------------
# Gold labels excluded from scoring.
RESERVED_LABELS = ("und", "other")
# Prefix of fastText-style labels.
LABEL_PREFIX = "__label__"
# Iberian tweet pair labels -> pair names (a miss keeps the label):
PAIR_LABEL_MAP = {
    "en+es": "English-Spanish",
    "es+gl": "Spanish-Galician",
    "es+eu": "Spanish-Basque",
    "ca+es": "Catalan-Spanish",
    "ca+en": "Catalan-English",
    "en+eu": "English-Basque",
    "en+gl": "English-Galician",
    "gl+pt": "Galician-Portuguese",
    "en+pt": "English-Portuguese",
    "es+es/gl": "Spanish-Galician",
    "en+es/gl": "English-Spanish",
    "ca/es+en": "Catalan-English",
}
# Two pair names renamed after the merge of all sources:
PAIR_RENAME = {
    "Spanish-English": "English-Spanish",
    "Chinese-English": "English-Chinese",
}
# Language name -> code with script, as used to read detector output. The
# reference's dictionary lists Chinese twice; the later entry (zho_Hant) wins.
NAME_TO_SCRIPT_CODE = [
    ("Arabizi", "arb_Latn"),
    ("Basque", "eus_Latn"),
    ("Chinese", "zho_Hans"),
    ("Chinese", "zho_Hant"),
    ("Egyptian", "arz_Arab"),
    ("English", "eng_Latn"),
    ("German", "deu_Latn"),
    ("Hindi", "hin_Deva"),
    ("Indonesian", "ind_Latn"),
    ("MSA", "arb_Arab"),
    ("Malayalam", "mal_Mlym"),
    ("Saudi", "ars_Arab"),
    ("Spanish", "spa_Latn"),
    ("Tamil", "tam_Taml"),
    ("Turkish", "tur_Latn"),
]
# ---------------------------------------------------------------------------


def map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def last_wins(pairs) -> dict:
    """F25 helper: dictionary from (key, value) pairs, later keys win."""
    out: dict = {}
    for k, v in pairs:
        out[k] = v
    return out


def invert_last_wins(pairs) -> dict:
    """invert name->code pairs; when two names share a code the later wins."""
    return last_wins((v, k) for k, v in last_wins(pairs).items())


def strip_script(c) -> Column:
    """text before the first '-' and then before the first '_'."""
    return F.regexp_extract(col_(c), r"^[^-_]*", 0)


def strip_label_prefix(c) -> Column:
    """F5."""
    return F.replace(col_(c), F.lit(LABEL_PREFIX), F.lit(""))


def iso3_lenient(code, mapped) -> Column:
    """dimension hit or the code itself; ``mapped`` is the left-joined ISO-3 column."""
    return F.coalesce(col_(mapped), col_(code))


def iso3_if_two_letter(code, mapped) -> Column:
    """convert only two-letter codes."""
    code = col_(code)
    return F.when(F.length(code) == 2, F.coalesce(col_(mapped), code)).otherwise(code)


def prefix_before(c, sep: str) -> Column:
    """F2 helper: text before the first ``sep``."""
    return F.split(col_(c), "\\" + sep if sep in "-_" else sep, 2).getItem(0)


def normalise_pair(c) -> Column:
    """en/em dash -> '-'; two parts -> sorted and re-joined; else dash-normalised label."""
    dashed = F.regexp_replace(col_(c), "[–—]", "-")
    parts = F.split(dashed, "-")
    return F.when(F.size(parts) == 2, F.array_join(F.array_sort(parts), "-")).otherwise(dashed)


def map_pair(c) -> Column:
    """F8: Iberian pair dictionary, miss keeps the label."""
    return F.coalesce(F.element_at(map_literal(PAIR_LABEL_MAP), col_(c)), col_(c))


def rename_pair(c) -> Column:
    """F8 (second form): two-entry rename."""
    return F.coalesce(F.element_at(map_literal(PAIR_RENAME), col_(c)), col_(c))


def label_list(c) -> Column:
    """'A-B' -> ['A', 'B']."""
    return F.split(col_(c), "-")


def label_list_from_literal(c) -> Column:
    """parse a Python list literal such as "['A', 'B']"."""
    return F.from_json(col_(c), "array<string>", {"allowSingleQuotes": "true"})


def label_string(arr) -> Column:
    """F9 inverse: sorted, '-'-joined."""
    return F.array_join(F.array_sort(col_(arr)), "-")


def top2_labels(topk) -> Column:
    """first two labels of a ranked array<struct<lang, prob>> in stored order."""
    return F.slice(F.transform(col_(topk), lambda x: x["lang"]), 1, 2)


def stored_top2(text) -> Column:
    """F14 on a stored ``{'lang': prob, ...}``: the first two labels in stored order; null or unreadable -> empty."""
    return F.coalesce(F.slice(F.map_keys(_stored(text)), 1, 2), F.array().cast("array<string>"))


def stored_top2_by_probability(text) -> Column:
    """F14, the form that sorts: the two labels of the largest probability, equal ones in stored order."""
    entries = F.map_entries(_stored(text))
    keyed = F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("less"), i.alias("i"), e["key"].alias("lang")))
    return F.coalesce(F.transform(F.slice(F.array_sort(keyed), 1, 2), lambda e: e["lang"]), F.array().cast("array<string>"))


def listed_top2(text) -> Column:
    """F14 on list-like text: the first two words that a colon follows; null -> empty."""
    return F.coalesce(F.slice(F.regexp_extract_all(col_(text), F.lit(r"(\w+):"), 1), 1, 2), F.array().cast("array<string>"))


def _stored(text) -> Column:
    return F.from_json(col_(text), "map<string, double>", {"allowSingleQuotes": "true"})


def _class_array(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes]).cast("array<string>")


def multi_hot(labels, classes: list[str]) -> Column:
    """0/1 over the sorted class list."""
    arr = _class_array(classes)
    return F.transform(arr, lambda c: F.array_contains(col_(labels), c).cast("int"))


def multi_hot_inverse(bits, classes: list[str]) -> Column:
    """F20 inverse: the classes whose bit is set."""
    arr = _class_array(classes)
    return F.transform(
        F.filter(F.arrays_zip(arr.alias("c"), col_(bits).alias("b")), lambda z: z["b"] == 1), lambda z: z["c"]
    )


def threshold_labels(probs, threshold: float = 0.8) -> Column:
    """labels whose probability >= threshold; ``probs`` is array<struct<lang, prob>>."""
    return F.transform(F.filter(col_(probs), lambda x: x["prob"] >= threshold), lambda x: x["lang"])


def topk_threshold_labels(ranked, k: int = 2, threshold: float = 0.8) -> Column:
    """among the k best (ranked array<struct<lang, prob>>), those >= threshold."""
    return threshold_labels(F.slice(col_(ranked), 1, k), threshold)


def map_pair_codes(c, name_to_code: dict) -> Column:
    """'A-B' -> [code(A), code(B)], miss -> 'unknown'."""
    m = map_literal(name_to_code)
    return F.transform(F.split(col_(c), "-"), lambda x: F.coalesce(F.element_at(m, x), F.lit("unknown")))


def round_pct(c, digits: int = 4) -> Column:
    """mean x 100 rounded."""
    return F.round(F.avg(col_(c)) * 100, digits)


def model_from_path(path_col) -> Column:
    """file name up to the first '_' is the model name."""
    name = F.element_at(F.split(col_(path_col), "/"), -1)
    return F.split(name, "_", 2).getItem(0)
