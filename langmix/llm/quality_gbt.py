"""Operator 10: quality rules by gradient-boosted trees over document statistics."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from langmix.llm.common import BLANKS, blank_words, without
from langmix.llm.encode import by_bytes, texts_of
from langmix.llm.quality_knn import labelled_sample

SYMBOLS = "#*$%&|<>"
RUNS = re.compile(r"([!?.,#*$%&|<>_=~+-])\1")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature names and the sign in which the score may move as each rises: -1 falls, 1 rises, 0 free.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "same_word_share": -1,
            "run_share": -1, "upper_share": -1, "digit_share": 0, "distinct_share": 0, "line_words": 0, "long_words": 0}


def _repeat_words(words: list[str]) -> tuple[int, int]:
    """Words that stand in a 3-word window found twice or more, and the number of distinct words."""
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(known)
    if len(at) < 4:
        return 0, n
    pair = at[:-1] * n + at[1:]
    if n > 1 << 20:  # keeps three ids within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * n + at[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(at), bool)
    for k in range(3):
        cover[k:k + len(hit)] |= hit
    return int(cover.sum()), n


def text_statistics(text: str) -> tuple[list[int], list[float]]:
    """The five base counts of a whole text, and its features."""
    words = blank_words(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dups = len(lines) - len(set(lines))
    repeats, distinct = _repeat_words(words)
    c, w = max(chars, 1), max(n, 1)
    upper = sum(map(str.isupper, words))
    return [n, chars, symbols, dups, repeats], [
        float(np.log1p(n)), chars / w, symbols / c, dups / max(len(lines), 1), repeats / w, sum(map(operator.eq, words, words[1:])) / w,
        len(RUNS.findall(text)) / w, upper / w, sum(map(text.count, "0123456789")) / c, distinct / w, n / max(len(lines), 1),
        sum(len(x) > 25 for x in words) / w]


class BoostedTrees:
    """Trees of one depth as arrays: node ``i`` of a tree sends a row to ``2 i + 1`` or, above its threshold, to
    ``2 i + 2``; the last level holds the leaves. All rows walk all trees level by level in numpy."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature = np.zeros((0, 2 ** depth - 1), np.int32)
        self.threshold = np.zeros((0, 2 ** depth - 1))
        self.leaf = np.zeros((0, 2 ** depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2 ** self.depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, signs: Sequence[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
          least: float = 5.0, ridge: float = 1.0) -> BoostedTrees:
    """Second-order boosting of the logistic loss on binned features.

    A split on a constrained feature is taken only if its two leaves lie in the allowed order; their middle then
    bounds everything below, so the whole model is monotone in that feature. Without both labels there are no trees
    and the score is the share of label 1, or 1 without any row."""
    share = float(y.mean()) if len(y) else 1.0
    model = BoostedTrees(depth, float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))))
    if not 0 < share < 1:
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), model.base)
    forest = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(2 ** depth - 1, np.int32), np.full(2 ** depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            best = {}
            for f, sign in enumerate(signs):
                width = len(cuts[f]) + 1
                if width < 2:
                    continue
                at = (node - first) * width + binned[:, f]
                g = np.bincount(at, grad, count * width).reshape(count, width).cumsum(1)
                h = np.bincount(at, hess, count * width).reshape(count, width).cumsum(1)
                gl, hl, gs, hs = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gr, hr = gs - gl, hs - hl
                lo = np.array([low[first + k] for k in range(count)])[:, None]
                hi = np.array([high[first + k] for k in range(count)])[:, None]
                vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
                gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - gs ** 2 / (hs + ridge)
                gain[(hl < least) | (hr < least) | (sign * (vr - vl) < 0)] = 0
                k = gain.argmax(1)
                for i in range(count):
                    if gain[i, k[i]] > max(1e-6, best.get(i, (0,))[0]):
                        best[i] = gain[i, k[i]], f, k[i], vl[i, k[i]], vr[i, k[i]], sign
            for i in range(count):
                a, left, right = first + i, 2 * (first + i) + 1, 2 * (first + i) + 2
                low[left] = low[right] = low[a]
                high[left] = high[right] = high[a]
                if i in best:
                    _, feature[a], k, vl, vr, sign = best[i]
                    threshold[a] = cuts[feature[a]][k]
                    if sign:
                        middle = (vl + vr) / 2
                        (high if sign > 0 else low)[left] = middle
                        (low if sign > 0 else high)[right] = middle
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        first, count = 2 ** depth - 1, 2 ** depth
        g, h = np.bincount(node - first, grad, count), np.bincount(node - first, hess, count)
        leaf = rate * np.clip(-g / (h + ridge), [low[first + i] for i in range(count)], [high[first + i] for i in range(count)])
        margin += leaf[node - first]
        forest.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.array(c) for c in zip(*forest))
    return model


def fit(docs: DataFrame, labels: DataFrame, bound: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> BoostedTrees:
    """Train on the features of at most ``bound`` labelled rows (a hundred bytes each come to the driver)."""
    names = list(FEATURES)

    def run(batches):
        for batch in by_bytes(batches, "text"):
            rows = np.array([text_statistics(t)[1] for t in texts_of(batch, "text")]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("quality"), *(pa.array(c) for c in rows.T)], names=["id", "quality", *names])

    schema = "id long, quality int, " + ", ".join(f"{n} double" for n in names)
    got = labelled_sample(docs, labels, bound, id_col, text_col).mapInArrow(run, schema).toArrow().sort_by("id")
    x = np.column_stack([got[n].to_numpy() for n in names]) if got.num_rows else np.zeros((0, len(names)))
    return train(x, (got["quality"].to_numpy() > 0).astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, model: BoostedTrees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """All input columns and the base counts, ``base_failed``, ``score``, ``kept`` (they replace input columns of that
    name). A text fails the base with under 50 words or with over half its words in repeated 3-word windows; what
    passes is kept if the trees give it ``threshold`` or more.

    Statistics and scores of whole texts are worked out in the scan's own task, without a shuffle. Null and empty
    texts have no words and fail. Repeated rows are judged alike. An empty table gives an empty table.
    """
    rows = docs.select(*without(docs, *BASE, "base_failed", "score", "kept"))
    schema = StructType([*rows.schema.fields, *(StructField(n, LongType()) for n in BASE), StructField("base_failed", BooleanType()),
                         StructField("score", DoubleType()), StructField("kept", BooleanType())])

    def run(batches):
        for batch in by_bytes(batches, text_col):
            both = [text_statistics(t) for t in texts_of(batch, text_col)]
            base = np.array([b for b, _ in both], np.int64).reshape(-1, len(BASE))
            score = model.scores(np.array([f for _, f in both]).reshape(-1, len(FEATURES)))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score),
                                              pa.array(~failed & (score >= threshold))], names=schema.names)

    return rows.mapInArrow(run, schema)
