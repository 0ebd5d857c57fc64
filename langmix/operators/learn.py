"""Trainable classifiers over blocks of rows.

* word n-gram classifier (M3): whitespace tokens -> 1..n word n-grams, hashed
  -> softmax regression. fastText's ``dim`` and hierarchical softmax are left
  out; the sweep axes are n-gram order and regularisation instead.
* multi-label (M7): hashed tweet tokens -> all labels' sigmoids at once.
* multi-label over frozen word vectors (M8): an adapter (linear, ReLU, layer
  norm) on each vocabulary row, averaged over a text, then linear -> sigmoids.

Parameters are rows of a table, one for each feature, and are joined to the
rows of text in every step (:mod:`langmix.operators.blocks`); what the driver
holds follows neither buckets nor vocabulary. One step is one pass over the
rows. Steps start from the weights that the last ones left.

A row's features are shares of its grams, so they sum to 1, and a step moves a
feature's weights against the mean residual of the rows that hold it::

    w_f <- w_f - step * (sum_i x_if (p_i - y_i) / sum_i x_if + reg * w_f)

With features that sum to 1 the loss cannot rise for steps up to 2 (softmax)
or 4 (sigmoid), whatever the data, and the result does not depend on how rows
are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from langmix.functions.arrow import runs
from langmix.functions.text import tweet_tokens
from langmix.operators.blocks import SLICE_ENTRIES, Block, Blocks, Held, held_whole, page_size, summed, vector_pages
from langmix.session import fleeting, stored

DEFAULT_BUCKETS = 1 << 18
#: A gram that every row has; no token holds a newline.
ALWAYS = "\n"
#: The largest safe steps.
STEPS = {"softmax": 2.0, "sigmoid": 4.0}
PAGES = "page long, f binary, m binary, w binary"


def word_ngrams(text: Column, n: int) -> Column:
    """Whitespace tokens of the lower-cased text, all 2..n word n-grams, and the constant gram."""
    toks = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != "")
    # as the element of an array the tokens are worked out once, however many gram lengths use them
    return F.transform(F.array(toks), lambda t: F.concat(F.array(F.lit(ALWAYS)), t, *[_grams(t, k) for k in range(2, n + 1)]))[0]


def _grams(t: Column, k: int) -> Column:
    starts = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, k), " "))


def tweet_grams(text: Column) -> Column:
    """Tweet tokens and the constant gram."""
    return F.concat(F.array(F.lit(ALWAYS)), F.coalesce(tweet_tokens(text), F.array().cast("array<string>")))


def classes_of(rows: DataFrame, labels: Column) -> list[str]:
    """The distinct labels: a small dimension."""
    got = rows.select(F.explode(labels).alias("c")).where("c is not null").distinct()
    return sorted(r["c"] for r in got.collect())


def _probabilities(s: np.ndarray, kind: str) -> np.ndarray:
    """``s``: rows by configurations by classes."""
    if kind == "sigmoid":
        return 1 / (1 + np.exp(-s))
    e = np.exp(s - s.max(axis=2, keepdims=True)) if s.shape[2] else s
    return e / e.sum(axis=2, keepdims=True) if s.shape[2] else s


@dataclass
class LinearModel:
    """Pages ``(page, f, m, w)`` of features, their mass in the training rows, and their numbers, classes by configurations;
    within a task's bound (:meth:`Blocks.fits`) ``mass`` and ``held`` have them instead."""

    kind: str  # softmax | sigmoid
    classes: list[str]
    regs: list[float]  # of each configuration
    table: DataFrame | None
    steps: int = 0
    mass: Held | None = None
    held: Held | None = None

    @property
    def pages(self) -> DataFrame:
        if self.table is None:
            f, m, w = self.held.f, self.mass.w, self.held.w
            first = runs(f // page_size(self.width))
            rows = [(int(f[a]) // page_size(self.width), *(bytearray(x[a:b].tobytes()) for x in (f, m, w))) for a, b in zip(first, [*first[1:], len(f)])]
            self.table = SparkSession.active().createDataFrame(rows, PAGES)
        return self.table

    @property
    def weights(self) -> DataFrame:
        """``(f, m, w)``: a row for each feature."""
        width = self.width

        def run(batches):
            for batch in batches:
                for f, m, w in zip(*(batch.column(c).to_pylist() for c in ("f", "m", "w"))):
                    rows = np.frombuffer(w).reshape(-1, width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(f, np.int64)), pa.array(np.frombuffer(m)), pa.array([x.tobytes() for x in rows], pa.binary())], names=["f", "m", "w"])

        return self.pages.mapInArrow(run, "f long, m double, w binary")

    @property
    def width(self) -> int:
        return max(1, len(self.classes) * len(self.regs))

    def shape(self, s: np.ndarray) -> np.ndarray:
        return s[:, :len(self.classes) * len(self.regs)].reshape(len(s), len(self.regs), len(self.classes))


def start(blocks: Blocks, kind: str, regs: Sequence[float] = (0.0,)) -> LinearModel:
    """A model without steps: every feature of the blocks, with its mass and weights of 0."""
    model = LinearModel(kind, blocks.classes, list(regs), None)

    width = model.width

    def mass(block: Block, _) -> tuple[np.ndarray, np.ndarray]:
        return block.features, block.back(np.ones((len(block.ends), 1)))

    def first(batches):
        for batch in batches:
            zero = [bytes(len(m) * width) for m in batch.column("g").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("f"), batch.column("g"), pa.array(zero, pa.binary())], names=["page", "f", "m", "w"])

    sums = blocks.gradients(None, width, mass, 1)
    if blocks.fits(width):
        model.mass = held_whole(sums, 1, "g")
        model.held = Held(model.mass.f, np.zeros((len(model.mass.f), width)))
    else:
        model.table = stored(sums.mapInArrow(first, PAGES), "linear-weights")
    return model


def descend(model: LinearModel, blocks: Blocks, steps: int, step: float | None = None) -> LinearModel:
    """The model after ``steps`` more passes over the blocks, from the weights it has."""
    size = STEPS[model.kind] if step is None else step
    kind, width, classes = model.kind, model.width, len(model.classes)
    reg = np.repeat(model.regs, classes) if classes else np.zeros(1)

    # weights that began at 0 and rows of one label: the classes' numbers add up to 0, so the last follows from the others
    follows = kind == "softmax" and classes > 1 and model.held is not None and bool(np.abs(model.held.w.reshape(-1, classes).sum(axis=1)).max(initial=0) < 1e-9)
    others = np.flatnonzero(np.arange(width) % max(1, classes) != classes - 1)

    def whole(some: np.ndarray) -> np.ndarray:
        some = some.reshape(len(some), -1, classes - 1)
        return np.concatenate([some, -some.sum(axis=2, keepdims=True)], axis=2).reshape(len(some), -1)

    def residuals(block: Block, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fewer = follows and bool((block.y.sum(axis=1) == 1).all())
        s = whole(block.times(w[:, others])) if fewer else block.times(w)
        p = _probabilities(model_shape(s), kind)
        r = (p - block.y[:, None, :]).reshape(len(s), -1)
        return block.features, whole(block.back(r[:, others])) if fewer else block.back(r)

    model_shape = LinearModel(kind, model.classes, model.regs, None).shape  # the closure holds no frame

    def moved(m: np.ndarray, w: np.ndarray, names, g: np.ndarray, own) -> np.ndarray:
        if not np.array_equal(own, names):  # the blocks that gave the weights their features are not these
            raise ValueError("weights and gradients have different features")
        return w - size * (g / m + reg * w)

    if model.held is not None:
        mass, held = model.mass, model.held
        for _ in range(steps if classes else 0):
            with fleeting(blocks.table.sparkSession):
                sums = held_whole(blocks.gradients(held, width, residuals), width, "g")
            blocks.forget()
            held = Held(held.f, moved(mass.w, held.w, held.f, sums.w, sums.f))
        return LinearModel(kind, model.classes, model.regs, None, model.steps + steps, mass, held)

    def update(batches):
        for batch in batches:
            out = []
            for f, m, w, names, g in zip(*(batch.column(c).to_pylist() for c in ("f", "m", "w", "names", "g"))):
                w, g = np.frombuffer(w).reshape(-1, width), np.frombuffer(g).reshape(-1, width)
                out.append(moved(np.frombuffer(m)[:, None], w, np.frombuffer(f, np.int64), g, np.frombuffer(names, np.int64)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page", "f", "m")), pa.array(out, pa.binary())], names=["page", "f", "m", "w"])

    pages = model.pages
    for _ in range(steps if classes else 0):
        with fleeting(blocks.table.sparkSession):
            sums = blocks.gradients(pages, width, residuals).withColumnRenamed("f", "names")
            pages = stored(pages.join(sums, "page").mapInArrow(update, PAGES), "linear-weights")
    return LinearModel(model.kind, model.classes, model.regs, pages, model.steps + steps)


def probabilities(model: LinearModel, blocks: Blocks, id_col: str, k: int | None = None) -> DataFrame:
    """``(id, config, preds)`` of every row: the ``k`` most probable classes (None: all), best first, ties by name.
    All classes come from one pass."""
    kind, classes = model.kind, model.classes
    shape = LinearModel(kind, classes, model.regs, None).shape
    pred = ArrayType(StructType([StructField("lang", StringType()), StructField("prob", DoubleType())]))
    schema = StructType([StructField(id_col, blocks.id_type), StructField("config", StringType()), StructField("preds", pred)])
    configs = [str(i) for i in range(len(model.regs))]

    def score(block: Block, w: np.ndarray) -> pa.RecordBatch:
        p = _probabilities(shape(block.times(w)), kind)
        order = np.argsort(-p, axis=2, kind="stable")[:, :, :k]
        best = np.take_along_axis(p, order, axis=2)
        preds = [[{"lang": classes[i], "prob": x} for i, x in zip(o, q)] for a, b in zip(order.tolist(), best.tolist()) for o, q in zip(a, b)]
        at = pa.array(np.repeat(np.arange(len(p)), len(configs)))
        return pa.RecordBatch.from_arrays([block.ids.take(at), pa.array(configs * len(p), pa.string()),
                                           pa.array(preds, pa.list_(pa.struct([("lang", pa.string()), ("prob", pa.float64())])))], names=schema.names)

    return blocks.meet(model.held or model.pages, model.width, score, schema)


# -- M3-M6 ----------------------------------------------------------------------------------------------------------


@dataclass
class WordNgramModel:
    """M3 with the detector interface (M1/M4): ``transform`` gives the top-k languages of whole texts."""

    linear: LinearModel
    n: int
    buckets: int

    def transform(self, df: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
        blocks = Blocks.cut(df, id_col, self.linear.classes, self.linear.width, word_ngrams(F.col(text_col), 1), buckets=self.buckets, n=self.n)
        preds = probabilities(self.linear, blocks, id_col, k)
        first = F.try_element_at("preds", F.lit(1))
        return preds.select(id_col, first["lang"].alias("pred_lang"), first["prob"].alias("pred_prob"), F.col("preds").alias("top_preds"))


def word_ngram_blocks(train: DataFrame, text_col: str, label_col: str, n: int, buckets: int, configs: int = 1) -> Blocks:
    """Training rows as blocks; rows without a label are left out."""
    rows = train.where(F.col(label_col).isNotNull())
    classes = classes_of(rows, F.array(label_col))
    return Blocks.cut(rows.withColumn("__none", F.lit(0)), "__none", classes, max(1, len(classes) * configs), word_ngrams(F.col(text_col), 1), F.array(label_col), buckets, n=n)


def fit_word_ngram(train: DataFrame, text_col: str, label_col: str, n: int = 2, buckets: int = DEFAULT_BUCKETS,
                   reg: float = 0.0, max_iter: int = 20) -> WordNgramModel:
    """M3: ``max_iter`` passes over the training rows."""
    blocks = word_ngram_blocks(train, text_col, label_col, n, buckets)
    return WordNgramModel(descend(start(blocks, "softmax", [reg]), blocks, max_iter), n, buckets)


def precision_at_1(pred: DataFrame, gold: str) -> float:
    """Share of all rows whose top label is right, in %; a row without a gold label is not right."""
    right = F.coalesce(F.col("pred_lang") == F.col(gold), F.lit(False))
    return pred.agg(F.avg(right.cast("double")) * 100).first()[0] or 0.0


class _Dev:
    """Dev rows as blocks, cut once, under their gold labels (an unknown one is empty)."""

    def __init__(self, dev: DataFrame, text_col: str, label_col: str, classes: list[str], n: int, buckets: int, configs: int):
        rows = dev.select(F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("gold"), F.col(text_col).alias("text"))
        self.blocks = Blocks.cut(rows, "gold", classes, max(1, len(classes) * configs), word_ngrams(F.col("text"), 1), buckets=buckets, n=n)

    def precision(self, model: LinearModel) -> dict[int, float]:
        """E16 of every configuration from one pass."""
        got = probabilities(model, self.blocks, "gold", 1).groupBy("config").agg(
            F.avg(F.coalesce(F.try_element_at("preds", F.lit(1))["lang"] == F.col("gold"), F.lit(False)).cast("double")) * 100)
        out = {int(c): p for c, p in got.collect()}
        self.blocks.forget()
        return out


def grid_sweep(train: DataFrame, dev: DataFrame, text_col: str, label_col: str, grid: list[dict], buckets: int = DEFAULT_BUCKETS) -> list[dict]:
    """M5: the configurations of one n-gram order and length of training are one fit with their numbers side by side,
    and one pass scores them all. Sorted by dev accuracy, then by configuration."""
    out = []
    for n, steps in sorted({(c.get("n", 2), c.get("max_iter", 20)) for c in grid}):
        own = [c for c in grid if (c.get("n", 2), c.get("max_iter", 20)) == (n, steps)]
        blocks = word_ngram_blocks(train, text_col, label_col, n, buckets, len(own))
        model = descend(start(blocks, "softmax", [c.get("reg", 0.0) for c in own]), blocks, steps)
        acc = _Dev(dev, text_col, label_col, model.classes, n, buckets, len(own)).precision(model)
        out += [{**c, "dev_accuracy": round(acc.get(i, 0.0), 4)} for i, c in enumerate(own)]
    return sorted(out, key=lambda r: (-r["dev_accuracy"], sorted((k, str(v)) for k, v in r.items())))


def fit_with_early_stop(train: DataFrame, dev: DataFrame, text_col: str, label_col: str, n: int = 2, block: int = 5,
                        total: int = 30, buckets: int = DEFAULT_BUCKETS) -> tuple[WordNgramModel, list[dict]]:
    """M6: train in blocks of passes, each from the weights the last left, until dev accuracy does not improve. The
    best model, and a line for each block (D8)."""
    rows = word_ngram_blocks(train, text_col, label_col, n, buckets)
    model = kept = start(rows, "softmax")
    held = _Dev(dev, text_col, label_col, model.classes, n, buckets, 1)
    best, log = 0.0, []
    while model.steps < total:
        model = descend(model, rows, min(block, total - model.steps))
        acc = held.precision(model).get(0, 0.0)
        improved = acc > best
        log.append({"max_iter": model.steps, "dev_accuracy": round(acc, 4), "improved": improved})
        if not improved:
            break
        best, kept = acc, model
    return WordNgramModel(kept, n, buckets), log


# -- M7, M9 ---------------------------------------------------------------------------------------------------------


def fit_multilabel(train: DataFrame, text_col: str, labels_col: str, classes: list[str], max_iter: int = 20, buckets: int = DEFAULT_BUCKETS) -> LinearModel:
    """M7: all labels' sigmoids in one fit over the hashed tweet tokens."""
    blocks = Blocks.cut(train.withColumn("__none", F.lit(0)), "__none", classes, max(1, len(classes)), tweet_grams(F.col(text_col)), F.col(labels_col), buckets)
    return descend(start(blocks, "sigmoid"), blocks, max_iter)


def chosen_labels(preds: str, threshold: float, top_k: int | None) -> Column:
    """M9: labels with p >= threshold (F21), among the ``top_k`` most probable if given (F22), sorted by name."""
    some = F.slice(preds, 1, top_k) if top_k else F.col(preds)
    return F.array_sort(F.transform(F.filter(some, lambda x: x["prob"] >= threshold), lambda x: x["lang"]))


def predict_multilabel(model: LinearModel, df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, top_k: int | None = None,
                       buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """M9 for M7: every row's labels, all classes in one pass."""
    blocks = Blocks.cut(df, id_col, model.classes, model.width, tweet_grams(F.col(text_col)), buckets=buckets)
    return probabilities(model, blocks, id_col).select(id_col, chosen_labels("preds", threshold, top_k).alias("predicted"))


# -- M8 -------------------------------------------------------------------------------------------------------------


@dataclass
class Adapter:
    """linear -> ReLU -> layer norm on a word vector, and the linear layer over a text's average: a few matrices of the
    vectors' size, whatever the vocabulary."""

    classes: list[str]
    a: np.ndarray  # (d, d)
    b: np.ndarray
    gain: np.ndarray
    shift: np.ndarray
    fc: np.ndarray  # (d, classes)
    bias: np.ndarray

    @classmethod
    def new(cls, classes: list[str], size: int, seed: int = 7) -> Adapter:
        rng = np.random.default_rng(seed)
        bound = 1 / max(size, 1) ** 0.5
        draw = lambda *s: rng.uniform(-bound, bound, s)
        return cls(classes, draw(size, size), draw(size), np.ones(size), np.zeros(size), draw(size, len(classes)), draw(len(classes)))

    def parts(self) -> list[np.ndarray]:
        return [self.a, self.b, self.gain, self.shift, self.fc, self.bias]

    def forward(self, e: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Adapted vectors, and what the way back needs."""
        z = e @ self.a + self.b
        r = np.maximum(z, 0)
        centred = r - r.mean(axis=1, keepdims=True)
        scale = 1 / np.sqrt((centred ** 2).mean(axis=1, keepdims=True) + 1e-5)
        unit = centred * scale
        return unit * self.gain + self.shift, (z, unit, scale)

    def backward(self, e: np.ndarray, kept: tuple, dh: np.ndarray) -> np.ndarray:
        """Gradients of ``a``, ``b``, ``gain`` and ``shift`` in one array, summed over vectors."""
        z, unit, scale = kept
        du = dh * self.gain
        dr = scale * (du - du.mean(axis=1, keepdims=True) - unit * (du * unit).mean(axis=1, keepdims=True))
        dz = dr * (z > 0)
        return np.concatenate([(e.T @ dz).ravel(), dz.sum(axis=0), (dh * unit).sum(axis=0), dh.sum(axis=0)])


#: Tokens with a vector that every task may hold.
HELD_TOKENS = 1 << 20


def known_tokens(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, vectors: DataFrame, *keep: str) -> DataFrame:
    """``(id, known, features, *keep)``: how many of a text's tokens have a vector, and each one's share of them. Where the
    tokens that have a vector are within a task's bound and no id comes twice, each text is worked out where it is read;
    else a token is counted once for a text before it meets the vocabulary, and what is gathered is one text's distinct
    tokens."""
    have = vocab.join(vectors.select("id"), "id").select("token", F.col("id").cast("long").alias("f"))
    times = have.groupBy("token", "f").agg(F.count(F.lit(1)).alias("times"))  # an id that comes twice counts twice
    held = times.limit(HELD_TOKENS + 1).toArrow()
    odd = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1))
    if held.num_rows > HELD_TOKENS or odd.limit(1).count():
        return _known_by_joins(df, id_col, text_col, have, keep)
    held = held.combine_chunks()
    held = held.set_column(0, "token", held["token"].cast("string"))
    sent = df.sparkSession.sparkContext.broadcast(held)
    rows = df.select(id_col, *keep, tweet_tokens(text_col).alias("__t"))
    fk = ArrayType(StructType([StructField("f", LongType()), StructField("x", DoubleType())]))
    schema = StructType([rows.schema[id_col], StructField("known", LongType()), StructField("features", fk), *(rows.schema[c] for c in keep)])

    def run(batches):
        for batch in batches:
            held = sent.value
            ids, times = held["f"].to_numpy(), held["times"].to_numpy()
            col = batch.column("__t")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
            coded = pc.dictionary_encode(col.flatten())
            met = pc.index_in(coded.dictionary.cast(pa.string()), value_set=held["token"].combine_chunks())
            met = np.asarray(pc.fill_null(met, -1), np.int64)
            code, ends = coded.indices.to_numpy(), np.cumsum(sizes)
            i = 0
            while i < batch.num_rows:
                base = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, base + SLICE_ENTRIES, "right")))
                row, which = np.repeat(np.arange(j - i), sizes[i:j]), met[code[base:ends[j - 1]]]
                key = np.sort(row[which >= 0] * len(ids) + which[which >= 0])
                first = runs(key)
                row, which = np.divmod(key[first], max(1, len(ids)))
                k = np.diff(np.append(first, len(key))) * times[which]
                known = np.bincount(row, k, j - i).astype(np.int64)
                own = pa.StructArray.from_arrays([pa.array(ids[which]), pa.array(k / known[row])], ["f", "x"])
                cuts = np.append(0, np.cumsum(np.bincount(row, minlength=j - i))).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(cuts, mask=np.append(known == 0, False)), own)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(known), features, *(part.column(c) for c in keep)], names=schema.names)
                i = j

    return rows.mapInArrow(run, schema)


def _known_by_joins(df: DataFrame, id_col: str, text_col: str, have: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    counts = df.select(id_col, F.explode(tweet_tokens(text_col)).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("k"))
    own = counts.join(have, "token").groupBy(id_col).agg(F.sum("k").alias("known"), F.collect_list(F.struct("f", "k")).alias("fk"))
    share = F.transform("fk", lambda x: F.struct(x["f"].cast("long").alias("f"), (x["k"] / F.col("known")).alias("x")))
    out = df.select(id_col).join(own, id_col, "left").select(id_col, F.coalesce("known", F.lit(0)).alias("known"),
                                                             F.when(F.col("known") > 0, share).alias("features"))
    return out.join(df.select(id_col, *keep), id_col) if keep else out


#: Vectors that go through the adapter at once.
ADAPTED = 8_192
#: Stand among the features for the last layer's bias, which every row has once, and for the loss, which none has.
LOSS, BIAS = -(1 << 62), -(1 << 62) + 1


def _with_bias(features: Column) -> Column:
    own = F.coalesce(features, F.array().cast("array<struct<f: long, x: double>>"))
    return F.concat(F.array(F.struct(F.lit(BIAS).cast("long").alias("f"), F.lit(1.0).alias("x"))), own)


def _last(own: np.ndarray) -> np.ndarray:
    """Of ids in order, the last one of each."""
    return np.append(own[1:] != own[:-1], np.ones(min(1, len(own)), bool))


def _class_pages(model: Adapter, vectors: DataFrame, kind: np.dtype, width: int) -> DataFrame:
    """``(page, f, w)``: what each word vector, through the adapter, adds to the classes of a text that is made of it, and
    the bias. Infinite where a vector is null or of another length."""
    size, classes = len(model.b), len(model.classes)

    def run(batches):
        for batch in batches:
            for page, own, e, bad in zip(*(batch.column(c).to_pylist() for c in ("page", "own", "e", "bad"))):
                own, bad = np.frombuffer(own, np.int64), np.frombuffer(bad, bool)
                e = np.frombuffer(e, kind).reshape(len(own), size)
                w = np.zeros((len(own), width))
                for i in range(0, len(own), ADAPTED):
                    w[i:i + ADAPTED, :classes] = model.forward(e[i:i + ADAPTED].astype(float))[0] @ model.fc
                w[bad] = np.inf
                last = _last(own)
                yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([own[last].tobytes()], pa.binary()), pa.array([w[last].tobytes()], pa.binary())], names=["page", "f", "w"])

    bias = np.zeros(width)
    bias[:classes] = model.bias
    row = vectors.sparkSession.range(1, numPartitions=1).select(
        F.lit(BIAS // page_size(width)).cast("long").alias("page"), F.lit(bytearray(np.int64(BIAS).tobytes())).alias("f"), F.lit(bytearray(bias.tobytes())).alias("w"))
    return vectors.mapInArrow(run, "page long, f binary, w binary").unionByName(row)


def _scores(block: Block, w: np.ndarray, classes: int) -> np.ndarray:
    if np.isposinf(w).any():
        raise ValueError("an embedding is null or of another length")
    return block.times(w)[:, :classes]


def _adapter_blocks(rows: DataFrame, id_col: str, classes: list[str], vectors: DataFrame, size: int, labels: Column | None = None):
    """Blocks of ``rows(features)``, the vectors in pages, their type and the width of a feature's numbers."""
    width = max(1, len(classes))
    blocks = Blocks.cut(rows, id_col, classes, width, labels=labels, features=_with_bias(F.col("features")))
    pages, kind = vector_pages(vectors, size, width)
    pages = stored(pages, "adapter-vectors")
    blocks.most = 2 + (pages.agg(F.sum(F.length("own"))).first()[0] or 0) // 8
    return blocks, pages, kind, width


def fit_adapter(rows: DataFrame, labels_col: str, classes: list[str], vectors: DataFrame, max_iter: int = 15, rate: float = 0.02) -> tuple[Adapter, list[float]]:
    """M8: ``rows(features, labels)`` of :func:`known_tokens` and ``vectors(id, embedding)``. The adapter works on each word
    vector by itself and the last layer on their mean, so a text's classes are the mean of what its words' vectors say
    of the classes: a pass takes the vectors through the adapter to a number for each class, the blocks meet these
    numbers (never the vectors) and give back what their loss says about them, and this goes back through the adapter.
    The matrices' gradients are summed in the tasks and then in a tree, and the driver takes one Adam step on matrices of
    the vectors' size. The model, and the mean loss before each step."""
    size = vectors.select(F.size("embedding").alias("d")).agg(F.max("d")).first()[0] or 0
    size = max(0, size)
    model = Adapter.new(classes, size)
    blocks, pages, kind, width = _adapter_blocks(rows.withColumn("__none", F.lit(0)), "__none", classes, vectors, size, F.col(labels_col))
    count = blocks.table.agg(F.sum(F.size("ids"))).first()[0] or 0
    many = len(classes)

    def residuals(block: Block, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = _scores(block, w, many)
        left = 1 / (1 + np.exp(-s)) - block.y
        g = np.zeros((1 + len(block.features), width))
        g[0, 0] = (np.maximum(s, 0) - s * block.y + np.log1p(np.exp(-np.abs(s)))).sum()
        g[1:, :many] = block.back(left)
        return np.append(LOSS, block.features), g

    first, second, losses = None, None, []
    for t in range(1, (max_iter if count else 0) + 1):
        now = Adapter(classes, *[x.copy() for x in model.parts()])

        def gradients(batches, now=now):
            inner, outer, ends = np.zeros(size * size + 3 * size), np.zeros((size, many)), np.zeros(many + 1)
            for batch in batches:
                for f, g, own, e, bad in zip(*(batch.column(c).to_pylist() for c in ("f", "g", "own", "e", "bad"))):
                    f, g = np.frombuffer(f, np.int64), np.frombuffer(g).reshape(-1, width)
                    ends[:-1] += g[f == BIAS, :many].sum(axis=0)
                    ends[-1] += g[f == LOSS, 0].sum()
                    if own is None:
                        continue
                    own = np.frombuffer(own, np.int64)
                    at = np.minimum(np.searchsorted(f, own), len(f) - 1)
                    asked = f[at] == own
                    last, at, e = _last(own)[asked], at[asked], np.frombuffer(e, kind).reshape(len(own), size)[asked]
                    for i in range(0, len(at), ADAPTED):
                        some, q = e[i:i + ADAPTED].astype(float), g[at[i:i + ADAPTED], :many]
                        h, kept = now.forward(some)
                        inner += now.backward(some, kept, q @ now.fc.T)
                        outer += (h * last[i:i + ADAPTED, None]).T @ q
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([inner, outer.ravel(), ends]).tobytes()], pa.binary())], names=["g"])

        with fleeting(pages.sparkSession):
            sums = blocks.gradients(_class_pages(now, pages, kind, width), width, residuals)
            total = summed(sums.join(pages, "page", "left").select("f", "g", "own", "e", "bad").mapInArrow(gradients, "g binary"))
        blocks.forget()
        losses.append(float(total[-1]) / count)
        g = total[:-1] / count
        first = 0.1 * g if first is None else 0.9 * first + 0.1 * g
        second = 0.001 * g * g if second is None else 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        at = 0
        for x in model.parts():
            x -= move[at:at + x.size].reshape(x.shape)
            at += x.size
    return model, losses


def predict_adapter(model: Adapter, rows: DataFrame, id_col: str, vectors: DataFrame, threshold: float = 0.8, top_k: int | None = 2) -> DataFrame:
    """M9 for M8: ``(id, predicted, preds)`` of ``rows(id, features)``."""
    classes, many = model.classes, len(model.classes)
    blocks, pages, kind, width = _adapter_blocks(rows, id_col, classes, vectors, len(model.b))
    pred = ArrayType(StructType([StructField("lang", StringType()), StructField("prob", DoubleType())]))
    schema = StructType([StructField(id_col, blocks.id_type), StructField("preds", pred)])

    def score(block: Block, w: np.ndarray) -> pa.RecordBatch:
        p = 1 / (1 + np.exp(-_scores(block, w, many)))
        order = np.argsort(-p, axis=1, kind="stable")
        preds = [[{"lang": classes[i], "prob": float(q[i])} for i in o] for o, q in zip(order.tolist(), p)]
        return pa.RecordBatch.from_arrays([block.ids, pa.array(preds, pa.list_(pa.struct([("lang", pa.string()), ("prob", pa.float64())])))], names=schema.names)

    out = blocks.meet(_class_pages(model, pages, kind, width), width, score, schema)
    return out.select(id_col, chosen_labels("preds", threshold, top_k).alias("predicted"), "preds")
