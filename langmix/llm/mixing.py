"""Operator 7: mix sources to target weights by temperature."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from langmix.llm.common import stored, without
from langmix.llm.encode import by_bytes, encoder, texts_of

#: Interior points tried by one job of the bisection: four halvings at once.
POINTS = 15
ROUNDS = 8


def word_count(text: Column) -> Column:
    """Words between ASCII white space: the measure of tokens where no count is given. Null counts none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def with_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", drops_space: bool = False) -> DataFrame:
    """All input columns and ``n_tokens`` (replaces a column of that name): the whole text's tokens, without special
    ones. Null and empty texts have none. Texts are encoded wherever the frame is read: store it before mixing."""
    rows = docs.select(*without(docs, "n_tokens"))
    schema = StructType([*rows.schema.fields, StructField("n_tokens", LongType())])

    def run(batches):
        enc = encoder(tokenizer, drops_space)
        for batch in by_bytes(batches, text_col):
            counts = [len(ids) // 4 for ids in enc.encode(texts_of(batch, text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, most epochs) of the mix at each exponent, from one aggregate over the shares."""
    aggs = []
    for k, a in enumerate(exponents):
        w = F.pow("p", F.lit(a))
        aggs += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log("p")).alias(f"l{k}"), F.max(F.pow("p", F.lit(a - 1))).alias(f"r{k}"),
                 F.min(F.pow("p", F.lit(a - 1))).alias(f"s{k}")]
    row = shares.agg(*aggs).first()
    return [(math.log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"], row[f"r{k}"], row[f"s{k}"], row[f"z{k}"]) for k, a in enumerate(exponents)]


def find_exponent(shares: DataFrame, target_entropy: float | None, max_epochs: float | None, budget_share: float | None) -> float:
    """The exponent in [0, 1] whose mix has ``target_entropy`` (a share of the largest, ln of the number of sources),
    raised where needed so that no source is read more than ``max_epochs`` times. Entropy and epochs both fall as
    the exponent rises, so both are found by bisection; each job tries several points. ``budget_share``: the budget
    over all tokens; None is the budget at which the source read least is read once."""
    n = shares.count()
    if n < 2:
        return 1.0
    want = None if target_entropy is None else target_entropy * math.log(n)

    def enough(m) -> bool:
        """Whether the mix need not be flatter (the exponent may rise)."""
        entropy, most, least, z = m
        if max_epochs is not None and (most / least if budget_share is None else budget_share * most / z) > max_epochs * (1 + 1e-9):
            return True
        return want is not None and entropy > want

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
        flat = [enough(m) for m in _moments(shares, points)]
        k = sum(flat)  # monotone: the first k points are still too flat
        low, high = ([low] + points)[k], (points + [high])[k]
    return high if enough(_moments(shares, [low])[0]) else low


def mixing_plan(docs: DataFrame, tokens: Column, source_col: str = "source", target_entropy: float | None = 0.97,
                max_epochs: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """One row for each source: tokens, share, weight, budget in tokens and epochs. Partial sums meet first, so a hot
    source costs no more than another. Sources without tokens get no weight and are read once."""
    sums = stored(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    some = sums.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    if total == 0:
        return sums.select("source", "tokens", "docs", *(F.lit(v).cast("double").alias(c) for c, v in (("share", 0), ("weight", 0), ("exponent", 1), ("epochs", 1))), F.lit(0).cast("long").alias("budget"))
    a = find_exponent(some, target_entropy, max_epochs, None if budget is None else budget / total)
    (_, _, least, z), = _moments(some, [a])
    size = total * z / least if budget is None else budget  # tokens of the whole mix
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    plan = sums.select("source", "tokens", "docs", (F.col("tokens") / F.lit(float(total))).alias("share"), weight.alias("weight"), F.lit(a).alias("exponent"))
    plan = plan.withColumn("budget", F.round(F.col("weight") * F.lit(float(size))).cast("long"))
    return plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(F.lit(1.0)))


def mix(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        target_entropy: float | None = 0.97, max_epochs: float | None = 2.0, budget: int | None = None,
        block_tokens: int = 1_000_000, seed: int = 17) -> DataFrame:
    """Repeat and cut sources to the weights of :func:`mixing_plan`: one row for each document and epoch.

    Each source is dealt by hash into blocks of about ``block_tokens``; an epoch is a permutation of its blocks (a new
    hash for each epoch). Whole epochs take every block. The last, partial epoch takes blocks in permuted order while
    they fit the budget, and of the block that crosses it the documents, in hash order, whose start lies within the
    budget. Only that block of each source is ranked. With ``budget`` None no source is read less than once.

    Adds ``mix_epoch`` (from 0), ``mix_block``, ``mix_place`` (a hash), ``mix_tokens`` and ``mix_weight`` (they replace
    input columns of that name); sort by (mix_epoch, mix_block, mix_place) to read the mix. Null sources are a source of their own; a null text has no
    tokens; documents without tokens are read once in each epoch they fall in. Rows with equal ids and texts share a
    place and are taken or left together. One source keeps weight 1. An empty table gives an empty table.
    """
    names = ("mix_epoch", "mix_block", "mix_place", "mix_tokens", "mix_weight")
    kept = [c for c in docs.columns if c.lower() not in names]
    count = tokens if tokens is not None else word_count(F.col(text_col))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"),
                       F.col(source_col).alias("source"), F.coalesce(count, F.lit(0)).cast("long").alias("n"))
    plan = mixing_plan(base, F.col("n"), "source", target_entropy, max_epochs, budget)
    # whole epochs, and the tokens of the partial one
    plan = plan.withColumn("full", F.floor("epochs").cast("int")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(F.lit(0)))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long"))
    plan = stored(plan.select(F.col("source").alias("__source"), "full", "rest", "blocks", "weight"), "mix-plan")

    rows = base.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left")
    place = lambda e: F.xxhash64(F.lit(seed), e, F.col("id"), F.col("mark"))
    block = lambda h, n: F.pmod(F.shiftrightunsigned(h, 16), n)
    partial = rows.select("__source", "rest", "blocks", "n", place(F.col("full")).alias("h")).where("rest > 0")
    partial = partial.withColumn("b", block(F.col("h"), F.col("blocks")))
    sums = partial.groupBy("__source", "rest", "b").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("__source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    crossing = sums.where("start < rest and start + n >= rest").select(
        F.col("__source").alias("s"), F.col("b").alias("cross"), (F.col("rest") - F.col("start")).alias("room"))
    # hashes of the crossing block alone, in order: the last that starts within the room is the cut
    inside = partial.join(crossing, F.col("__source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("cross")))
    same = inside.groupBy("s", "cross", "room", "h").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cuts = same.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0))).where("start < room").groupBy("s", "cross").agg(F.max("h").alias("cut"))
    cuts = stored(cuts, "mix-cuts")

    rows = rows.join(cuts, F.col("__source").eqNullSafe(F.col("s")), "left")
    h = place(F.col("full"))
    b = block(h, F.col("blocks"))
    extra = (F.col("rest") > 0) & ((b < F.col("cross")) | ((b == F.col("cross")) & (h <= F.col("cut"))))
    times = F.col("full") + F.when(F.coalesce(extra, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    dealt = rows.withColumn("e", F.explode(F.filter(F.sequence(F.lit(0), times), lambda e: e < times)))
    return dealt.select("row.*", F.col("e").alias("mix_epoch"), block(place(F.col("e")), F.col("blocks")).alias("mix_block"),
                        place(F.col("e")).alias("mix_place"), F.col("n").alias("mix_tokens"), F.col("weight").alias("mix_weight"))
