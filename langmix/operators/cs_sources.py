"""Code-switch sources: each spec bound to its reader and its split rule.

A source either is one set, cut 70/30 in a reproducible order, or comes in files by split, where the development files
join the test split before duplicates are dropped. ``load_source(...)`` gives
``(codeswitch_sentence, languages, dataset_source, split)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions.codes import map_pair
from langmix.operators.canon import CS_SPECS, canonicalise_cs
from langmix.operators.codeswitch import at_most_two_languages
from langmix.operators.corpus import split_by_rank
from langmix.sources import readers as R
from langmix.sources.lines import number_rows, with_place

Reader = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class CodeSwitchSource:
    spec: str  # a key of CS_SPECS
    read: Reader
    splits: tuple[str, ...] = ()  # file groups; none: one set, cut by ``fraction``
    readers: Mapping[str, Reader] = field(default_factory=dict)  # groups read in another way
    head: Mapping[str, int] = field(default_factory=dict)  # T3: first rows by split
    fraction: float = 0.7


def _placed(read: Reader) -> Reader:
    return lambda spark, path: with_place(read(spark, path))


def _csv(spark, path):
    return R.read_csv(spark, path, place=True)


def _tsv(*names: str, header: bool = False) -> Reader:
    return _placed(lambda spark, path: R.read_tsv(spark, path, list(names), header))


def _jsonl(schema: str) -> Reader:
    return _placed(lambda spark, path: spark.read.json(path, schema=schema))


def _lines(drop_blank: bool) -> Reader:
    return _placed(lambda spark, path: R.read_lines(spark, path, "", "", drop_blank).select("codeswitch_sentence"))


def _meta(spark, path):
    return with_place(R.read_meta_blocks(spark, path, "", "")).select("codeswitch_sentence", "place")


def _tagged(spark, path):
    return R.read_tagged_blocks(spark, path, ["AR", "EN"])[0].select("codeswitch_sentence", F.col("block").alias("place"))


_REVIEWS = _tsv("text", "category", header=True)
# --- fixed values: how each source is laid out ------------------------------
CS_SOURCES = {
    "basco": CodeSwitchSource("basco", _placed(R.read_nested_json)),
    "malayalam": CodeSwitchSource("malayalam", _REVIEWS, ("train", "dev", "test"), {"test": _csv}),
    "tamil": CodeSwitchSource("tamil", _REVIEWS, ("train", "dev", "test"), {"test": _csv}),
    "crocosum": CodeSwitchSource("crocosum", _jsonl("post_text string"), ("train", "dev", "test")),
    "ascend": CodeSwitchSource("ascend", _jsonl("transcription string, language string")),
    "hinge": CodeSwitchSource("hinge", _jsonl("`references` array<string>")),
    "semeval_hinglish": CodeSwitchSource("semeval_hinglish", _meta, ("train", "dev", "test")),
    "semeval_spanglish": CodeSwitchSource("semeval_spanglish", _meta, ("train", "dev", "test")),
    "turkish": CodeSwitchSource("turkish", _lines(False)),
    "tweetlid_pairs": CodeSwitchSource("tweetlid_pairs", _placed(R.read_tweet_pairs), ("train", "test")),
    "tongueswitcher": CodeSwitchSource("tongueswitcher", _jsonl("text string"), ("train", "test"), head={"train": 30_000, "test": 10_000}),
    "indonesian": CodeSwitchSource("indonesian", _csv),
    "msa_egyptian": CodeSwitchSource("msa_egyptian", _lines(True)),
    "egyptian_english": CodeSwitchSource("egyptian_english", _tsv("segment_id", "codeswitch_sentence"), ("train", "dev", "test")),
    "saudi": CodeSwitchSource("saudi", _csv),
    "arabizi": CodeSwitchSource("arabizi", _tagged),
}
# The Tamil sets drop duplicates of both splits; the spec alone does not say so.
_DEDUP = {"tamil"}
# ---------------------------------------------------------------------------


def _rows(df: DataFrame, source: CodeSwitchSource, head: int | None) -> DataFrame:
    spec = replace(CS_SPECS[source.spec], head=head)
    if source.spec in _DEDUP:
        spec = replace(spec, dedup=True)
    out = canonicalise_cs(df, spec, keep_order=True)
    if spec.label_col:
        out = out.where(at_most_two_languages("languages")).withColumn("languages", map_pair(F.col("languages")))
    return out


def load_source(spark: SparkSession, name: str, paths: Mapping[str, str] | str) -> DataFrame:
    """``paths``: one path, or one for each file group. Rows are numbered as they stand in the files (files in order of
    their names, groups in theirs), which gives "first" its meaning and every row an identity for the cut: both are
    the same however Spark splits the files."""
    source = CS_SOURCES[name]
    exploded = CS_SPECS[source.spec].explode
    ordered = not source.splits or source.head or CS_SPECS[source.spec].dedup or source.spec in _DEDUP

    def numbered(path: str, group: str) -> DataFrame:
        rows = source.readers.get(group, source.read)(spark, path)
        if not ordered:  # no cut, no first rows: nothing asks for a number
            return rows.drop("place").withColumn("ordinal", F.lit(0).cast("long"))
        if exploded:  # a number for each element of a cell
            rows = rows.select("place", F.posexplode(CS_SPECS[source.spec].sentence).alias("__i", "__x"))
            rows = rows.withColumn("place", F.struct("place.file", "place.start", F.struct("place.seq", "__i").alias("seq")))
            rows = rows.withColumn(CS_SPECS[source.spec].sentence, F.array("__x")).drop("__i", "__x")
        return number_rows(rows, "ordinal")

    if not source.splits:
        rows = _rows(numbered(paths, ""), source, None)
        return split_by_rank(rows, source.fraction, id_col="ordinal", tail="test").drop("ordinal")
    out = []
    for split, groups in (("train", ("train",)), ("test", tuple(g for g in source.splits if g != "train"))):
        frames = [numbered(paths[g], g).withColumn("ordinal", F.col("ordinal") + F.lit(k << 60)) for k, g in enumerate(groups)]
        rows = _rows(R.read_splits(frames), source, source.head.get(split))
        out.append(rows.withColumn("split", F.lit(split)).drop("ordinal"))
    return out[0].unionByName(out[1])
