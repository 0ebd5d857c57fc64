"""Operator 5: exact deduplication through a cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import ascii_lower, without

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests of one bucket: a cuckoo filter of 16-bit fingerprints in front of the stored keys.

    A miss in the filter is certain, so a new digest costs no key comparison. A hit is verified against the stored
    keys (full digests), which also hold each digest's payload. When an insertion finds no place the table doubles
    and is filled again from the stored keys, so no digest is ever lost. Deleting removes the key and its print.
    """

    def __init__(self, capacity: int = 1024):
        self.keys: dict[bytes, list] = {}
        self.verified = self.resizes = 0
        self._clear(max(2, 1 << (max(1, capacity * 10 // (SLOTS * 9)) - 1).bit_length()))

    def _clear(self, rows: int) -> None:
        self.rows = rows
        self.table = [[0] * SLOTS for _ in range(rows)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & (self.rows - 1)
        return print_, one, self._other(one, print_)

    def _other(self, at: int, print_: int) -> int:
        return at ^ ((print_ * 0x5BD1E995) & (self.rows - 1))

    def maybe(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        return print_ in self.table[one] or print_ in self.table[two]

    def get(self, digest: bytes) -> list | None:
        """The payload of a live digest: filter first, then the stored key."""
        if not self.maybe(digest):
            return None
        self.verified += 1
        return self.keys.get(digest)

    def insert(self, digest: bytes, payload: list) -> None:
        if digest in self.keys:
            raise KeyError("digest is live already")
        self.keys[digest] = payload
        if not self._put(digest):
            self._grow()

    def delete(self, digest: bytes) -> list:
        payload = self.keys.pop(digest)
        print_, one, two = self._places(digest)
        for at in (one, two):
            if print_ in self.table[at]:
                self.table[at][self.table[at].index(print_)] = 0
                break
        return payload

    def _put(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        for at in (one, two):
            if 0 in self.table[at]:
                self.table[at][self.table[at].index(0)] = print_
                return True
        at = two
        for kick in range(MAX_KICKS):
            slot = (kick + print_) % SLOTS
            print_, self.table[at][slot] = self.table[at][slot], print_
            at = self._other(at, print_)
            if 0 in self.table[at]:
                self.table[at][self.table[at].index(0)] = print_
                return True
        return False

    def _grow(self) -> None:
        """More copies of one print than two rows can hold need a wider row, not more rows: after three doublings
        in a row without success the rows get more slots."""
        rows = self.rows
        for tries in range(1, 64):
            self.resizes += 1
            if tries <= 3:
                self._clear(rows << tries)
            else:
                self._clear(rows << 3)
                self.table = [[0] * (SLOTS * tries) for _ in range(self.rows)]
            if all(map(self._put, self.keys)):
                return
        raise RuntimeError("cuckoo filter cannot place its keys")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest)``: SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch: however many copies a group has, a batch sends it once."""
    for batch in batches:
        t = pa.table(batch).group_by("digest").aggregate([("id", "max"), ("digest", "count")])
        out = pa.table({"digest": t["digest"], "top": t["id_max"], "n": t["digest_count"]}).combine_chunks()
        yield from out.to_batches()


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, top, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "top", "n"))):
            live = index.get(digest)
            if live is None:
                index.insert(digest, [top, n])
            else:
                live[0] = top if live[0] is None else live[0] if top is None else max(live[0], top)
                live[1] += n
    keys = list(index.keys.items())
    for i in range(0, len(keys), 10_000):
        part = keys[i:i + 10_000]
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()),
            pa.array([v[1] for _, v in part], pa.int64())], names=["digest", "top", "n"])


def digest_index(digests: DataFrame) -> DataFrame:
    """``(digest, top, n)`` of all live digests: the largest id and the number of rows.

    Rows are combined within each Arrow batch before the shuffle, so a digest that a third of all rows share sends
    one row for each batch. Digests are dealt by hash; each task keeps the index of its own share alone.
    """
    combined = digests.mapInArrow(_combine, "digest binary, top long, n long")
    return combined.repartition("digest").mapInArrow(_index, "digest binary, top long, n long")


def update_index(index: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """A stored index with documents added (``id, digest``) and digests removed (``digest``): removals come first.

    Each share of the digests is loaded into a cuckoo index, deletions and insertions run through it, and its live
    keys are returned. Removing an unknown digest does nothing."""
    rows = (
        index.select("digest", "top", "n", F.lit(0).alias("step"))
        .unionByName(remove.select("digest", F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("step")).distinct())
        .unionByName(add.mapInArrow(_combine, "digest binary, top long, n long").withColumn("step", F.lit(2)))
    )

    def run(batches):
        live = CuckooIndex()
        for batch in batches:
            for digest, top, n, step in zip(*(batch.column(c).to_pylist() for c in ("digest", "top", "n", "step"))):
                held = live.get(digest)
                if step == 1:
                    if held is not None:
                        live.delete(digest)
                elif held is None:
                    live.insert(digest, [top, n])
                else:
                    held[0] = max((x for x in (held[0], top) if x is not None), default=None)
                    held[1] += n
        keys = list(live.keys.items())
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in keys], pa.binary()), pa.array([v[0] for _, v in keys], pa.int64()),
            pa.array([v[1] for _, v in keys], pa.int64())], names=["digest", "top", "n"])

    return rows.repartition("digest").sortWithinPartitions("step").mapInArrow(run, "digest binary, top long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns and ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (these replace input columns of
    that name). Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id
    stays.

    Null texts count as empty and form a group with empty texts. Repeated rows with one id share their fate: each
    counts in ``group_size`` and all are marked alike. A null id stays only in a group without any other id. An
    empty table gives an empty table.
    """
    names = ("keep_id", "group_size", "kept", "text_sha256")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    groups = digest_index(digest_rows(docs, id_col, text_col))
    rows = docs.select(*without(docs, *names), F.unhex(F.sha2(text, 256)).alias("__digest"))
    joined = rows.join(groups.select(F.col("digest").alias("__digest"), F.col("top").alias("__top"), F.col("n").alias("__n")), "__digest")
    return joined.select(
        *without(docs, *names), F.col("__top").alias("keep_id"), F.col("__n").alias("group_size"),
        F.col(id_col).cast("long").eqNullSafe(F.col("__top")).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"))
