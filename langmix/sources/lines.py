"""Places of rows in files, and records of several lines, read in parallel.

A scan is cut into byte ranges ("splits") by a setting of the session. A row's place, ``(file, start of its split,
running number)``, orders rows as they stand in their files however the files are cut; its rank does not depend on
the cut at all. Records that span lines are put together within each split; what a split begins and ends with is a
fragment, and the few fragments (two for a split at most) are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langmix.operators.ranking import global_rank
from langmix.session import stored

#: Whether a split's rows are a fragment that continues the record before (HEAD), a whole record, or an open one (TAIL).
HEAD, WHOLE, TAIL = 0, 1, 2
RECORDS = "file string, start long, kind int, seq long, lines array<string>"


def with_place(scan: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a scan (rows may have been dropped, changed or exploded since) with their place in the files."""
    return scan.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                          F.monotonically_increasing_id().alias("seq")))


def number_rows(rows: DataFrame, name: str = "row", place: str = "place") -> DataFrame:
    """``place`` replaced by the row's number from 0, files in order of their names. The same files give the same
    numbers whatever the splits."""
    ranked = global_rank(rows, [F.col(f"{place}.file"), F.col(f"{place}.start"), F.col(f"{place}.seq")], name)
    return ranked.withColumn(name, F.col(name) - 1).drop(place)


def positional_join(left: DataFrame, right: DataFrame, place: str = "place", how: str = "inner") -> DataFrame:
    """The n-th row of one set of files beside the n-th of another, by row numbers of both."""
    return number_rows(left, "row", place).join(number_rows(right, "row", place), "row", how)


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[list[str]]]]:
    """``(file, start, state, lists of lines)`` of each split in a task, in order; its lines must be used up first."""
    rest: list = []
    source = iter(batches)

    def parts(key) -> Iterator[list[str]]:
        while True:
            if not rest:
                batch = next(source, None)
                if batch is None:
                    return
                if batch.num_rows:
                    rest.append(batch)
                continue
            batch = rest.pop()
            keys = _keys(batch)
            n = next((i for i, k in enumerate(keys) if k != key), len(keys))
            if n < len(keys):
                rest.append(batch.slice(n))
            if n:
                yield batch.column("value").slice(0, n).to_pylist()
            if n < len(keys):
                return

    while True:
        while not rest:
            batch = next(source, None)
            if batch is None:
                return
            if batch.num_rows:
                rest.append(batch)
        key = _keys(rest[-1].slice(0, 1))[0]
        state = rest[-1].column("state")[0].as_py()
        yield key[0], key[1], state, parts(key)


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _records(lines: DataFrame, cut: Callable) -> DataFrame:
    """Records ``(place, lines)`` of lines ``(file, start, state, value)``. ``cut(state, lists of lines)`` yields
    ``(kind, lines)``: a HEAD first (it may be empty), whole records, and a TAIL if a record begins and is open at
    the end. Without a TAIL the HEAD is the whole split, and the record before goes on behind it."""
    def run(batches):
        for file, start, state, parts in _splits(batches):
            held: list[tuple] = []
            for seq, (kind, own) in enumerate(cut(state, parts)):
                held.append((kind, seq, own))
                if len(held) == 2_000:
                    yield _batch(file, start, held)
                    held = []
            if held:
                yield _batch(file, start, held)

    found = stored(lines.select("file", "start", "state", "value").mapInArrow(run, RECORDS), "records")
    place = F.struct("file", "start", "seq").alias("place")
    ends = found.where(F.col("kind") != WHOLE)
    # two rows for a split at most
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = ends.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = owned.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "seq", "lines"))).alias("parts"))
    first = F.col("parts")[0]
    joined = joined.select(F.struct("file", first["start"].alias("start"), first["seq"].alias("seq")).alias("place"),
                           F.flatten(F.transform("parts", lambda p: p["lines"])).alias("lines"))
    return found.where(F.col("kind") == WHOLE).select(place, "lines").unionByName(joined).where(F.size("lines") > 0)


def _batch(file: str, start: int, held: list[tuple]) -> pa.RecordBatch:
    kind, seq, own = zip(*held)
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(kind, pa.int32()), pa.array(seq, pa.int64()),
                                       pa.array(own, pa.list_(pa.string()))], names=["file", "start", "kind", "seq", "lines"])


def blank_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(place, lines)``: blocks of stripped lines between lines that are empty once stripped (LF or CRLF). A file of
    one block is cut like any other; a block of any length is put together from its splits' parts."""
    def cut(_, parts):
        own, kind = [], HEAD
        for lines in parts:
            for line in map(str.strip, lines):
                if line:
                    own.append(line)
                elif own or kind == HEAD:
                    yield kind if kind == HEAD else WHOLE, own
                    own, kind = [], TAIL
        if own or kind == HEAD:
            yield kind, own
        else:
            yield TAIL, []

    return _records(_lines(spark, path).withColumn("state", F.lit(0)), cut)


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(place, lines)``: the lines of each record of a delimited file whose quoted fields may hold line breaks.

    A line is inside a quoted field if an odd number of quote marks stands before it in its file (a doubled one counts
    twice). Each split counts its marks; running sums over the splits, one row each, say in which state every split
    begins; then each finds the lines that begin a record by itself."""
    def count(batches):
        for file, start, _, parts in _splits(batches):
            marks = sum(line.count(quote) for lines in parts for line in lines)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([marks], pa.int64())], names=["file", "start", "marks"])

    lines = _lines(spark, path)
    # a split can be read by one task only, so there is one row for each
    sums = stored(lines.withColumn("state", F.lit(0)).mapInArrow(count, "file string, start long, marks long"), "quote-marks")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = stored(sums.withColumn("state", (F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2).cast("int")).drop("marks"), "quote-states")

    def cut(state, parts):
        own, kind, inside = [], HEAD, bool(state)
        for lines in parts:
            odd = np.fromiter((line.count(quote) % 2 for line in lines), bool, len(lines))
            for line, flips in zip(lines, odd.tolist()):
                if not inside:
                    yield kind if kind == HEAD else WHOLE, own
                    own, kind = [], TAIL
                own.append(line)
                inside ^= flips
        if kind == HEAD:
            yield HEAD, own
        elif inside:
            yield TAIL, own
        else:
            yield WHOLE, own
            yield TAIL, []

    # one row for each split: 100 TB in splits of 128 MB are 800,000 rows. Lines stay where and as they are read
    return _records(lines.join(F.broadcast(states), ["file", "start"]), cut)
