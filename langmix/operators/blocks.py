"""Rows as blocks of sparse features, and parameters that meet them by feature.

Models whose parameters are one vector for each feature (a hashed gram, a vocabulary row) are trained and applied
without the parameters ever being in one place. Rows are cut into blocks once; a block keeps its distinct features.
Parameters are kept in pages, a row for each range of features. ``pull`` joins the pages that the blocks ask for with
the table of parameters, so each block meets just the vectors it needs; ``push`` sums what the blocks give back by
page. A feature is met once for each block, whatever the number of its occurrences, and blocks are large, so what
moves follows the features more than their occurrences. The blocks themselves lie in buckets and do not move.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StructField, StructType

from langmix.functions.arrow import ragged, runs
from langmix.session import stored

#: Rows and feature occurrences of a block, and cells (features times width) that a task holds of the parameters.
BLOCK_ROWS, BLOCK_ENTRIES, BLOCK_CELLS = 50_000, 2_000_000, 1 << 23
#: Feature occurrences that a task works out at once, and cells of a page of parameters.
SLICE_ENTRIES, PAGE_CELLS = 400_000, 1 << 13


def hashed(grams: list[str] | list[bytes], buckets: int) -> np.ndarray:
    """The bucket of each gram: the first 32 bits of its md5, modulo ``buckets``."""
    heads = b"".join([hashlib.md5(g if isinstance(g, bytes) else g.encode("utf-8", "surrogatepass")).digest()[:4] for g in grams])
    return (np.frombuffer(heads, ">u4") % buckets).astype(np.int64)


#: Texts that md5 takes in at once, the most bytes of one that fits its single block, its constants and rotations.
MD5_TEXTS, MD5_BYTES = 1 << 14, 55
_MD5_K = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_MD5_S = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_MD5_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]

#: Of a text by its size: the bytes of the block that are its own, and those that md5 puts after them.
_MD5_OWN = np.where(np.arange(64) < np.arange(MD5_BYTES + 1)[:, None], 255, 0).astype(np.uint8)
_MD5_END = np.where(np.arange(64) == np.arange(MD5_BYTES + 1)[:, None], 128, 0).astype(np.uint8)
_MD5_END[:, 56:58] = np.arange(MD5_BYTES + 1)[:, None] * 8 >> np.array([0, 8]) & 255


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of padded blocks (16 by their number): all blocks go through a round together."""
    a, b, c, d = (np.full(words.shape[1], x) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _MD5_K[i]
        f += words[g]
        turned = f << np.uint32(_MD5_S[i])
        turned |= f >> np.uint32(32 - _MD5_S[i])
        turned += b
        a, b, c, d = d, turned, b, c
    return (a + _MD5_START[0]).byteswap()


def hashed_slices(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    """:func:`hashed` of the slices of ``text`` (bytes) that begin at ``starts``."""
    out = np.empty(len(starts), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(64, np.uint8)), 64)
    short = np.flatnonzero(sizes <= MD5_BYTES)
    for i in range(0, len(short), MD5_TEXTS):
        own = short[i:i + MD5_TEXTS]
        block = windows[starts[own]]
        block &= _MD5_OWN[sizes[own]]
        block |= _MD5_END[sizes[own]]
        words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32, copy=False)
        out[own] = _md5_heads(words) % np.uint32(buckets) if buckets < 1 << 32 else _md5_heads(words)
    long = np.flatnonzero(sizes > MD5_BYTES)
    out[long] = hashed([text[a:a + k].tobytes() for a, k in zip(starts[long].tolist(), sizes[long].tolist())], buckets)
    return out


def packed(a: np.ndarray) -> bytes:
    """Numbers in the smallest type that holds them, compressed: type, bytes, body."""
    if a.dtype.kind in "iu":
        low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        a = a.astype(next((k for k, top in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32)) if low >= 0 and high < top), "<i8"))
    body = np.ascontiguousarray(a).tobytes()
    return a.dtype.str[1:].encode() + len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpacked(b) -> np.ndarray:
    b = memoryview(b)
    size = int.from_bytes(b[2:10], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(b[10:], size, asbytes=True) if size else b"", "<" + bytes(b[:2]).decode())


def unpacked_features(b) -> np.ndarray:
    """A block's features, which lie in order and are kept as what each has over the one before."""
    return np.cumsum(unpacked(b), dtype=np.int64)


def unique(f: np.ndarray) -> np.ndarray:
    f = np.sort(f)
    return f[runs(f)]


def _runs_of(words: pa.Array, sizes: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every gram of ``words`` (``sizes`` to a row) and of every run of 2 to ``n`` of a row's grams but
    its first, the constant one. With a space after each, runs are slices of one text."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    given = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    text = np.full(len(given) + len(words), ord(" "), np.uint8)
    text[np.arange(len(given)) + np.repeat(np.arange(len(words)), lengths)] = given
    starts = offsets[:-1] - offsets[0] + np.arange(len(words))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows, found = [row], [hashed_slices(text, starts, lengths, buckets)]
    for k in range(2, n + 1):
        begins = np.flatnonzero((place >= 1) & (place + k <= sizes[row]))
        ends = begins + k - 1
        rows.append(row[begins])
        found.append(hashed_slices(text, starts[begins], starts[ends] + lengths[ends] - starts[begins], buckets))
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Block:
    """A block in a task: rows by features, the features' names, and the rows' labels."""

    ids: pa.Array
    ends: np.ndarray  # of each row's entries
    at: np.ndarray  # place of each entry's feature in ``features``
    x: np.ndarray
    scale: np.ndarray | None  # by which a row's ``x`` is multiplied
    features: np.ndarray
    y: np.ndarray  # rows by classes, 0 or 1

    @classmethod
    def read(cls, table, r: int, classes: int) -> Block:
        """The block in row ``r`` of a table or batch of blocks."""
        got = {c: unpacked(table[c][r].as_buffer()) for c in ("sizes", "at", "x", "scale", "y")}
        ends = np.cumsum(got["sizes"], dtype=np.int64)
        at = np.cumsum(got["at"], dtype=np.int64)
        if len(at):
            at -= np.repeat(np.append(0, at)[ends - got["sizes"]], got["sizes"])  # a row's places begin anew
        ids = table["ids"][r].values
        return cls(ids, ends, at, got["x"].astype(float), got["scale"] if len(got["scale"]) else None, unpacked_features(table["features"][r].as_buffer()),
                   got["y"].reshape(len(ids), classes))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows times parameters: one column at a time, or some rows at a time."""
        out = np.zeros((len(self.ends), w.shape[1]))
        begins = np.append(0, self.ends[:-1])
        if w.shape[1] <= 64:
            some = np.flatnonzero(self.ends > begins)
            for j in range(w.shape[1] if len(some) else 0):
                out[some, j] = np.add.reduceat(self.x * np.ascontiguousarray(w[:, j])[self.at], begins[some])
        else:
            step = max(1, BLOCK_CELLS // max(1, w.shape[1] * int(self.sizes.max(initial=1))))
            for i in range(0, len(self.ends), step):
                a, b = begins[i], self.ends[min(i + step, len(self.ends)) - 1]
                some = np.arange(i, min(i + step, len(self.ends)))
                some = some[self.ends[some] > begins[some]]
                if len(some):
                    out[some] = np.add.reduceat(self.x[a:b, None] * w[self.at[a:b]], begins[some] - a, axis=0)
        return out if self.scale is None else out * self.scale[:, None]

    def back(self, r: np.ndarray) -> np.ndarray:
        """Features times ``r`` (rows by width): what each feature gets from the rows that hold it."""
        out = np.zeros((len(self.features), r.shape[1]))
        r = r if self.scale is None else r * self.scale[:, None]
        if r.shape[1] <= 64:
            for j in range(r.shape[1]):
                out[:, j] = np.bincount(self.at, self.x * np.repeat(r[:, j], self.sizes), len(out))
            return out
        order = np.argsort(self.at, kind="stable")
        at, x, rows = self.at[order], self.x[order], np.repeat(np.arange(len(self.ends)), self.sizes)[order]
        first = runs(at)
        step = max(1, BLOCK_CELLS // max(1, r.shape[1]))
        for j in range(0, len(first), 4_096):
            own = first[j:j + 4_096]
            a, b = own[0], first[j + 4_096] if j + 4_096 < len(first) else len(at)
            if b - a <= step:
                out[at[own]] = np.add.reduceat(x[a:b, None] * r[rows[a:b]], own - a, axis=0)
            else:  # few features with many rows each
                for k, c in enumerate(own.tolist()):
                    d = own[k + 1] if k + 1 < len(own) else b
                    for e in range(c, d, step):
                        out[at[c]] += x[e:min(e + step, d)] @ r[rows[e:min(e + step, d)]]
        return out


class Blocks:
    """Rows cut into blocks. ``table``: a row for each block; ``asks``: ``(block, at, f)``; ``most``: features that all
    blocks have together at most, where that is known."""

    def __init__(self, table: DataFrame, classes: list[str], id_type, most: int | None = None):
        self.table, self.classes, self.id_type, self.most, self.sent = table, classes, id_type, most, []

    @staticmethod
    def cut(rows: DataFrame, id_col: str, classes: list[str], width: int, grams: Column | None = None, labels: Column | None = None,
            buckets: int = 1 << 18, features: Column | None = None, n: int = 1) -> Blocks:
        """``grams``: an array of strings for each row, hashed here and weighted by their share of the row's grams, with
        ``n`` over 1 together with the runs of 2 to ``n`` of them that leave out the first; or ``features``: an array of
        ``struct<f: long, x: double>`` as it is. ``labels``: an array of class names; those that are not among
        ``classes`` are left out. ``width``: numbers to a feature, which bounds a block's features."""
        none = F.array().cast("array<string>")
        given = features if features is not None else F.lit(None).cast("array<struct<f: long, x: double>>")
        frame = rows.select(F.col(id_col).alias("id"), F.coalesce(grams, none).alias("grams") if grams is not None else none.alias("grams"),
                            given.alias("features"), F.coalesce(labels, none).alias("labels") if labels is not None else none.alias("labels"))
        id_type = frame.schema["id"].dataType
        by_hash = features is None
        parts = ("sizes", "at", "x", "scale", "features", "y")
        schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)), *(StructField(c, BinaryType()) for c in parts)])
        most = max(1, BLOCK_CELLS // max(1, width))
        place = {c: i for i, c in enumerate(classes)}
        block_rows, block_entries, slice_entries = BLOCK_ROWS, BLOCK_ENTRIES, max(1, SLICE_ENTRIES // n)

        def entries(batch):
            """Row, feature and number or weight of every entry, sorted by row and feature, and the rows' scale."""
            if by_hash:
                col = batch.column("grams")
                sizes = np.diff(np.asarray(col.offsets, np.int64))
                row, f = _runs_of(col.flatten(), sizes, n, buckets)
                key = np.sort(row * buckets + f)
                first = runs(key)
                scale = 1.0 / np.maximum(np.bincount(row, minlength=len(sizes)), 1)
                return *np.divmod(key[first], buckets), np.diff(np.append(first, len(key))), scale
            col = batch.column("features")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
            flat = col.flatten()
            f, x = flat.field("f").to_numpy(), flat.field("x").to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort([f, row])
            row, f, x = row[order], f[order], x[order]
            first = runs(row, f)
            return row[first], f[first], np.add.reduceat(x, first) if len(first) else x, None

        def pieces(batches):
            """Rows in order, some at a time: ids, ends, features, numbers, scale and labels; each within a block's bounds."""
            for batch in batches:
                col = batch.column("grams" if by_hash else "features")
                sizes = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64))
                i = 0
                while i < batch.num_rows:
                    j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + slice_entries, "right")))
                    part = batch.slice(i, j - i)
                    part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=part.schema.names)  # offsets from 0
                    i = j
                    row, f, x, scale = entries(part)
                    labels = part.column("labels").to_pylist()
                    hot = np.zeros((part.num_rows, len(classes)), np.int8)
                    for k, own in enumerate(labels):
                        for c in own:
                            if c in place:
                                hot[k, place[c]] = 1
                    ends = np.searchsorted(row, np.arange(part.num_rows), "right")
                    begin = 0
                    while begin < part.num_rows:
                        base = ends[begin - 1] if begin else 0
                        end = max(begin + 1, min(begin + block_rows, int(np.searchsorted(ends, base + min(block_entries, most), "right"))))
                        own = slice(base, ends[end - 1])
                        yield part.column("id").slice(begin, end - begin), ends[begin:end] - base, f[own], x[own], scale[begin:end] if by_hash else np.zeros(0), hot[begin:end]
                        begin = end

        def run(batches):
            from pyspark import TaskContext

            block = TaskContext.get().partitionId() << 32
            held, names = [], np.zeros(0, np.int64)

            def whole():
                f = np.concatenate([p[2] for p in held])
                sizes = np.concatenate([np.diff(p[1], prepend=0) for p in held])
                if len(names) and names[-1] - names[0] < 1 << 22:
                    table = np.zeros(names[-1] - names[0] + 1, np.int64)
                    table[names - names[0]] = np.arange(len(names))
                    at = table[f - names[0]]
                else:
                    at = np.searchsorted(names, f)
                step = np.diff(at, prepend=0)
                begins = (np.cumsum(sizes) - sizes)[sizes > 0]
                step[begins] = at[begins]
                cols = (sizes, step, np.concatenate([p[3] for p in held]), np.concatenate([p[4] for p in held]), np.diff(names, prepend=0), np.concatenate([p[5] for p in held]).ravel())
                ids = pa.concat_arrays([p[0] for p in held])
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                return pa.RecordBatch.from_arrays([pa.array([block]), ids, *(pa.array([packed(c)], pa.binary()) for c in cols)], names=schema.names)

            for piece in pieces(batches):
                own = unique(piece[2])
                more = unique(np.concatenate([names, own]))
                if held and (len(more) > most or sum(len(p[2]) for p in held) + len(piece[2]) > block_entries or sum(len(p[1]) for p in held) + len(piece[1]) > block_rows):
                    yield whole()
                    block += 1
                    held, more = [], own
                held.append(piece)
                names = more
            if held:
                yield whole()

        table = stored(frame.mapInArrow(run, schema), "blocks", "block")
        return Blocks(table, classes, table.schema["ids"].dataType.elementType, buckets if by_hash else None)

    def asks(self) -> DataFrame:
        """``(block, at, f)``: one row for each distinct feature of each block."""
        def run(batches):
            for batch in batches:
                for block, names in zip(batch.column("block").to_pylist(), batch.column("features").to_pylist()):
                    f = unpacked_features(names)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), block)), pa.array(np.arange(len(f), dtype=np.int32)), pa.array(f)], names=["block", "at", "f"])

        return self.table.select("block", "features").mapInArrow(run, "block long, at int, f long")

    def fits(self, width: int) -> bool:
        """Whether parameters of ``width`` for all features are within what a task may hold."""
        return self.most is not None and self.most * width <= BLOCK_CELLS

    def send(self, spark, held: Held):
        self.sent.append(spark.sparkContext.broadcast((held.f, held.w)))
        return self.sent[-1]

    def forget(self) -> None:
        """Parameters that were sent go: what was to come of them has been worked out."""
        for sent in self.sent:
            sent.destroy()
        self.sent = []

    def meet(self, pages: DataFrame | Held, width: int, fn: Callable, schema) -> DataFrame:
        """:meth:`pull`, or where all parameters are within a task's bound, every task gets them once and the blocks stay
        where they are."""
        if not self.fits(width):
            return self.pull(pages, width, fn, schema)
        classes, sent = len(self.classes), self.send(self.table.sparkSession, held_whole(pages, width))

        def run(batches):
            names, w = sent.value
            for batch in batches:
                for r in range(batch.num_rows):
                    block = Block.read(batch, r, classes)
                    yield fn(block, _own(names, w, block.features))

        return self.table.mapInArrow(run, schema)

    def gradients(self, pages: DataFrame | Held | None, width: int, fn: Callable, cells: int | None = None) -> DataFrame:
        """``(page, f, g)``: the sums of what ``fn(block, w)`` gives, features in order and ``cells`` (or ``width``) numbers
        to each. ``pages`` as for :meth:`meet`; None: ``w`` is None too. Where all parameters are within a task's bound, a
        task adds up what its blocks give, and there are but two tasks to a core: what moves does not follow the blocks."""
        cells, classes = cells or width, len(self.classes)
        if pages is not None and not self.fits(width):
            return push(self.pull(pages, width, lambda block, w: gradient_rows(*fn(block, w), width), GRADIENT), cells)
        sent = None if pages is None else self.send(self.table.sparkSession, held_whole(pages, width))
        room = max(1, BLOCK_CELLS // max(1, cells))

        def run(batches):
            names, w = sent.value if sent is not None else (None, None)
            f, g = np.zeros(0, np.int64), np.zeros((0, cells))
            for batch in batches:
                for r in range(batch.num_rows):
                    block = Block.read(batch, r, classes)
                    more, own = fn(block, None if sent is None else _own(names, w, block.features))
                    if len(f) and len(f) + len(more) > room and len(unique(np.concatenate([f, more]))) > room:
                        yield gradient_rows(f, g, width)
                        f, g = f[:0], g[:0]
                    f, g = added(f, g, more, own)
            if len(f):
                yield gradient_rows(f, g, width)

        table = self.table
        if self.fits(width):
            table = table.coalesce(2 * table.sparkSession.sparkContext.defaultParallelism)
        return push(table.mapInArrow(run, GRADIENT), cells)

    def pull(self, pages: DataFrame, width: int, fn: Callable, schema) -> DataFrame:
        """``fn(block, w)`` for every block, with ``w`` (features by ``width``) from ``pages(page, f, w)``, 0 where
        there is none; it yields record batches of ``schema``."""
        classes, size = len(self.classes), page_size(width)
        names = schema.names if isinstance(schema, StructType) else None

        def ask(batches):
            for batch in batches:
                for block, features in zip(batch.column("block").to_pylist(), batch.column("features").to_pylist()):
                    f = unpacked_features(features)
                    first = runs(f // size)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(first), block)), pa.array(f[first] // size), pa.array(first.astype(np.int32)),
                        pa.array([x.tobytes() for x in np.split(f, first[1:])] if len(f) else [], pa.binary())], names=["block", "page", "first", "asked"])

        def tell(batches):
            for batch in batches:
                out = []
                for asked, f, w in zip(*(batch.column(c).to_pylist() for c in ("asked", "f", "w"))):
                    asked, f = np.frombuffer(asked, np.int64), np.frombuffer(f, np.int64)
                    near = np.minimum(np.searchsorted(f, asked), len(f) - 1)
                    out.append(np.where((f[near] == asked)[:, None], np.frombuffer(w).reshape(-1, width)[near], 0.0).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("first"), pa.array(out, pa.binary())], names=["block", "first", "w"])

        asked = self.table.select("block", "features").mapInArrow(ask, "block long, page long, first int, asked binary")
        told = asked.join(pages.select("page", "f", "w"), "page").select("block", "first", "asked", "f", "w").mapInArrow(tell, "block long, first int, w binary")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for r in range(left.num_rows):
                block = Block.read(left, r, classes)
                w = np.zeros((len(block.features), width))
                for first, own in zip(right["first"], right["w"]):
                    own = np.frombuffer(own.as_buffer()).reshape(-1, width)
                    w[first.as_py():first.as_py() + len(own)] = own
                out.append(fn(block, w))
            return pa.Table.from_batches(out) if out else pa.table({n: [] for n in names})

        return self.table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def page_size(width: int) -> int:
    """Features of a page: the page of feature f is f // size."""
    return max(1, PAGE_CELLS // max(1, width))


GRADIENT = StructType([StructField("page", LongType()), StructField("f", BinaryType()), StructField("g", BinaryType())])


def gradient_rows(features: np.ndarray, g: np.ndarray, width: int) -> pa.RecordBatch:
    """A block's share of the sums, one row for each page of parameters of ``width``."""
    page = features // page_size(width)
    first = runs(page)
    ends = [*first[1:].tolist(), len(features)]
    return pa.RecordBatch.from_arrays([
        pa.array(page[first], pa.int64()), pa.array([features[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
        pa.array([np.ascontiguousarray(g[a:b]).tobytes() for a, b in zip(first, ends)], pa.binary())], names=GRADIENT.names)


@dataclass
class Held:
    """Parameters in one place, within a task's bound: names in order, and their numbers."""

    f: np.ndarray
    w: np.ndarray


def held_whole(pages: DataFrame | Held, width: int, column: str = "w") -> Held:
    """All of ``pages(page, f, <column>)``."""
    if isinstance(pages, Held):
        return pages
    rows = pages.select("f", column).collect()
    f = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["f"], np.int64) for r in rows)])
    w = np.concatenate([np.zeros((0, width)), *(np.frombuffer(r[column]).reshape(-1, width) for r in rows)])
    order = np.argsort(f, kind="stable")
    return Held(f[order], w[order])


def _own(names: np.ndarray, w: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The parameters of ``features``, 0 where there is none."""
    if not len(names):
        return np.zeros((len(features), w.shape[1]))
    near = np.minimum(np.searchsorted(names, features), len(names) - 1)
    own = w[near]
    own[names[near] != features] = 0.0
    return own


def added(f: np.ndarray, g: np.ndarray, more: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``g`` of the features ``f``, with ``own`` of the features ``more`` added to it. Both lie in order, each feature once."""
    if not len(f):
        return more, own.copy()
    at = np.minimum(np.searchsorted(f, more), len(f) - 1)
    if (f[at] != more).any():
        both = unique(np.concatenate([f, more]))
        wider = np.zeros((len(both), g.shape[1]))
        wider[np.searchsorted(both, f)] = g
        f, g, at = both, wider, np.searchsorted(both, more)
    g[at] += own
    return f, g


def push(rows: DataFrame, width: int) -> DataFrame:
    """``(page, f, g)``: the blocks' shares summed by feature. A task holds the sums of its pages, not the shares."""
    def run(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for page, f, g in zip(*(batch.column(c).to_pylist() for c in ("page", "f", "g"))):
                sums[page] = added(*sums.get(page, (np.zeros(0, np.int64), np.zeros((0, width)))), np.frombuffer(f, np.int64), np.frombuffer(g).reshape(-1, width))
        for page, (f, g) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([f.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], names=GRADIENT.names)

    return rows.repartition("page").mapInArrow(run, GRADIENT)


def with_vectors(blocks: Blocks, vectors: DataFrame, size: int) -> tuple[DataFrame, np.dtype]:
    """The blocks, each with the word vectors of its features (``e``) and whose they are (``of``). The vectors are
    frozen, so a block meets them once, however many passes are made over it."""
    given = vectors.schema["embedding"].dataType.elementType
    kind = np.dtype(np.float32 if isinstance(given, FloatType) else np.float64)
    own = F.col("embedding") if isinstance(given, FloatType) else F.col("embedding").cast("array<double>")
    asked = blocks.asks().join(vectors.select(F.col("id").cast("long").alias("f"), own.alias("e")), "f").select("block", "at", "e")
    names = blocks.table.columns
    schema = StructType([*blocks.table.schema.fields, StructField("of", BinaryType()), StructField("e", BinaryType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: [] for n in schema.names})
        e = np.zeros((0, size), kind)
        if right.num_rows:
            col = right["e"].combine_chunks()
            col = col if isinstance(col, pa.ListArray) else pa.concat_arrays(col.chunks)
            if (np.asarray(pc.fill_null(pc.list_value_length(col), -1)) != size).any() or col.flatten().null_count:
                raise ValueError("an embedding is null or of another length")
            e = col.flatten().to_numpy()
        more = [pa.array([right["at"].to_numpy().astype(np.int32).tobytes()], pa.binary()), pa.array([e.tobytes()], pa.binary())]
        return pa.Table.from_arrays([*(left[n] for n in names), *more], names=schema.names)

    return blocks.table.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema), kind


def vector_pages(vectors: DataFrame, size: int, width: int) -> tuple[DataFrame, np.dtype]:
    """``(page, own, e, bad)``: the ids ``own`` of ``vectors(id, embedding)`` in order by pages of parameters of ``width``,
    their vectors, and which of these are null or of another length."""
    given = vectors.schema["embedding"].dataType.elementType
    kind = np.dtype(np.float32 if isinstance(given, FloatType) else np.float64)
    e = F.col("embedding") if isinstance(given, FloatType) else F.col("embedding").cast("array<double>")
    f = F.col("id").cast("long")
    per = page_size(width)
    schema = StructType([StructField("page", LongType()), *(StructField(c, BinaryType()) for c in ("own", "e", "bad"))])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        col = rows["e"].chunk(0) if rows["e"].num_chunks else pa.array([], rows["e"].type)
        own = rows["f"].to_numpy()
        good = np.asarray(pc.fill_null(pc.list_value_length(col), -1)) == size
        all_of = np.zeros((len(own), size), kind)
        for i in np.flatnonzero(good) if col.flatten().null_count else []:
            good[i] = not col[int(i)].values.null_count
        some = col.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
        all_of[good] = some.reshape(-1, size)
        order = np.argsort(own, kind="stable")
        cols = (own[order], all_of[order], ~good[order])
        return pa.Table.from_arrays([pa.array([rows["page"][0].as_py()]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=schema.names)

    page = ((f - F.pmod(f, F.lit(per))) / per).cast("long")  # f // per
    pages = vectors.where(f.isNotNull()).select(page.alias("page"), f.alias("f"), e.alias("e"))
    return pages.groupBy("page").applyInArrow(run, schema), kind


def summed(rows: DataFrame) -> np.ndarray:
    """The sum of ``rows(g)``, arrays of one size that is bounded by the model: partitions first, then in a tree."""
    def run(batches):
        total = None
        for batch in batches:
            for g in batch.column("g").to_pylist():
                total = np.frombuffer(g).copy() if total is None else total + np.frombuffer(g)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def each(rows: DataFrame) -> DataFrame:
        return rows.select("g").mapInArrow(run, "g binary")

    row = each(each(each(rows).repartition(32)).repartition(1)).first()
    return np.frombuffer(row["g"]) if row else np.zeros(0)
