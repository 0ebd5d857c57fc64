"""Operator 9: pack token sequences by vector bin packing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.encode import by_bytes, encoder, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Sequences that one task can number.
NUMBERS = 1 << 36


class Packer:
    """Open pieces of one task, and the sequence being filled.

    A piece is a vector (tokens, one segment, loss-bearing tokens). The open piece whose vector, scaled by the
    limits, has the largest dot product with the room left is placed next; if none fits whole and cutting is
    allowed, the largest is cut to the room. Pieces wait in a pool of bounded size, so memory does not follow the
    input. A remainder that no piece can fill is closed at powers of two, which need no padding.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool, pool: int, first_id: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.max_tokens, self.max_segments, self.max_loss, self.cut, self.pool = max_tokens, max_segments, max_loss, cut, pool
        self.vec = np.zeros((0, 3))
        self.items: list[tuple] = []
        self.next_id = first_id
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes, loss: np.ndarray | None) -> None:
        """``ids``: four bytes each; ``loss``: which of them bear loss (None: all)."""
        n = len(ids) // 4
        sums = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        begin, new = 0, []
        while begin < n:
            end = self._reach(sums, begin, n, self.max_tokens, self.max_loss)
            if end == begin:
                raise ValueError("a token does not fit the limits")
            if end - begin == self.max_tokens:
                self._emit([(doc_id, ids, sums, begin, end, n)])
            else:
                new.append((doc_id, ids, sums, begin, end, n))
            begin = end
        if new:
            self._hold(new)
        while len(self.items) > self.pool:
            self._fill()

    @staticmethod
    def _reach(sums, begin: int, n: int, tokens: int, loss: int) -> int:
        """The farthest end of a piece from ``begin`` within both limits."""
        end = min(n, begin + tokens)
        if sums is None:
            return min(end, begin + loss)
        return min(end, int(np.searchsorted(sums, sums[begin] + loss, "right")) - 1)

    def _vector(self, item) -> list[float]:
        _, _, sums, begin, end, _ = item
        return [end - begin, 1, end - begin if sums is None else sums[end] - sums[begin]]

    def _hold(self, items: list[tuple]) -> None:
        self.items += items
        self.vec = np.vstack([self.vec, [self._vector(x) for x in items]])

    def _take(self, i: int) -> tuple:
        self.vec[i] = self.vec[-1]
        self.vec = self.vec[:-1]
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
        return item

    def _fill(self) -> None:
        room, placed = self.limits.copy(), []
        while self.items and room[0] > 0 and room[1] > 0:
            fits = (self.vec <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, (self.vec / self.limits) @ (room / self.limits), -1.0)
                item = self._take(int(score.argmax()))
            elif self.cut and len(self.items):
                i = int(self.vec[:, 0].argmax())
                doc_id, ids, sums, begin, end, n = self.items[i]
                at = self._reach(sums, begin, end, int(room[0]), int(room[2]))
                if at == begin:
                    break
                self._take(i)
                self._hold([(doc_id, ids, sums, at, end, n)])
                item = (doc_id, ids, sums, begin, at, n)
            else:
                break
            room -= self._vector(item)
            placed.append(item)
        self._emit(placed)

    def _emit(self, placed: list[tuple]) -> None:
        at = 0
        for item in placed:
            doc_id, ids, _, begin, end, n = item
            self.out.append((doc_id, begin, end - begin, zlib.crc32(memoryview(ids)[begin * 4:end * 4]), n, self.next_id, at, int(self._vector(item)[2])))
            at += end - begin
        self.next_id += 1

    def finish(self) -> None:
        while self.items:
            total = int(self.vec[:, 0].sum())
            if self.cut and total < self.max_tokens and self.max_segments >= len(self.items) and self.vec[:, 2].sum() <= self.max_loss:
                self._close(total)
            else:
                self._fill()

    def _close(self, total: int) -> None:
        """The last open pieces, dealt to sequences whose lengths are the powers of two that make up ``total``."""
        rest = list(reversed(self.items))
        self.items, self.vec = [], np.zeros((0, 3))
        for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
            placed = []
            while size:
                doc_id, ids, sums, begin, end, n = rest.pop()
                at = min(end, begin + size)
                placed.append((doc_id, ids, sums, begin, at, n))
                size -= at - begin
                if at < end:
                    rest.append((doc_id, ids, sums, at, end, n))
            self._emit(placed)

    def drain(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8
        cols = list(zip(*self.out)) or [()] * 8
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool = False, id_col: str = "doc_id", text_col: str = "text",
         loss_col: str | None = None, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None,
         cut: bool = True, pool: int = 2_000) -> DataFrame:
    """Encode whole texts, append ``end_id`` and place every id in exactly one piece of one sequence.

    Each task packs what it scans, in one pass and without a shuffle: a sequence's id is the number of the task and a
    running number, so a task that is run again on another executor gives the same rows. Besides ``max_tokens`` a
    sequence holds at most ``max_segments`` pieces and ``max_loss`` loss-bearing tokens (None: ``max_tokens``).
    ``loss_col``, an array of booleans for each text's characters, marks the text that bears loss (instruction data);
    null or absent: every token does. With ``cut`` false a piece is cut only where it exceeds a limit by itself.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens``. Null and empty texts
    are the end id alone; repeated rows are packed each; null ids stay null; an empty table gives no pieces. Other
    columns are not read.
    """
    loss_limit = max_tokens if max_loss is None else max_loss
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       (F.col(loss_col) if loss_col else F.lit(None).cast("array<boolean>")).alias("loss"))

    def run(batches):
        from pyspark import TaskContext

        enc, end = encoder(tokenizer, drops_space), np.uint32(end_id).tobytes()
        packer = Packer(max_tokens, max_segments, loss_limit, cut, pool, TaskContext.get().partitionId() * NUMBERS)
        for batch in by_bytes(batches, "text"):
            texts = texts_of(batch, "text")
            for doc_id, text, ids, loss in zip(batch.column("doc_id").to_pylist(), texts, enc.encode(texts), batch.column("loss").to_pylist()):
                packer.add(doc_id, ids + end, None if loss is None else _token_loss(enc.tok, text, loss))
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return rows.mapInArrow(run, PIECES)


def _token_loss(tok, text: str, loss: list) -> np.ndarray:
    """Whether each token, and the end id, bears loss: as its first character does; the end id as the last one."""
    marks = np.array([bool(x) for x in loss] or [False])
    starts = [a for a, _ in tok.encode(text, add_special_tokens=False).offsets]
    return np.concatenate([marks[np.minimum(starts, len(marks) - 1)] if starts else [], marks[-1:]]).astype(bool)
