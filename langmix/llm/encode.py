"""Encoding whole texts with the tokenizers library inside Arrow functions."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than space and newline, as either the tokenizers or Python may see it.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")
#: Marks that close a word, and the end of the Latin letters whose case and class are beyond doubt.
MARKS, LATIN_END = ".,;:!?*#$%&|", "\u0130"
#: Byte-level vocabularies write bytes as characters: printable ones as they are, the others in order from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
#: Pieces that each worker remembers before it forgets those that the batch at hand lacks.
REMEMBERED = 450_000
#: Bytes of text that one call to the library gets.
CALL_BYTES = 1 << 20
_loaded: dict = {}


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a .json file, once for each worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def safe_split(text: str, most: int) -> list[str]:
    """Parts of about ``most`` characters that encode as the whole text does: a cut lies before a space or newline
    that follows a character which is no white space, where every pre-tokenizer of this kind begins a new token.
    A text without such a place stays whole."""
    if len(text) <= most:
        return [text]
    parts, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while at < len(text) and not (text[at] in " \n" and not text[at - 1].isspace()):
            at += 1
        parts.append(text[begin:at])
        begin = at
    parts.append(text[begin:])
    return parts


def encode_counts(tok, texts: Sequence[str], most: int = CALL_BYTES) -> np.ndarray:
    """Numbers of tokens. Texts are cut at safe places and dealt to calls of about ``most`` bytes, so a call's memory
    follows neither the number nor the length of the texts."""
    out = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def flush():
        nonlocal held
        got = tok.encode_batch_fast(parts, add_special_tokens=False)
        np.add.at(out, owners, [len(e) for e in got])
        parts.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in safe_split(text, most // 4):
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= most:
                flush()
    if parts:
        flush()
    return out


class PieceEncoder:
    """Ids of whole texts, piece by piece between safe places, each distinct piece encoded by the library once.

    Pieces are cut before spaces, and before newlines where those are kept; a text is read as if a newline came first,
    so a piece has a space before it unless it begins with a newline. Arrow cuts a batch and numbers its distinct
    pieces; those not met before are learned, and their ids lie one after the other in ``ids``, where the rows of
    ``begin`` and ``size`` find them. New pieces are encoded many at a time, joined by ``mark``, a text that always
    encodes to one known id. Texts with white space other than single spaces between words and newlines go to the
    library whole.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tok = load(path)
        self.drops_space = drops_space
        self.lead = "" if drops_space else " "
        self.mark = " \x01 " if drops_space else "\n"
        ids = self.tok.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else None
        self.first = [] if drops_space else ids  # what the newline before a text gives
        self.bare = Tokenizer(self.tok.model)  # takes words as the pre-tokenizer hands them on
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # piece -> row
        self.tails: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)  # row 0 has no ids
        self.size = np.zeros(1, np.int64)

    def _plain(self, text: str) -> bool:
        if ODD_SPACE.search(text):
            return False
        return self.drops_space or not ("  " in text or "\n " in text or " \n\n" in text or text.endswith(" \n"))

    def _whole(self, text: str) -> bytes:
        parts = safe_split(text, CALL_BYTES)
        return b"".join(np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False))

    def _stem(self, piece: str) -> str:
        """The piece without closing marks after a Latin letter, which are a token of their own, and in lower case
        where the vocabulary lowers; the piece itself where either is not certain."""
        stem = piece if piece.isalpha() else piece.rstrip(MARKS)
        if not stem or stem[-1] >= LATIN_END or not stem[-1].isalpha():
            return piece
        if self.drops_space and (stem.isascii() or max(stem) < LATIN_END):
            return stem.lower()
        return stem

    def _rows(self, ids: np.ndarray, sizes: np.ndarray, begin: np.ndarray | None = None) -> int:
        """Rows added for ``ids``, in order, or at ``begin`` among them; the first one's number."""
        first = len(self.size)
        begin = np.cumsum(sizes) - sizes if begin is None else begin
        self.begin = np.concatenate([self.begin, len(self.ids) + begin])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])
        return first

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, one after the other, and how many each has."""
        sizes = self.size[rows]
        return self.ids[np.repeat(self.begin[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes

    def _learn(self, pieces: list[str]) -> None:
        known, tails = self.known, self.tails
        stems = list(map(self._stem, pieces))
        self._encode_new([s for s in set(stems) if s not in known])
        closed, pairs = [], []
        for p, s in zip(pieces, stems):
            if len(s) < len(p):
                tail = p[len(s):]
                if tail not in tails:
                    ids = self.tok.encode(tail, add_special_tokens=False).ids
                    tails[tail] = self._rows(np.array(ids, np.uint32), np.array([len(ids)]))
                closed.append(p)
                pairs += (known[s], tails[tail])
            elif s is not p:
                known[p] = known[s]
        if closed:
            ids, sizes = self._gather(np.array(pairs))
            self._name(closed, ids, sizes.reshape(-1, 2).sum(axis=1))

    def _name(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, begin: np.ndarray | None = None) -> None:
        first = self._rows(ids, sizes, begin)
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def _encode_new(self, pieces: list[str]) -> None:
        """A run of Latin letters is one token of the pre-tokenizer, so it goes to the library's model at once, many
        with marks between them; other pieces go through the whole of the library, many in one text."""
        space = BYTE_CHARS[32] if self.lead else ""
        rest, names, words, after = [], [], [], []
        for p in pieces if self.mark_id is not None else ():
            first = not self.drops_space and p[:1] == "\n"  # a newline alone is a token by itself, and the mark
            word = p[1:] if first else p
            if word.isalpha() and (word.isascii() or max(word) < LATIN_END) and not (self.drops_space and word != word.lower()):
                names.append(p)
                after.append(first)
                word = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)  # ASCII letters stand for themselves
                words.append(word if first else space + word)
            else:
                rest.append(p)
        mark, parts, begins, sizes, base = BYTE_CHARS[ord(self.mark.strip(" "))], [], [], [], 0
        for i in range(0, len(words), 2_000):
            row = [mark] * (2 * len(words[i:i + 2_000]) + 1)
            row[1::2] = words[i:i + 2_000]
            got = self.bare.encode_batch_fast([row], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(got.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            begin = marks[:-1] + 1 - np.array(after[i:i + 2_000], np.int64)
            parts.append(ids)
            begins.append(base + begin)
            sizes.append(marks[1:] - begin)
            base += len(ids)
        if words:
            self._name(names, np.concatenate(parts), np.concatenate(sizes), np.concatenate(begins))
        rest, parts, sizes = self._encode_joined(rest if self.mark_id is not None else pieces)
        if rest:
            self._name(rest, np.concatenate(parts), np.concatenate(sizes).astype(np.int64))

    def _encode_joined(self, pieces: list[str]) -> tuple[list[str], list, list]:
        """The pieces in some order, and in that order their ids and how many each has, in parts."""
        bar = "\x01" if self.drops_space else "\n"
        easy = [p for p in pieces if p and bar not in p] if self.mark_id is not None else []
        names, parts, lengths, done = [], [], [], set()
        for i in range(0, len(easy), 2_000):
            part = easy[i:i + 2_000]
            joined = self.lead + (self.mark + self.lead).join(part) + self.mark
            ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            marks = ids == self.mark_id
            ends = np.flatnonzero(marks)
            if len(ends) != len(part):
                continue
            names += part
            parts.append(ids[~marks])
            lengths.append(np.diff(ends, prepend=-1) - 1)
            done.update(part)
        rest = [p for p in pieces if p not in done]
        alone = [p if p[:1] == "\n" else self.lead + p for p in rest]
        for p, e in zip(rest, self.tok.encode_batch_fast(alone, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            names.append(p)
            parts.append(ids)
            lengths.append([len(ids)])
        return names, parts, lengths

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of plain texts, the places of all pieces among them, and where each text's pieces begin."""
        rows = pa.array(texts, pa.large_string())
        if self.drops_space:
            rows = pa.compute.replace_substring(rows, "\n", " ")
        else:
            rows = pa.compute.replace_substring(rows, "\n", " \n")
            while pa.compute.any(pa.compute.match_substring(rows, "\n \n")).as_py():  # a run of newlines is one piece's
                rows = pa.compute.replace_substring(rows, "\n \n", "\n\n")
            rows = pa.compute.binary_join_element_wise(pa.scalar("\n", pa.large_string()), rows, pa.scalar("", pa.large_string()))
        lists = pa.compute.split_pattern(rows, " ")
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices), np.asarray(lists.offsets)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [self._plain(text) for text in texts]
        pieces, places, ends = self._cut([text if ok else "" for text, ok in zip(texts, plain)])
        if len(self.known) > REMEMBERED:
            # the batch at hand has most of the frequent pieces: they stay
            stay = [p for p in pieces if p in self.known]
            ids, sizes = self._gather(np.fromiter(map(self.known.__getitem__, stay), np.int64, len(stay)))
            self._forget()
            self._name(stay, ids, sizes)
        rows = list(map(self.known.get, pieces))
        new = [k for k, row in enumerate(rows) if row is None]
        if new:
            self._learn([pieces[k] for k in new])
            for k in new:
                rows[k] = self.known[pieces[k]]
        ids, sizes = self._gather(np.array(rows, np.int64)[places])
        ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
        data, skip = ids.tobytes(), len(self.first)
        spans = zip(((ends[:-1] + skip) * 4).tolist(), (ends[1:] * 4).tolist())
        return [data[a:b] if ok else self._whole(text) for text, ok, (a, b) in zip(texts, plain, spans)]


def encoder(path: str, drops_space: bool) -> PieceEncoder:
    key = (path, drops_space)
    if key not in _loaded:
        _loaded[key] = PieceEncoder(path, drops_space)
    return _loaded[key]


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of ``column`` each (a longer single value alone)."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(sizes):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]
