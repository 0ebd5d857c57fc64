"""Arrow batches inside tasks: slices of bounded size and ragged arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices that hold about ``most`` bytes of a text column each; a longer single value stands alone."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of rows with equal keys begins, for ``np.add.reduceat`` and the like."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    changes = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(np.append(True, changes))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] ... starts[i] + sizes[i] - 1`` of all i, one after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
