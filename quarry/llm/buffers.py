"""Whole text columns as flat byte buffers, and the hashes built on them.

The operators that look at every word or byte work on the UTF-8 bytes of an
Arrow batch at once: one ``uint8`` array plus row offsets, in slices of whole
rows of about ``SLICE`` bytes, so memory follows the slice (or the longest
single text), never the partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled by one round of array operations.
SLICE = 1 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

#: Bytes that are white space between words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (finaliser of splitmix64) on ``uint64``."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: One random 64-bit value for each byte.
BYTE64 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(_BASE, -1, 1 << 64)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]

    def forget(self) -> None:
        """Back to what slices need."""
        self.up, self.down = self.up[:SLICE].copy(), self.down[:SLICE].copy()


_powers = _Powers()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true ``member`` bytes that cross no row: (starts, ends, row)."""
    n = len(member)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    cut = offsets[:-1][np.diff(offsets) > 0]
    before[cut] = False
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def range_hash(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function that hashes any byte ranges [start, end) of ``data`` to 64 bits."""
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE64[data] * up[:-1], out=sums[1:])
    return lambda start, end: mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each white-space word, its row)."""
    start, end, row = spans(~SPACE[data], offsets)
    return range_hash(data)(start, end) if len(start) else np.zeros(0, np.uint64), row


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` that gives its memory back at its end: workers outlive their tasks,
    and what one stage has freed would stand beside the next one's."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def tidied_groups(run: Callable[..., pa.Table]):
    """The same for a function of a group, or of two that meet."""
    def called(*tables):
        try:
            return run(*tables)
        finally:
            give_back()

    # Spark counts the arguments
    return (lambda table: called(table)) if run.__code__.co_argcount == 1 else (lambda left, right: called(left, right))


#: Called at the end of a task: what modules keep between batches.
AT_END: list[Callable[[], None]] = [_powers.forget]


def give_back() -> None:
    """Drops what is kept for the next batch; what this worker has freed goes back to
    the system, where the C library can do that."""
    for forget in AT_END:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField],
                   fn: Callable[[pa.Array, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns ``fields`` that ``fn`` makes from the text column and the batch.

    Columns of ``df`` that carry one of the new names are replaced.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    source = "__text" if text_col in names else text_col
    if text_col in names:
        df = df.withColumn(source, F.col(text_col))
        kept.append(source)
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    out = T.StructType([*[f for f in df.schema.fields if f.name != "__text"], *fields])
    carried = [c for c in kept if c != "__text"]

    def run(batches):
        for batch in batches:
            made = fn(batch.column(batch.schema.get_field_index(source)), batch)
            old = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*old, *made], names=[*carried, *names])

    return df.mapInArrow(tidied(run), out)


