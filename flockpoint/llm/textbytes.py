"""Word and byte views of whole Arrow text columns as numpy arrays, for use inside tasks.

A column of texts becomes one byte buffer in which every text is followed by a newline, so a
word never runs over the end of its text. All helpers work on that buffer at once; nothing
is done per word in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that a task looks at together; one longer text still comes whole.
BLOCK_BYTES = 1 << 20

#: The white space that separates words, space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """While it lasts, Spark hands texts to Python ``rows`` at a time at most: texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory to the system, so that a worker does not keep one stage's arrays through the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``limit`` bytes of the column ``text``."""
    try:
        yield from _blocks(batches, text, limit)
    finally:
        give_back()


def _blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(_offsets(batch.column(text)))
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)


class Texts:
    """``data``: all bytes, a newline after each text; text i is ``data[starts[i]:ends[i]]``.

    A null text is empty.
    """

    def __init__(self, column: pa.Array):
        column = column.fill_null("")
        offsets = _offsets(column)
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(column)
        self.data = np.insert(raw, offsets[1:], 10)
        self.starts = offsets[:-1] + np.arange(n)
        self.ends = offsets[1:] + np.arange(n)
        self.n = n

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z in lower case."""
        return _LOWER[self.data]


class Words:
    """Words of a ``Texts`` block: word j is ``data[start[j]:end[j]]``, text i has ``bounds[i]:bounds[i+1]``."""

    def __init__(self, texts: Texts):
        inside = ~_SPACE[texts.data]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.bounds = np.searchsorted(self.start, np.append(texts.starts, len(texts.data)))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, BLOCK_BYTES + (1 << 16))
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _powers, _inverses


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``; equal bytes have equal hashes wherever they stand."""
    powers, inverses = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverses[start])


def count_in(positions: np.ndarray, texts: Texts) -> np.ndarray:
    """How many of the sorted byte positions fall into each text."""
    return np.diff(np.searchsorted(positions, np.append(texts.starts, len(texts.data))))


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i+1]]``; an empty range gives 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.float64) if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
