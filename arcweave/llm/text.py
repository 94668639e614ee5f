"""Vectorised word and shingle kernels over Arrow string columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  White space bytes never occur
inside a UTF-8 sequence, so words are cut on bytes without decoding.  Words
hash to 64 bits by a polynomial over a random byte table, finished by a
multiply-xorshift mixer; prefix sums over at most ``CHUNK_BYTES`` give the hash of
any byte range, and a word that they cut is put together from its parts.
Equal words always get equal hashes; two different ones collide with
probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_HASH = _rng.integers(1, 2**64, size=256, dtype=np.uint64)
_SLOT_HASH = _rng.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once; one longer text is handled alone, and whole.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch of texts, where the session has not chosen a number itself.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_powers: list[np.ndarray] = []


def bounded_batches(spark) -> None:
    """Bound the bytes of Arrow batches of whole texts, unless the session has a bound of its own.

    Both sides of the Python boundary hold a batch twice, so this bounds what each
    task needs outside the heap.  Results are lazy, so the bound stays until
    :func:`default_batches`; the number of rows of a batch is never touched.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def default_batches(spark) -> None:
    """Take back what :func:`bounded_batches` set, once the results have been written."""
    if spark.conf.get(_BATCH_KEY, None) == str(BATCH_BYTES):
        spark.conf.unset(_BATCH_KEY)


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 1
    if not _powers or len(_powers[0]) < size:
        _powers[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
            for b in (_BASE, _BASE_INVERSE)
        ]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column (null: empty) into chunks: first row, end row, bytes, offsets."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a chunk: ``doc`` (row within the chunk), byte ``start`` and ``end``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        if not len(data):
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.bounds = np.zeros(len(offsets), np.int64)
            return
        white = WHITE[data]
        filled = offsets[:-1] < offsets[1:]
        before = np.empty(len(data), bool)
        before[0], before[1:] = True, white[:-1]
        before[offsets[:-1][filled]] = True
        after = np.empty(len(data), bool)
        after[-1], after[:-1] = True, white[1:]
        after[offsets[1:][filled] - 1] = True
        self.start = np.flatnonzero(before & ~white)
        self.end = np.flatnonzero(after & ~white) + 1
        #: Index of each row's first word; one more entry ends the last row.
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self, lower: bool = True) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, inverse = _power_tables()
        out = np.zeros(len(self.start), np.uint64)
        for base in range(0, len(self.data), CHUNK_BYTES):
            part = self.data[base : base + CHUNK_BYTES]
            lo, hi = np.searchsorted(self.end, base, "right"), np.searchsorted(self.start, base + len(part))
            if lo == hi:
                continue
            values = _BYTE_HASH[LOWER[part] if lower else part]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values * power[: len(values)], out=total[1:])
            start, end = np.maximum(self.start[lo:hi] - base, 0), np.minimum(self.end[lo:hi] - base, len(part))
            sums = (total[end] - total[start]) * inverse[start]
            if self.start[lo] < base:
                # The rest of a word that began before.
                sums[:1] *= np.uint64(pow(int(_BASE), base - int(self.start[lo]), 2**64))
            out[lo:hi] += sums
        return mix(out)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``k``-word shingle and each row's bounds in that array.

    A row with 1 to k-1 words has its whole sequence as its one shingle; a row
    without words has none.
    """
    counts = np.diff(words.bounds)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        total[: n - j] += hashes[j:] * _SLOT_HASH[j]
    first = words.bounds[:-1]
    at = np.repeat(first, sizes) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    out = total[at]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        m = counts[row]
        part = hashes[first[row] : first[row] + m]
        # The length's own term keeps apart sequences of different lengths; sums wrap.
        out[bounds[row]] = np.append(part * _SLOT_HASH[:m], _SLOT_HASH[k + m]).sum(dtype=np.uint64)
    return mix(out), bounds
