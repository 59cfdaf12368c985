"""Words, word hashes and window hashes of whole Arrow text columns.

Used inside ``mapInArrow`` tasks. A word is a maximal run of bytes other than space and 0x09-0x0D, so
splitting works on UTF-8 bytes; every function handles many documents at once with numpy.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the usual xor-shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null is empty.

    A longer text is a run of its own, so memory follows the longest text.
    """
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case; all else is unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each document's first word (one more entry than documents)."""
    n = len(data)
    inside = _INSIDE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial over random byte values."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(_MULTIPLIER, n), out=sums[1:])
    back = powers(pow(_MULTIPLIER, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start word (within the document) of each run of ``width`` words of one document."""
    counts = np.diff(first)
    document = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = (_MULTIPLIER * (2 * seed + 1)) & _MASK | 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * np.uint64(pow(base, k, 1 << 64))
    keep = np.flatnonzero(document[:n] == document[width - 1 :])
    return mix(total[keep] + np.uint64(seed)), document[keep], keep - first[document[keep]]


def pressed(values: np.ndarray) -> bytes:
    """The array's bytes, all lowest first, then all second ones ..., compressed: bytes that seldom vary then take little room."""
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpressed(data: pa.Buffer | bytes, n: int, kind: type) -> np.ndarray:
    """The ``n`` values that ``pressed`` made ``data`` of."""
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd") if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def trimmed() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task, which then gives free memory back: Python workers live on for other operators."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            trimmed()

    return run


def tidy_group(task: Callable[..., pa.Table]):
    """As ``tidy``, for a function of a group of rows, or of one of each of two tables."""
    if task.__code__.co_argcount == 2:

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return task(left, right)
            finally:
                trimmed()
    else:

        def run(rows: pa.Table) -> pa.Table:
            try:
                return task(rows)
            finally:
                trimmed()

    return run
