"""Arrow helpers that the text operators share: slices of bounded size, word boundaries, digests of words and of runs of words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Odd multipliers of the two streams of digests, and the two steps of the mix.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, which gives what it no longer needs back to the system at its end: Spark keeps its workers, and what
    their allocators hold on to counts against the executor."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return go


def text_rows(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a string column and the n + 1 row offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return b"", np.zeros(len(column) + 1, np.int64)
    edge = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(data)[edge[0] : edge[-1]], edge - edge[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of rows of at most `most` bytes: first row, end row, their bytes, row offsets from 0."""
    data, edge = text_rows(column)
    row, n = 0, len(edge) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(edge, edge[row] + most, side="right")) - 1)
        yield row, end, bytes(data[edge[row] : edge[end]]), edge[row : end + 1] - edge[row]
        row = end


@lru_cache(8)
def _powers(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64."""
    out = []
    for m in (multiplier, pow(multiplier, -1, 1 << 64)):
        steps = np.full(size, m, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in MIXERS:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


#: Words of at most so many lanes of eight bytes are digested all at once.
LANES = 4
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_digests(data: bytes, starts: np.ndarray, ends: np.ndarray, streams: int = 2) -> np.ndarray:
    """A digest of 64 bits for each word data[start:end] in each of the streams (rows). Each lane of eight bytes is taken in
    by a mix that no two states share, so words of up to eight bytes and the same length never collide; longer words than
    LANES lanes get the halves of their XXH3."""
    padded = np.frombuffer(bytes(data) + bytes(8), np.uint8)
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = np.stack([_mixed(length.astype(np.uint64) * np.uint64(m)) for m in MULTIPLIERS[:streams]])
    live = np.flatnonzero((length > 0) & (length <= 8 * LANES))
    for k in range(LANES):
        value = lanes[starts[live] + 8 * k] & _MASKS[np.minimum(length[live] - 8 * k, 8)]
        for own, m in zip(out, MULTIPLIERS):
            own[live] = _mixed((own[live] ^ value) * np.uint64(m))
        live = live[length[live] > 8 * (k + 1)]
        if not live.size:
            break
    for k in np.flatnonzero(length > 8 * LANES).tolist():
        whole = xxhash.xxh3_128_intdigest(data[starts[k] : ends[k]])
        for j in range(streams):
            out[j, k] = whole >> 64 * j & (1 << 64) - 1
    return out


def _joined(a: np.ndarray, b: np.ndarray, stream: int) -> np.ndarray:
    return _mixed(a * np.uint64(MULTIPLIERS[stream]) + b)


def run_digests(words: np.ndarray, width: int, stream: int = 0) -> np.ndarray:
    """A digest of each run of `width` words from their digests, by doubling: runs of 1, 2, 4, ... words, mixed at each step, so
    that no pattern of two words cancels out as it would in a polynomial."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, words, 1
    while True:
        if width & size:
            part = power[done : done + n]
            out = part if out is None else _joined(out, part, stream)
            done += size
        if 2 * size > width:
            return out
        power = _joined(power[:-size], power[size:], stream)
        size *= 2


def span_digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, for buckets and features: a polynomial modulo 2 ** 64, mixed with the
    length. Spans of one made-up pattern can share it; what must not be taken for equal has word_digests and run_digests."""
    size = 1 << max(20, int(len(values)).bit_length())
    power, inverse = _powers(MULTIPLIERS[which], size)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return _mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(MIXERS[which]))


def word_spans(data: bytes, edge: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs of bytes that is_word holds, within one row), and the first word of each row (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    raw = np.frombuffer(data, np.uint8)
    inside[1:-1] = is_word[raw]
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    cut = edge[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts_here[cut] |= inside[cut + 1]
    ends_here[cut - 1] |= inside[cut]
    starts = np.flatnonzero(starts_here)
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, edge)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 truth values, false in the given closed ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes of words split at ASCII white space.
PLAIN_WORD = byte_class((0x20, 0x20), (0x09, 0x0D))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
