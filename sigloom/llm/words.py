"""Words, hashes and shingles of a whole Arrow batch of texts at once.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D). All
of it works on the batch's own UTF-8 buffer, in segments of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
#: Bytes of text that are worked on at once.
SLICE = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
FACTORS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                    0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT, base % 2**64, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend([_powers(BASE), _powers(pow(BASE, -1, 2**64))])
    return _TABLES


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        i = 0
        while i < batch.num_rows:
            j = max(int(np.searchsorted(total, total[i] + most, "right")) - 1, i + 1)
            yield batch.slice(i, j - i)
            i = j
        del batch
        pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the number of words before each row (one more entry than rows)."""
    inside = ~SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    first = edges[edges < len(data)]
    opens[first] = inside[first]
    last = edges[edges > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, scrambled with its length."""
    power, inverse = _tables()
    codes = _LOWER if lower else _CODES
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SEGMENT, "right")), i)
        if j == i:  # one word longer than a segment
            total, shift = U64(0), 1
            for at in range(int(starts[i]), int(ends[i]), SEGMENT):
                part = codes[data[at : min(at + SEGMENT, ends[i])]]
                total = (np.array([total]) + (part * power[: len(part)]).sum(dtype=U64) * np.array([shift], U64))[0]
                shift = shift * pow(BASE, SEGMENT, 2**64) % 2**64
            out[i] = total
            i += 1
            continue
        low = starts[i]
        part = codes[data[low : ends[j - 1]]]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * power[: len(part)], dtype=U64, out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * inverse[a]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(BASE))


def windows(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a row, and the number of such runs before each row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(len(before), np.int64)
    acc = np.zeros(n, U64)
    for k in range(width):
        acc += hashes[k : k + n] * FACTORS[k]
    counts = np.maximum(np.diff(before) - width + 1, 0)
    ends = before[1:]
    whole = np.ones(n, bool)
    for k in range(1, width):  # runs that begin in the last words of a row reach into the next
        at = ends - k
        at = at[(at >= before[:-1]) & (at < n)]
        whole[at] = False
    return mix(acc[whole]), np.concatenate(([0], np.cumsum(counts)))


def shingle_sets(column: pa.Array, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row in ascending hash order, and their number before each row.

    A row with fewer words than ``width`` has its whole word sequence as its
    one shingle; a row without words has none.
    """
    data, offsets = text_buffer(column)
    starts, ends, before = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    runs, at = windows(hashes, before, width)
    words = np.diff(before)
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        value = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = words[short] > k
            value[has] += hashes[before[short[has]] + k] * FACTORS[k]
        value = mix(value + words[short].astype(U64) * U64(BASE))
        runs = np.insert(runs, at[short], value)
        at = at + np.concatenate(([0], np.cumsum((words > 0) & (words < width))))
    for i in np.flatnonzero(np.diff(at) > 1):
        runs[at[i] : at[i + 1]].sort()
    fresh = np.ones(len(runs), bool)
    fresh[1:] = runs[1:] != runs[:-1]
    heads = at[:-1][np.diff(at) > 0]
    fresh[heads] = True
    return runs[fresh], np.concatenate(([0], np.cumsum(fresh)))[at]
