"""Word positions and hashes of whole Arrow text columns, without a Python object per word."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The bytes that separate words.
SPACES = (0x20, *range(0x09, 0x0E))

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
BLOCK = 1 << 20


def _table(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_IS_SPACE = _table(SPACES)
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, name: str, most: int = 2 << 20):
    """Slices of a batch that hold about ``most`` bytes of text each, one row at least."""
    _, at = text_buffer(batch.column(name))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(at, at[row] + most, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of words before it (n + 1 numbers)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of every word, A-Z taken as a-z if ``lower``. Works in blocks of about a megabyte."""
    fold, out, i = _LOWER if lower else _AS_IS, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = starts[i], ends[j - 1]
        size = max(BLOCK + 1, int(high - low) + 1)
        if size > BLOCK + 1:  # one word longer than a block
            size = 1 << (size - 1).bit_length()
        codes = fold[data[low:high]].astype(np.uint64)
        codes += np.uint64(1)
        codes *= _powers(_MULTIPLIER, size)[: high - low]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes, dtype=np.uint64)])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * _powers(_INVERSE, size)[s])
        i = j
    return out


def run_hashes(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash for each run of ``size`` words from ``first`` on, of any length."""
    n = 1 << max(16, len(words).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(_MULTIPLIER, n)[: len(words)], dtype=np.uint64)])
    inside = (sums[first + size] - sums[first]) * _powers(_INVERSE, n)[first]
    return mix(inside + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words, in order; rows are not told apart."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += words[k : k + n]
    return mix(total)
