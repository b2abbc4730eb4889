"""Words and word shingles of whole Arrow columns of texts, as 64-bit hashes, without a Python object for a word.

Words are as in text.GAP: A-Z count as a-z, digits and all bytes beyond ASCII are letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LETTER = np.zeros(256, np.uint8)
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    _LETTER[_r.start : _r.stop] = np.arange(_r.start, _r.stop)
_LETTER[65:91] = _LETTER[97:123]
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes that are taken at a time; a longer text is taken alone.
CHUNK = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits, as in splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; null is empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, most: int = CHUNK):
    """(first row, bytes, offsets from 0) of pieces of a column."""
    data, offsets = column_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): the words of text i are those from bounds[i] to bounds[i + 1]."""
    letters = _LETTER[data]
    at = np.flatnonzero(letters)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts_of_texts = np.searchsorted(at, offsets[:-1])
    first[starts_of_texts[starts_of_texts < len(at)]] = True
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, length)
    value = letters[at].astype(np.uint64) * _powers(_BASE, int(length.max()))[place]
    hashes = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))
    return hashes, np.searchsorted(at[begin], offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, bounds). A text of fewer words, but not none, is one shingle."""
    n = np.diff(bounds)
    per = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out_bounds = np.append(0, np.cumsum(per))
    begin = np.repeat(bounds[:-1] - out_bounds[:-1], per) + np.arange(out_bounds[-1])
    left = np.repeat(np.minimum(n, size), per)
    power = _powers(_STEP, size)
    padded = np.append(words, np.zeros(size, np.uint64))
    total = left.astype(np.uint64)
    for j in range(size):
        total = total + np.where(j < left, padded[begin + j], np.uint64(0)) * power[j]
    return mix(total), out_bounds


def multisets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, sorted in each text; their counts; bounds)."""
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    starts = bounds[:-1]
    new[starts[starts < len(hashes)]] = True
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(at, bounds)


def of_column(column: pa.Array, size: int):
    """(first row, distinct shingles, counts, bounds) for pieces of a column of texts."""
    for row, data, offsets in chunks(column):
        yield row, *multisets(*shingle_hashes(*word_hashes(data, offsets), size))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two multisets, exactly; 0 if one is empty."""
    (x, n), (y, m) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.minimum(n, m[at])[y[at] == x].sum())
    return common / (int(n.sum()) + int(m.sum()) - common)
