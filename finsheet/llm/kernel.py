"""Vectorised text hashing inside Arrow batches.

Everything works on the UTF-8 buffer of an Arrow string array, so no Python object is made per word or per
document. Hashes are polynomial in 2**64 with random byte values and get a 64-bit finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

#: A word byte is a letter or digit, an underscore or any byte outside ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256), (95,)):
    WORD_BYTE[list(_r)] = True

_powers = {BASE: np.ones(1, dtype=np.uint64), INVERSE: np.ones(1, dtype=np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i+1] - H[i] = value(data[i]) * BASE**i, so any substring hash is one subtraction and one product."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of data[start:end] for arrays of starts and ends."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        array = array.cast(pa.large_binary())
    elif pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
    if array.null_count:
        array = pc.fill_null(array, b"")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one document if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def words(array: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and one past the last, starts, ends, bytes)."""
    if lower:
        array = pc.utf8_lower(array)
    data, offsets = string_buffers(array)
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    return mix(span_hash(prefix_hash(data), starts, ends)), first, starts, ends, data


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = WORD_BYTE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


_turns = np.random.default_rng(7).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values."""
    out = np.zeros(max(0, len(values) - n + 1), dtype=np.uint64)
    for j in range(n):
        out += values[j : j + len(out)] * _turns[j]
    return mix(out)


def shingles(array: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offset of each document's first); a text of fewer than n words is one shingle of all of them."""
    hashes, first, *_ = words(array)
    count = np.diff(first)
    spans = np.where(count == 0, 0, np.maximum(1, count - n + 1))
    offsets = np.concatenate([[0], np.cumsum(spans)])
    if not offsets[-1]:
        return np.zeros(0, dtype=np.uint64), offsets
    doc = np.repeat(np.arange(len(count)), spans)
    at = first[doc] + (np.arange(offsets[-1]) - offsets[doc])
    long = window_hash(hashes, n)
    out = np.zeros(offsets[-1], dtype=np.uint64)
    whole = count[doc] >= n
    out[whole] = long[at[whole]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = hashes[first[i] : first[i + 1]]
        out[offsets[i]] = mix(np.array([np.sum(own * _turns[: len(own)], dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, offsets
