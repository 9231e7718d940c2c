"""Hashing the words and word shingles of whole Arrow batches with numpy.

A batch of texts is one byte buffer with offsets, so all texts are hashed together, a few hundred
kilobytes at a time; a longer text is hashed on its own and needs about 60 bytes a byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK = 1 << 19

_SEED = np.random.RandomState(20240229)
_BYTE = _SEED.randint(0, 2 ** 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, 1 << 16
_PLACE = np.array([pow(_BASE, i + 1, 1 << 64) for i in range(SHINGLE)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    size = 1
    while size < n:  # doubling
        more = min(size, n - size)
        out[size:size + more] = out[:more] * np.uint64(pow(_BASE, size, 1 << 64))
        size += more
    return out


_POWER = _powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow array of strings, nulls as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    value = _BYTE[_LOWER[data[kept]]]
    if lengths.max() > _STEP:
        far = place >= _STEP
        value[far] *= mix((place[far] // _STEP).astype(np.uint64)) | np.uint64(1)
        place %= _STEP
    value *= _POWER[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)), bounds


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer words is one shingle, none is empty."""
    offsets, data = buffers(texts)
    for first, last in chunks(offsets):
        words, bounds = word_hashes(offsets[first:last + 1], data[offsets[first]:offsets[last]])
        runs = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
        for k in range(SHINGLE):
            runs += words[k:k + len(runs)] * _PLACE[k]
        runs = mix(runs + np.uint64(SHINGLE))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= SHINGLE:
                own = np.sort(runs[a:b - SHINGLE + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif b > a:
                yield mix((words[a:b] * _PLACE[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
