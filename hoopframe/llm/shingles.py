"""Word shingles of batches of texts as 64-bit hashes, with numpy over Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that are hashed at a time; a longer text is a chunk of its own
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _keys(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def keys(n: int) -> np.ndarray:
    """n odd random multipliers, the same ones for every n."""
    return _keys(1 << max(10, (n - 1).bit_length()))[:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts (runs of bytes that aren't blank, folded), the number of words of each text, and each word's bytes."""
    inside = ~blank[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = inside[heads]
    at = np.flatnonzero(starts)
    counts = np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])
    if not len(at):
        return np.zeros(0, np.uint64), counts, np.zeros(0, np.int64)
    kept = np.cumsum(inside)
    first = kept[at] - 1  # of each word, among the bytes inside words
    letters = keys(256)[fold[data[inside]]]
    lengths = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(letters * keys(int(lengths.max()))[place], first) + lengths.astype(np.uint64)), counts, lengths


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words of each text, sorted, and the number of each text.

    A text of fewer words, but not none, has one shingle of all of them.
    """
    words, counts, _ = word_hashes(data, offsets)
    own = np.maximum(counts - k + 1, 0)
    ends = np.cumsum(counts)
    by = keys(k + 1)
    text = np.repeat(np.arange(len(counts)), own)
    start = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(ends - counts, own)
    sized = np.arange(k + 1, dtype=np.uint64) * by[k]
    h = np.full(len(text), sized[k], np.uint64)
    for j in range(k):
        h += words[start + j] * by[j]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        one = sized[counts[short]]
        for j in range(k - 1):
            has = counts[short] > j
            one[has] += words[(ends - counts)[short[has]] + j] * by[j]
        text, h = np.concatenate([text, short]), np.concatenate([h, one])
    h = mix(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(counts))


def per_text(reduce, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """reduce.reduceat over the values of each text; 0 for texts without values."""
    out = np.zeros(len(counts), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = reduce.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text's set of shingles; 0 for the empty set."""
    key = mix(per_text(np.add, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), counts) + counts.astype(np.uint64))
    return np.where(counts > 0, key, np.uint64(0))
