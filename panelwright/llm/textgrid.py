"""Whole texts as flat numpy arrays: bytes, words, lines and their 64-bit hashes.

An Arrow batch is cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own),
so the arrays of one chunk take some tens of bytes per byte of text, whatever the batch holds.
Hashes are fixed functions of the bytes, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


#: A scrambled value for each byte, none of them 0.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256), _BASE))])
        if n > 1 << 20:  # a table for one very long run is not kept
            long, _powers = _powers, np.ones(1, np.uint64)
            return long[:n]
    return _powers[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, nulls as empty, and the offsets of its texts."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of about ``most`` bytes."""
    data, offs = flat(texts)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, no run crossing a text's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.empty(len(mask), bool)
    fresh[0] = True
    np.logical_not(mask[:-1], out=fresh[1:])
    last = np.empty(len(mask), bool)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    edges = offs[(offs > 0) & (offs < len(mask))]
    fresh[edges] = True
    last[edges - 1] = True
    return np.flatnonzero(mask & fresh), np.flatnonzero(mask & last) + 1


def run_hashes(data: np.ndarray, mask: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run; runs are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    body = data[np.repeat(starts, lens) + at] if mask is None else data[starts[0] :][mask[starts[0] :]]
    terms = BYTE[body]
    terms *= powers(int(lens.max()))[at]
    return mix(np.add.reduceat(terms, np.cumsum(lens) - lens) + lens.astype(np.uint64) * _ODD)


def owners(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text, the index of its first run; one more entry for the end."""
    return np.searchsorted(starts, offs)


def windows(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words that lie in one text, and the word each begins at."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h *= _BASE
        h += words[k : len(words) - n + 1 + k]
    inside = np.ones(len(words) + 1, bool)
    for k in range(1, n):  # a window must not begin in the last n - 1 words of a text
        cut = first[1:] - k
        inside[cut[cut >= first[:-1]]] = False
    at = np.flatnonzero(inside[: len(h)])
    return mix(h[at]), at


def salted(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made different in different texts of a chunk."""
    return h ^ mix((text.astype(np.uint64) + np.uint64(1)) * _ODD)


def text_of(first: np.ndarray) -> np.ndarray:
    """The text that each run belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray) -> np.ndarray:
    """The distinct values that occur more than once, in order."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    return twice[np.r_[True, twice[1:] != twice[:-1]]] if len(twice) else twice


def among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in the ordered ``values``."""
    if not len(values):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(values, keys)
    at[at == len(values)] = 0
    return values[at] == keys


def occurrence(keys: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a key, 1 for the second, and so on."""
    out = np.zeros(len(keys), np.uint64)
    hot = np.flatnonzero(among(keys, repeated(keys)))
    if len(hot):
        order = hot[np.argsort(keys[hot], kind="stable")]
        k = keys[order]
        begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out[order] = (np.arange(len(k)) - np.repeat(begin, np.diff(np.r_[begin, len(k)]))).astype(np.uint64)
    return out
