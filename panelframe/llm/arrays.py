"""numpy building blocks shared by the text operators: word spans, hashes, anchors.

Everything works on the UTF-8 bytes of many texts at once, laid end to end, so that a batch of
documents costs a fixed number of numpy calls whatever the number of documents.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ALL_ONES = U64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20240229)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
#: Inverse of BASE modulo 2**64 (BASE is odd).
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
#: ASCII space and \t \n \v \f \r: what separates words in most operators.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: Units handled at once; longer texts are cut into overlapping chunks, so memory stays bounded.
CHUNK = 1 << 19
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get((int(base), 0))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[(int(base), 0)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def word_spans(buf: np.ndarray, is_space: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every maximal run of non-space bytes."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.take(~is_space, buf, out=inside[1:-1].view(bool))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span."""
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_HASH[buf] * powers(BASE, len(buf)), out=sums[1:])
    shift = powers(BASE_INVERSE, len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(U64))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive units, by doubling: about 2 log2(k) passes instead of k."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, width, out, done = units, 1, None, 0
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:  # what is done comes first, then this power of two
                out = mix_pair(out[: len(power) - done], power[done:])
                done += width
        width *= 2
        if width > k:
            return mix(out[:n])
        power = mix_pair(power[: len(power) - width // 2], power[width // 2 :])


def mix_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    h = a[:n] * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h += b[:n]
    h *= U64(0xA0761D6478BD642F)
    return h


def run_bounds(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; new[i] says that i begins one."""
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


def window_anchors(grams: np.ndarray, per_window: int) -> np.ndarray:
    """For each window of per_window grams, the index of its least gram (the last one among equals).

    Which one is taken depends on the window's own content only, so equal windows anywhere in the
    corpus choose equal anchors at equal offsets. Two running minima over blocks of per_window give
    every window's minimum in linear time.
    """
    w, n = per_window, len(grams)
    if n < w:
        return np.zeros(0, np.int64)
    low = U64((1 << 22) - 1)
    keyed = (grams & ~low) | (low - np.arange(n, dtype=U64))
    if w == 1:
        return np.arange(n)
    blocks = -(-n // w)
    padded = np.full(blocks * w, ALL_ONES, U64)
    padded[:n] = keyed
    square = padded.reshape(blocks, w)
    after = np.minimum.accumulate(square, axis=1).ravel()
    before = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(before[: n - w + 1], after[w - 1 : n])
    return (low - (least & low)).astype(np.int64)
