"""Words and word shingles of many texts at once, as 64-bit hashes, from the texts' UTF-8 bytes.

A word is a run of bytes other than space and the control characters 9 to 13. Its hash mixes in eight bytes at a time;
a shingle's hash chains the hashes of its words. Equal words have equal hashes; unequal ones differ but for a chance of
about 2**-64 a pair, also where one repeats the other's letters in another pattern.
"""

from __future__ import annotations

import numpy as np
import xxhash

from muster.llm.bpe import mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


#: Longer words are hashed one by one.
LONG_WORD = 64


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of `data` (u1) the number that its next eight bytes make; past the end they are 0."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def low_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the first n bytes, for n up to 8."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - n.astype(np.uint64)))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes (none is empty): eight bytes at a time are mixed in, from the length on."""
    n = ends - starts
    h = mix(n.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
    ahead, at, live = eights(data), 0, np.flatnonzero(n <= LONG_WORD)
    while len(live):
        left = n[live] - at
        h[live] = mix(h[live] * np.uint64(_BASE) ^ (ahead[starts[live] + at] & low_bytes(np.minimum(left, 8))))
        at += 8
        live = live[left > 8]
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h


def word_hashes(data: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of `data` (u1)."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return hash_ranges(_LOWER[data] if fold_case else data, starts, ends), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of `k` words; of the whole sequence, if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_BASE) + words[j : j + n])
    return out


def shingle_sets(texts: list[str | None], k: int, fold_case: bool = True) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in texts]
    hashes, starts, _ = word_hashes(data, fold_case)
    first = np.cumsum([0] + [len(r) + 1 for r in raw])
    at = np.searchsorted(starts, first)
    return [np.unique(shingle_hashes(hashes[a:b], k)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
