"""Word and shingle hashes of many texts at once, in numpy.

Words are `[^\\x20\\x09-\\x0D]+`. A word's hash is a polynomial over random numbers for its bytes, mixed; a shingle's
hash combines its words' hashes with odd constants, mixed again. 64 bits each.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        size = 1 << max(10, (n - 1).bit_length())
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _power = np.cumprod(p)
    return _power


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (one more entry: the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    space = _IS_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    first = np.cumsum([1, *(len(r) + 1 for r in raw)])
    bounds = np.searchsorted(starts, first)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    sizes = np.diff(np.append(starts, len(data)))
    body = data[starts[0] :]
    local = np.arange(len(body)) - np.repeat(starts - starts[0], sizes)
    value = _BYTE[body] * powers(int(sizes.max()))[local]
    return mix(np.add.reduceat(value, starts - starts[0])), bounds


def shingle(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; one run of all words if there are fewer, none if there are none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.array([(words * _MULT[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = words[: n - k + 1] * _MULT[0]
    for i in range(1, k):
        out = out + words[i : n - k + 1 + i] * _MULT[i]
    return mix(out + np.uint64(k))
