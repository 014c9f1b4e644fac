"""Word and shingle hashes of whole texts, vectorised over bytes.

A word is a run of bytes other than white space (0x20, 0x09 to 0x0D), with A-Z
lowered. Its 64-bit hash is a polynomial in random values of its bytes, taken
from running sums; a shingle's hash mixes those of its words in order. Sets of
words or shingles are sorted arrays of distinct hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SLICE = 1 << 21
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(salt)) | U(1)


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    value = seeds(256, 77)
    value[65:91] = value[97:123]
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    value[space] = 0
    return value, space


_VALUE, _SPACE = _byte_values()
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(n + 1, base, dtype=U)
                factors[0] = 1
                _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def _hash_slice(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in data."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, np.empty(0, dtype=U)
    up, down = _power(len(data))
    total = np.empty(len(data) + 1, dtype=U)
    total[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the n + 1 offsets at which texts begin."""
    joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes, at = [], [], 0
    while at < len(joined):
        end = min(len(joined), at + _SLICE)
        while end < len(joined) and not _SPACE[joined[end]]:  # a word is never cut
            after = _SPACE[joined[end : end + _SLICE]]
            end += int(after.argmax()) if after.any() else len(after)
        start, found = _hash_slice(joined[at:end])
        starts.append(start + at)
        hashes.append(found)
        at = end
    if not starts:
        return np.empty(0, dtype=U), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def _run_hashes(words: np.ndarray, k: int, by: np.ndarray) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = np.full(len(words) - k + 1, k, dtype=U)
    for i in range(k):
        out += (words[i : len(words) - k + 1 + i] ^ by[i]) * by[i]
    return mix(out)


def distinct(hashes: np.ndarray) -> np.ndarray:
    found = np.sort(hashes)
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The shingle hashes of each text, in order; a text of fewer words is one shingle of all of them."""
    by = seeds(size, 11)
    runs = _run_hashes(words, size, by) if len(words) >= size else words[:0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(runs[a : b - size + 1])
        else:
            out.append(_run_hashes(words[a:b], b - a, by) if b > a else words[:0])
    return out


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The set of each text, as a sorted array of hashes."""
    return [distinct(s) for s in shingles(*word_hashes(texts), size)]
