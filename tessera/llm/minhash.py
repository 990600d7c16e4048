"""Signatures for MinHash near-duplicate detection: shingle sets, universal hash minima, bands."""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash

from tessera.llm.common import space_words

SHINGLE = 5
HASHES = 64
#: Most that banding and the signature check may each miss of the pairs whose similarity is the threshold.
MISS_BANDS, MISS_CHECK = 7.5e-6, 1.7e-7
_RNG = np.random.default_rng(20240229)
#: h_i(x) = (a_i x + b_i) mod 2^64, of which the upper 32 bits count: a universal family.
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hash of each word met so far; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of every number spread over all of its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(threshold: float) -> tuple[int, int]:
    """(bands, minima of each): the longest bands, and of these the fewest, that miss at most MISS_BANDS at `threshold`."""
    for length in range(HASHES, 0, -1):
        for n in range(1, HASHES // length + 1):
            if (1 - threshold**length) ** n <= MISS_BANDS:
                return n, length
    raise ValueError(f"{HASHES} minima cannot find pairs of similarity {threshold}")


def least_agreeing(threshold: float) -> int:
    """The most minima of which pairs at `threshold` agree in fewer with a chance of at most MISS_CHECK."""
    below = 0.0
    for n in range(HASHES):
        below += comb(HASHES, n) * threshold**n * (1 - threshold) ** (HASHES - n)
        if below > MISS_CHECK:
            return n
    return HASHES


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the SHINGLE-word shingles of a whole text; of all words as one if there are fewer."""
    own = space_words(text)
    if not own:
        return np.empty(0, np.uint64)
    w = np.array(list(map(_WORDS.__getitem__, own)), dtype=np.uint64)
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mixed(h * _P + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of the universal hashes, 32 bits each."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = _A[:, None] * shingles[None, at : at + 1024]
        part += _B[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _signature(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32)


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def agreeing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Share of equal minima, for each of `a` with each of `b`."""
    x, y = np.stack(a), np.stack(b)
    same = np.zeros((len(a), len(b)), np.uint8)
    for k in range(HASHES):
        same += x[:, k, None] == y[None, :, k]
    return same / HASHES


def similarities(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarities of sets, each of `a` with each of `b`, in steps of bounded size."""
    everything = np.concatenate([*a, *b])
    values, place, counts = np.unique(everything, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1  # only what two of the sets hold can be in common
    width, n_a = int((counts > 1).sum()), len(a)
    lengths = np.array([len(s) for s in (*a, *b)])
    owner, column, live = np.repeat(np.arange(len(lengths)), lengths), shared[place], (counts > 1)[place]
    common = np.zeros((n_a, len(b)), np.float64)
    owner, column = owner[live], column[live]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((len(lengths), min(2048, width - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part[:n_a] @ part[n_a:].T
    return common / np.maximum(lengths[:n_a, None] + lengths[None, n_a:] - common, 1)


def forest(linked: np.ndarray, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Links (one fewer than nodes for each part that hangs together) which connect what `linked` connects."""
    out, free_a, free_b = [], np.ones(len(a), bool), np.ones(len(b), bool)
    for root in range(len(a)):
        if not free_a[root]:
            continue
        free_a[root] = False
        front = np.array([root])
        while len(front):
            new_b = np.flatnonzero(linked[front].any(axis=0) & free_b)
            free_b[new_b] = False
            new_a = np.flatnonzero(linked[:, new_b].any(axis=1) & free_a)
            free_a[new_a] = False
            out += [(a[root], b[k]) for k in new_b if b[k] != a[root]] + [(a[root], a[k]) for k in new_a]
            front = new_a
    return out
