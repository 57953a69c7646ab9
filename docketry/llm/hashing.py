"""Vectorised hashing of texts, the same in every process."""

from __future__ import annotations

import re

import numpy as np
import xxhash

TOKEN = re.compile(r"[a-z0-9]+")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of a splittable random generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt))


class TokenHasher:
    """64-bit hashes of tokens; the cache is cleared before it grows large."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return [known[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh64_intdigest(t)
            return [known[t] for t in tokens]


def shingles(texts: list[str], size: int, hasher: TokenHasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``size`` tokens, text by text; number of runs of each text)."""
    hashed: list[int] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        counts[i] = len(tokens)
        hashed += hasher(tokens)
    h = np.array(hashed, dtype=_U)
    runs = np.maximum(counts - size + 1, 0)
    if not runs.sum():
        return np.empty(0, dtype=_U), runs
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
    out = np.zeros(len(at), dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[at + k])
    return out, runs


def minima(values: np.ndarray, runs: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """For each text (row) and seed (column) the least scrambled value; texts without values must be left out."""
    starts = np.concatenate([[0], np.cumsum(runs)[:-1]])
    out = np.empty((len(runs), len(seed)), dtype=_U)
    with np.errstate(over="ignore"):
        for j, s in enumerate(seed):
            x = (values ^ s) * _U(0xFF51AFD7ED558CCD)
            out[:, j] = np.minimum.reduceat(x ^ (x >> _U(32)), starts)
    return out
