"""Weighted word shingles of documents."""

from __future__ import annotations

import string

import numpy as np
import xxhash

from ledgerloom.llm.common import Bounded

WORDS = 5
#: Buckets of the table of document frequencies; its size doesn't follow the corpus.
BUCKETS = 1 << 20
#: A shingle that all documents have weighs so much, one of a single document weighs 1.
LEAST_IDF = 0.9
#: What a shingle gains for e times as many occurrences in a document, and the most it may.
TF_GAIN, TF_MOST = 0.1, 1.25
#: Weights are rounded to so many steps per unit of their logarithm.
STEPS = 64
LOWEST = int(np.floor(np.log(LEAST_IDF) * STEPS))
LEVELS = int(np.ceil(np.log(TF_MOST) * STEPS)) - LOWEST + 1

_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's runs of five words, lower case, ASCII punctuation apart; shorter texts are one shingle."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.hashes = Bounded(xxhash.xxh64_intdigest)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles and how often each occurs."""
        found = text.lower().encode().translate(_PUNCTUATION).split()
        ids = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        width = max(1, min(self.words, len(ids)))
        runs = np.full(max(0, len(ids) - width + 1), len(ids) if len(ids) < self.words else self.words, np.uint64)
        for i in range(width):
            runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - width + 1 + i])
        return np.unique(runs, return_counts=True)


def levels(shingles: np.ndarray, times: np.ndarray, documents: int, frequencies: np.ndarray) -> np.ndarray:
    """Steps of each shingle's weight, from 0: damped inverse document frequency times damped term frequency.

    ``frequencies`` are sums over buckets of shingles; the mean of all buckets is taken off as the others' share.
    """
    bucket = (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    df = np.maximum(frequencies[bucket], 1.0)
    scale = np.log1p(max(documents, 1))
    idf = LEAST_IDF + (1 - LEAST_IDF) * np.clip(1 - np.log1p(df) / scale, 0, 1)
    tf = np.minimum(1 + TF_GAIN * np.log(times), TF_MOST)
    return np.clip(np.rint(np.log(idf * tf) * STEPS).astype(np.int64) - LOWEST, 0, LEVELS - 1)


def weights(level: np.ndarray) -> np.ndarray:
    return np.exp((level + LOWEST) / STEPS)


def similarity(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """Weighted Jaccard similarity of sorted shingles a, b with weights u, v; 0 where neither has any."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.minimum(u[i], v[j]).sum()
    union = u.sum() + v.sum() - common
    return float(common / union) if union else 0.0
