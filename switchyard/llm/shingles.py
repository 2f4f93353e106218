"""Word shingles of whole texts as sorted 64-bit hashes, and minwise signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = np.array([pow(0xC2B2AE3D27D4EB4F, 2 * j + 1, 1 << 64) for j in range(1, 65)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash (XXH3) of each word of a text whose A-Z are lower-cased first.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, where ``split`` cuts.
    """
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, text.lower().split())), np.uint64)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles.

    Fewer words than that are one shingle together; no words, or no text, none.
    """
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    span = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - span + 1, np.uint64(span), np.uint64)
        for j in range(span):
            total += words[j : len(words) - span + 1 + j] * _MULTIPLIERS[j]
    return np.unique(mix(total))


class Minwise:
    """Signatures by one permutation: a set's least hash in each of ``size`` ranges.

    An empty range takes the value of another range, probed in an order that is
    fixed for the range, so that two sets agree in any coordinate with a
    probability of their Jaccard similarity.
    """

    def __init__(self, size: int = 128, seed: int = 1):
        self.size = size
        self.edges = (np.arange(1, size, dtype=np.uint64) << np.uint64(64 - (size - 1).bit_length()))
        rng = np.random.default_rng(seed)
        self.probes = np.stack([np.concatenate([[b], rng.permutation(np.delete(np.arange(size), b))]) for b in range(size)])

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """16-bit values of the coordinates of a non-empty sorted set."""
        first = np.concatenate([[0], np.searchsorted(hashes, self.edges)])
        filled = np.diff(first, append=len(hashes)) > 0
        if not filled.all():
            first = first[self.probes[np.arange(self.size), filled[self.probes].argmax(axis=1)]]
        return (mix(hashes[first]) >> np.uint64(48)).astype(np.uint16)


class Sketch:
    """One byte for each of ``size`` ranges of hash values: drawn from a set's least hash there, or 0 where it has none."""

    def __init__(self, size: int = 512):
        self.size = size
        self.edges = np.arange(1, size, dtype=np.uint64) << np.uint64(64 - (size - 1).bit_length())

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.searchsorted(hashes, self.edges)])
        filled = np.diff(first, append=len(hashes)) > 0
        out = np.zeros(self.size, np.uint8)
        out[filled] = 1 + mix(hashes[first[filled]]) % np.uint64(255)
        return out


def sketch_similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarities of sketched sets of known sizes, row by row, and whether they may reach ``threshold``.

    Of the union of two sets at the threshold, the ranges that are not empty
    show one element each, a sample without replacement; five standard
    deviations of its share are allowed for.  Equal bytes of unlike elements
    only add to it.  The ratio of the sizes is a bound without error.
    """
    shown = np.count_nonzero(left | right, axis=1)
    equal = np.count_nonzero((left == right) & (left > 0), axis=1)
    estimate = equal / np.maximum(1, shown)
    union = (n_left + n_right) / (1 + threshold)
    deviation = np.sqrt(threshold * (1 - threshold) / np.maximum(1, shown) * np.clip(1 - shown / np.maximum(1, union), 0.05, 1))
    sizes = np.minimum(n_left, n_right) >= threshold * np.maximum(n_left, n_right) - 1e-9
    return estimate, sizes & (estimate >= threshold - 5 * deviation)
