"""Word and shingle hashes of one text, vectorised with numpy inside a task."""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=U64)
# One odd multiplier per position in a word; longer words are hashed one by one.
_PLACE = _RANDOM.integers(0, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_STEP = _RANDOM.integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)

# Bytes 0x09 to 0x0D and the space part words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    values = (values ^ (values >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> U64(27))) * U64(0x94D049BB133111EB)
    return values ^ (values >> U64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word, in order; A-Z count as a-z."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    space = _SPACE[data]
    inside = ~space
    if not inside.any():
        return np.empty(0, dtype=U64)
    before = np.concatenate(([True], space[:-1]))
    after = np.concatenate((space[1:], [True]))
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTE[data[inside]] * _PLACE[np.minimum(place, len(_PLACE) - 1)]
    hashes = mix(np.add.reduceat(values, first) + lengths.astype(U64))
    for i in np.flatnonzero(lengths > len(_PLACE)):
        word = data[starts[i] : ends[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of that many words; of all words, if fewer."""
    hashes = word_hashes(text or b"")
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, size, dtype=U64)
    for i in range(size):
        total += hashes[i : len(hashes) - size + 1 + i] * _STEP[i]
    return np.unique(mix(total))
