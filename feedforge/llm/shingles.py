"""Hashed word shingles of whole texts, vectorised over batches of documents.

Words are runs without ASCII white space, with A-Z lower-cased. A word's hash is a polynomial over
its bytes, taken from prefix sums, and so does not depend on where the word stands; a shingle's hash
combines five of them. A text of one to four words has one shingle, the whole sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_FOLD = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([not chr(b).isalnum() and b < 128 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    size = max(BLOCK + 1, n)
    if size not in _powers:
        _powers.clear()
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def _hash_words(block: bytes, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block that ends in a break, and the places where they start."""
    raw = np.frombuffer(block, np.uint8)
    space = breaks[raw]
    before = np.concatenate(([True], space[:-1]))
    start = np.flatnonzero(~space & before)
    stop = np.flatnonzero(space & ~before)
    up, down = powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * up[: len(raw)], dtype=np.uint64)))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)), start


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(document, text) with long texts cut at white space, so that a block stays bounded."""
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > BLOCK:
            cut = max(text.rfind(c, at, at + BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                break
            yield i, text[at:cut]
            at = cut
        yield i, text[at:]


def words(texts: list[bytes], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's begin (one entry more than texts)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        found, start = _hash_words(b" ".join(t for _, t in group) + b" ", breaks)
        ends = np.cumsum([len(t) + 1 for _, t in group])
        np.add.at(counts, [i for i, _ in group], np.diff(np.searchsorted(start, ends), prepend=0))
        hashes.append(found)
        group.clear()

    for i, text in _pieces(texts):
        if size + len(text) >= BLOCK:
            flush()
            size = 0
        group.append((i, text))
        size += len(text) + 1
    flush()
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(counts)))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, at = words(texts)
    folded = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        folded = folded * _FOLD + hashes[k : len(hashes) - width + 1 + k] if len(folded) else folded
    folded = mix(folded)
    out = []
    for i in range(len(texts)):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= width:
            out.append(np.unique(folded[lo : hi - width + 1]))
        elif hi > lo:
            h = hi - lo
            for w in hashes[lo:hi].tolist():
                h = (int(h) * int(_FOLD) + w) % (1 << 64)
            out.append(mix(np.array([h ^ 0x5BF03635], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], registers: int, seed: int) -> np.ndarray:
    """For each set and each of `registers` universal hashes a * x + b, the smallest value; all ones for an empty set."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(1, 1 << 63, registers, np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 1 << 63, registers, np.uint64)
    out = np.full((len(sets), registers), np.iinfo(np.uint64).max, np.uint64)
    filled = [i for i, s in enumerate(sets) if len(s)]
    k = 0
    while k < len(filled):
        size, stop = 0, k
        while stop < len(filled) and (size == 0 or size + len(sets[filled[stop]]) <= 1 << 15):
            size += len(sets[filled[stop]])
            stop += 1
        rows = filled[k:stop]
        values = np.concatenate([sets[i] for i in rows])
        at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in rows[:-1]]))).astype(np.int64)
        # hashing by a * x + b leaves low bits weak, but minima read the high ones
        for j in range(registers):
            out[rows, j] = np.minimum.reduceat(values * a[j] + b[j], at)
        k = stop
    return out


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
