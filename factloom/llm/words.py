"""Vectorised word splitting and 64-bit word and shingle hashes over blocks of documents.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z. All functions work on
UTF-8 bytes; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
np.seterr(over="ignore")  # hashes are meant to wrap around
_ODD = np.random.default_rng(20240601).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_PLAIN = _BYTE.copy()
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers = np.ones(1, np.uint64)
_places = np.ones(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (in place where possible) so that every bit depends on every other."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1] * _ODD[0])])
    return _powers[:n]


def places(n: int) -> np.ndarray:
    """A factor for each place of a word, unlike powers of one number without a rule that long words could follow."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, max(n, 2 * len(_places), 256) + 1, dtype=np.uint64) * _ODD[0])
    return _places[:n]


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string or binary column as bytes, nulls as empty."""
    return [b"" if x is None else x if isinstance(x, bytes) else x.encode() for x in column.to_pylist()]


def slices(texts: Iterable[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """(first, past the last) of runs of documents with about ``most`` bytes each; a longer document stands alone."""
    first, held, k = 0, 0, -1
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, k
            first, held = k, 0
        held += len(t) + 1
    if k >= first:
        yield first, k + 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of ``texts``, in order, and the number of words of each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    past = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, past, "left"), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    body = buf[inside]
    offset = np.arange(len(body)) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTE[body] * places(int(lengths.max()))[offset], first)
    return mix(h + lengths.astype(np.uint64) * _ODD[1]), counts


def combined(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the values in each row of ``columns``, the same as ``gram_hashes`` has for them in a row."""
    total = columns[0] * _ODD[2]
    for k, c in enumerate(columns[1:], 1):
        total += c * _ODD[2 + k]
    return mix(total + _ODD[40] * np.uint64(len(columns)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring values of ``h``, whichever documents they are in."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    return combined([h[k : len(h) - n + 1 + k] for k in range(n)])


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``n``-word shingles of each text, sorted in it, and how many each has.

    A text of fewer than ``n`` words has its whole sequence as one shingle; one without words has none.
    """
    h, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    grams = gram_hashes(h, n)
    whole = doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)]
    values, owner = grams[whole], doc[: len(grams)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = [gram_hashes(h[first[d] : first[d] + counts[d]], int(counts[d]))[0] for d in short]
        values, owner = np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.bincount(owner[keep], minlength=len(texts))
