"""Integer arrays as short byte strings, so that shuffles carry a few bytes an entry and one row a block and shard."""

from __future__ import annotations

import numpy as np


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers in as few whole bytes each as the largest needs."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers by their differences; the first has 8 bytes of its own."""
    a = np.ascontiguousarray(a, np.uint64)
    return a[:1].astype("<u8").tobytes() + pack(np.diff(a)) if len(a) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(b[:8], "<u8").astype(np.uint64)
    return np.cumsum(np.concatenate([first, unpack(b[8:])]), dtype=np.uint64)


def narrow(a: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds the largest value."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def by_shard(shard: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by shard, and the n + 1 bounds of the shards in it."""
    order = np.argsort(shard.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))
