"""Sorted 64-bit codes dealt over shards and packed into blobs."""

from __future__ import annotations

import numpy as np
import zstandard


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)


def by_shard(codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, shard): places of sorted codes by (shard, code), and where each shard begins."""
    shard = shard_of(codes, shards)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    return order, first, shard[first].astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 3)


def steps(codes: np.ndarray) -> bytes:
    """Ascending codes as compressed differences."""
    return pack(np.diff(codes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def unsteps(blob: bytes) -> np.ndarray:
    planes = unpack(blob, np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=np.uint64)
