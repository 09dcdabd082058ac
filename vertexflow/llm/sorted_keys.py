"""Sorted hashes of a sender, coded for the owners of their ranges.

A key of ``bits`` bits belongs to the owner of its range.  A sender's sorted keys
are coded by the gaps between neighbours: the low bytes of a gap as they are, the
rest in unary.  All of a sender's keys are coded at once and cut by owner.
"""

from __future__ import annotations

import zlib

import numpy as np


def owner_of(keys: np.ndarray, bits: int, owners: int) -> np.ndarray:
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return ((top * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def cut(keys: np.ndarray, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners that sorted ``keys`` have, and where each one's begin, with the end."""
    owner = owner_of(keys, bits, owners)
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return owner[at], np.append(at, len(keys))


def encode(keys: np.ndarray, bounds: np.ndarray, bits: int) -> list[bytes]:
    """Blobs of the sorted distinct keys ``bounds[i]:bounds[i + 1]``."""
    n = len(keys)
    if not n:
        return []
    low = max(0, 8 * int((bits - np.log2(n) + 5) // 8))
    starts = bounds[:-1]
    gaps = np.diff(keys, prepend=np.uint64(0))
    gaps[starts] = keys[starts]
    high = (gaps >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
    first = (keys[starts] >> np.uint64(low)) if low < 64 else np.zeros(len(starts), np.uint64)
    high[starts] = 0  # a blob's first key tells its high part apart
    tails = gaps.astype("<u8").view(np.uint8).reshape(n, 8)[:, : low // 8]
    total = np.cumsum(high + 1)
    before = np.concatenate([[0], total[bounds[1:-1] - 1]])
    sizes = (np.diff(np.append(before, total[-1])) + 7) // 8
    base = np.concatenate([[0], np.cumsum(sizes)])
    unary = np.zeros(int(base[-1]) * 8, np.uint8)
    unary[total - 1 + np.repeat(base[:-1] * 8 - before, np.diff(bounds))] = 1
    unary, tails = np.packbits(unary).tobytes(), np.ascontiguousarray(tails).tobytes()
    heads = np.stack([np.diff(bounds).astype(np.uint64), np.full(len(starts), low, np.uint64), first], 1).astype("<u8")
    step = low // 8
    return [heads[i].tobytes() + tails[a * step : b * step] + unary[u:v] for i, (a, b, u, v) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), base[:-1].tolist(), base[1:].tolist(), strict=True))]


def decode(blob: bytes) -> np.ndarray:
    n, low, first = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    step = low // 8
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :step] = np.frombuffer(blob, np.uint8, n * step, 24).reshape(n, step)
    gaps = gaps.view("<u8").ravel().astype(np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=24 + n * step)))
    high = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    high[0] = first
    return np.cumsum(gaps + (high << np.uint64(low)) if low < 64 else gaps)


def encode_counts(counts: np.ndarray) -> bytes:
    """Numbers from 0, most of them small: a byte each, and four more for those from 255."""
    large = counts[counts >= 255].astype("<u8").tobytes()
    return zlib.compress(np.uint32(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large, 1)


def decode_counts(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=4 + n)
    return out
