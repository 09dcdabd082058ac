"""Vectorised access to the words of an Arrow string column.

A word is a run of characters other than space and the controls 0x09-0x0D; A-Z
count as a-z.  All of these are single bytes in UTF-8, so words are found and
hashed on the raw buffer without making a Python object for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes whose prefix sums are held at once; hashes don't depend on it.
SPAN_BYTES = 1 << 17
#: Words handled at once where much is held for each.
BLOCK_WORDS = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _LETTER.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _FOLDED[ord("a") : ord("z") + 1]
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Second bytes of the letters U+00C0-U+00FF, after 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to SPAN_BYTES."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SPAN_BYTES + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of several documents: those of document i are ``first[i]:first[i + 1]``."""

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about CHUNK_BYTES each."""
    at, _ = _buffer(texts)
    n, lo = len(texts), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(texts: pa.Array, fold: bool = True) -> Words:
    """Words of a null-free Arrow string array; ``fold``: A-Z hash as a-z."""
    at, raw = _buffer(texts)
    data = raw[at[0] : at[-1]]
    at = at - at[0]
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(at), np.int64), none.astype(np.uint64), none, none, data)
    inside = ~_SEPARATOR[data]
    left = np.empty(size, bool)
    left[0], left[1:] = True, ~inside[:-1]
    left[at[:-1][at[:-1] < size]] = True
    right = np.empty(size, bool)
    right[-1], right[:-1] = True, ~inside[1:]
    right[at[1:][at[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & left)
    ends = np.flatnonzero(inside & right) + 1
    hashes = _spans(data, starts, ends, _FOLDED if fold else _LETTER)
    return Words(np.searchsorted(starts, at).astype(np.int64), hashes, starts, ends, data)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``starts:ends``, a polynomial over the bytes of each; spans are in order.

    Prefix sums over SPAN_BYTES at most give the spans that lie there; a longer span is summed by parts.
    """
    power, inverse = _power_tables()
    sums = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + SPAN_BYTES, "right"))
        if hi <= lo:
            sums[lo] = _long_span(data[base : int(ends[lo])], letter, power)
            lo += 1
            continue
        part = data[base : int(ends[hi - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letter[part] * power[: len(part)], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        sums[lo:hi] = (total[e] - total[s]) * inverse[s]
        lo = hi
    return mix(sums + (ends - starts).astype(np.uint64))


def _long_span(data: np.ndarray, letter: np.ndarray, power: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for lo in range(0, len(data), SPAN_BYTES):
        part = data[lo : lo + SPAN_BYTES]
        total += scale * int((letter[part] * power[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(_BASE, SPAN_BYTES, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def blocks(w: Words, most: int = BLOCK_WORDS) -> Iterator[Words]:
    """The same words, at most ``most`` at once: every block has all documents, most of them empty."""
    n = len(w.hashes)
    for lo in range(0, n, most):
        hi = min(n, lo + most)
        yield Words(np.clip(w.first, lo, hi) - lo, w.hashes[lo:hi], w.starts[lo:hi], w.ends[lo:hi], w.data)


def spaced(texts: pa.Array, fold: bool = False) -> Words:
    """Pieces that cover each text: separators with the word after them, and what trails.

    A piece also begins at a full stop or comma that follows a letter below U+0100.
    """
    at, raw = _buffer(texts)
    data = raw[at[0] : at[-1]]
    at = at - at[0]
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(at), np.int64), none.astype(np.uint64), none, none, data)
    outside = _SEPARATOR[data]
    begins = np.zeros(size + 1, bool)
    begins[1:size] = outside[1:] & ~outside[:-1]
    stops = np.flatnonzero(_STOP[data[1:]]) + 1
    stops = stops[_ASCII_LETTER[data[stops - 1]] | (_LATIN[data[stops - 1]] & (data[stops - 2] == 0xC3) & (stops > 1))]
    begins[stops] = True
    begins[at[:-1]] = True
    starts = np.flatnonzero(begins[:size])
    ends = np.append(starts[1:], size)
    hashes = _spans(data, starts, ends, _FOLDED if fold else _LETTER)
    return Words(np.searchsorted(starts, at).astype(np.int64), hashes, starts, ends, data)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's begin.

    A document with fewer words than ``size`` has its whole sequence as its one
    shingle; one without words has none.
    """
    n = len(w.hashes)
    joint = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        joint = joint * np.uint64(_BASE) + w.hashes[k : k + len(joint)]
    joint = mix(joint)
    parts, first = [], np.zeros(len(w.first), np.int64)
    for i in range(len(w.first) - 1):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if hi - lo >= size:
            own = np.sort(joint[lo : hi - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            own = np.full(1, hi - lo, np.uint64)
            for h in w.hashes[lo:hi]:
                own = own * np.uint64(_BASE) + h
            own = mix(own ^ np.uint64(0xA5A5A5A5))
        else:
            own = joint[:0]
        parts.append(own)
        first[i + 1] = first[i] + len(own)
    return (np.concatenate(parts) if parts else joint[:0]), first


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values).cast(kind))


def fresh(docs, *names: str) -> list[str]:
    """Names close to ``names`` that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    return col.fill_null("")


def cut_text(raw: bytes, most: int, lead: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text of about ``most`` bytes, cut at separators; each begins with the last ``lead`` words before it.

    Yields a part and how many such words it begins with.
    """
    data = np.frombuffer(raw, np.uint8)
    lo = 0
    while True:
        hi = lo + most
        if hi < len(raw):
            near = np.flatnonzero(_SEPARATOR[data[lo + 1 : hi]])
            if len(near):
                hi = lo + 1 + int(near[-1])
            else:
                while hi < len(raw) and not _SEPARATOR[data[hi : hi + most]].any():
                    hi += most
                near = np.flatnonzero(_SEPARATOR[data[hi : hi + most]])
                hi = hi + int(near[0]) if len(near) else len(raw)
        before: list[bytes] = []
        end = lo
        while len(before) < lead:
            end = len(raw[:end].rstrip(b" \t\n\x0b\f\r")) if end else 0
            if not end:
                break
            start = max(raw.rfind(s, 0, end) for s in (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")) + 1
            before.insert(0, raw[start:end])
            end = start
        yield b" ".join([*before, raw[lo:hi]]), len(before)
        if hi >= len(raw):
            return
        lo = hi
