"""A worker's table from hashed pieces of text to their tokens.

Keys are 64-bit hashes in one sorted array, so a table of a million pieces
takes some 30 MB and a whole chunk is looked up by one binary search.
"""

from __future__ import annotations

import os

import numpy as np

from .text import Words, blocks
from .worker import release, state

#: Entries beyond the base tier before the table is cut back to that tier.
CACHE = 1_000_000
#: Pieces that the library gets in one call.
ENCODED = 1 << 14


def load(path: str):
    """The library's tokenizer for a file: tokenizers for .json, sentencepiece for .model."""
    kept = state("pieces")
    if path not in kept:
        if path.endswith(".model"):
            import sentencepiece

            kept[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            kept[path] = tok
            release()  # what reading the file took
    return kept[path]


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Ids as the library gives them, without added begin, end or special tokens."""
    tok = load(path)
    if path.endswith(".model"):
        return tok.encode(texts, num_threads=1) if texts else []
    return [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTable:
    """``keep_ids``: whether token ids are kept beside the counts."""

    def __init__(self, path: str, base: tuple[np.ndarray, np.ndarray] | None, keep_ids: bool):
        self.path, self.keep_ids, self.base = path, keep_ids, base
        self.reset()

    def reset(self) -> None:
        keys, counts = self.base if self.base is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.slots = keys, np.arange(len(keys), dtype=np.int32)
        self.counts, self.offsets, self.used = counts.astype(np.int32), np.zeros(len(keys), np.int64), 0
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the hashes; -1 where absent."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slots[at], -1)

    def slots_of(self, w: Words) -> np.ndarray:
        """The slot of every piece; pieces met for the first time are encoded."""
        known, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
        slots = self.find(known)
        new = np.flatnonzero(slots < 0)
        if len(new):
            if len(self.keys) + len(new) > CACHE + (len(self.base[0]) if self.base is not None else 0):
                self.reset()
                slots = self.find(known)
                new = np.flatnonzero(slots < 0)
            at, counts, flat = first[new], [], []
            for lo in range(0, len(new), ENCODED):
                part = at[lo : lo + ENCODED]
                base, end = int(w.starts[part].min()), int(w.ends[part].max())
                data = w.data[base:end].tobytes()
                texts = [data[s - base : e - base].decode("utf-8", "replace") for s, e in zip(w.starts[part].tolist(), w.ends[part].tolist(), strict=True)]
                ids = encode(self.path, texts)
                counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                if self.keep_ids:
                    flat.append(np.fromiter((i for x in ids for i in x), np.uint32, int(counts[-1].sum())))
            counts = np.concatenate(counts)
            slots[new] = fresh = (len(self.counts) + np.arange(len(new))).astype(np.int32)
            if self.keep_ids:
                flat = np.concatenate(flat)
                room = self.used + len(flat)
                if room > len(self.ids):
                    self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(room, 1 << 16), np.uint32)])
                self.ids[self.used : room] = flat
                self.offsets = np.concatenate([self.offsets, self.used + np.cumsum(counts) - counts])
                self.used = room
            self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
            keys = np.concatenate([self.keys, known[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], np.concatenate([self.slots, fresh])[order]
        return slots[place]

    def totals(self, w: Words) -> np.ndarray:
        """Token counts of the documents."""
        out = np.zeros(len(w.first) - 1, np.int64)
        for part in blocks(w):
            slots = self.slots_of(part)
            sums = np.concatenate([[0], np.cumsum(self.counts[slots])])
            out += sums[part.first[1:]] - sums[part.first[:-1]]
        return out

    def token_ids(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the documents in a row, and where each document's begin."""
        ids, first = [np.zeros(0, np.uint32)], np.zeros(len(w.first), np.int64)
        for part in blocks(w):
            slots = self.slots_of(part)
            counts = self.counts[slots]
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = np.repeat(self.offsets[slots] - ends[:-1], counts) + np.arange(ends[-1])
            ids.append(self.ids[at])
            first += ends[part.first]
        return np.concatenate(ids), first


def table(path: str, key, base=None, keep_ids: bool = False) -> PieceTable:
    """This worker's table for ``key``; one at a time is kept."""
    kept = state("pieces")
    if kept.get("key") != key:
        kept["key"], kept["table"] = key, PieceTable(path, base() if base else None, keep_ids)
    return kept["table"]
