"""Token shingles as numpy arrays, for Arrow batches of texts.

A token is one character of U+4E00 to U+9FFF or a longest run of other letters and digits of the lower-cased text. A shingle is
a sequence of consecutive tokens, kept as a 48-bit hash; a text's shingles are its sorted distinct hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
HASH_BITS = 48
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
#: Texts are hashed in blocks of at most so many rows and tokens: the row's number takes the bits above the hash.
BLOCK_ROWS, BLOCK_TOKENS = 1 << 14, 2_000_000
_CACHE_TOKENS = 400_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE_TOKENS:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


_hashes = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD[0]
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    return h ^ (h >> np.uint64(32))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class Block:
    """The shingles of a block of texts.

    values: the sorted distinct hashes of each text, one after the other; offsets: where each text's values begin;
    raw, at: the hash of each window in text order, and for each of ``values`` the window it was first seen in.
    """

    def __init__(self, texts: list[str | None], width: int, positions: bool = False):
        lists = [tokens(t) for t in texts]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        get = _hashes.__getitem__
        flat = np.fromiter((get(w) for x in lists for w in x), dtype=np.uint64, count=int(counts.sum()))
        row = np.repeat(np.arange(len(lists), dtype=np.uint64), counts)
        n = max(0, len(flat) - width + 1)
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h = (h ^ flat[i : i + n]) * _ODD[i % 5]
            h ^= h >> np.uint64(31)
        whole = row[:n] == row[width - 1 : width - 1 + n]
        self.raw, self.raw_row = (mix(h) & HASH_MASK)[whole], row[:n][whole]
        key = (self.raw_row << np.uint64(HASH_BITS)) | self.raw
        if positions:
            order = np.argsort(key, kind="stable")
            key = key[order]
        else:
            key.sort()
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        key = key[first]
        self.at = order[first] if positions else None
        self.values = (key & HASH_MASK).astype(np.int64)
        self.row = (key >> np.uint64(HASH_BITS)).astype(np.int64)
        self.sizes = np.bincount(self.row, minlength=len(lists))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def fingerprints(self) -> np.ndarray:
        """A hash of each text's whole set of shingles (0 for an empty set)."""
        if not len(self.values):
            return np.zeros(len(self.sizes), np.int64)
        h = mix(self.values.astype(np.uint64) + _ODD[2])
        out = np.zeros(len(self.sizes), np.uint64)
        full = self.sizes > 0
        out[full] = np.add.reduceat(h, self.offsets[:-1][full])
        return mix(out + self.sizes.astype(np.uint64)).astype(np.int64)

    def lists(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.values))

    def lowest(self, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``values`` of each text's k lowest hashes (of those marked in ``among``), and the offsets of these."""
        if among is None:
            rank, sizes = np.arange(len(self.values)) - self.offsets[:-1][self.row], self.sizes
            return np.flatnonzero(rank < k), np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int64)
        rows = self.row[among]
        sizes = np.bincount(rows, minlength=len(self.sizes))
        rank = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(sizes)])[rows]
        return np.flatnonzero(among)[rank < k], np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int64)


def blocks(batch: pa.RecordBatch, column: str = "text"):
    """Slices of a batch that are small enough for one Block, with their texts."""
    start, rows, n = 0, 0, batch.num_rows
    texts = batch.column(column).to_pylist()
    size = 0
    for i, t in enumerate(texts):
        rows, size = rows + 1, size + len(t or "") // 2
        if rows >= BLOCK_ROWS or size >= BLOCK_TOKENS or i == n - 1:
            yield batch.slice(start, rows), texts[start : start + rows]
            start, rows, size = i + 1, 0, 0
