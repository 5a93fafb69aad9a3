"""Word hashing for the operators that run numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that a worker remembers (about 20 MB); beyond it the memory is emptied.
REMEMBERED = 100_000


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += h[j : n + j]
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs; the whole text is one run if it is shorter, none if it is empty."""
    return rolling(h, min(k, len(h))) if len(h) else h


def rows_of(batch: pa.RecordBatch, most: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about `most` bytes; a longer text stands alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary() if pa.types.is_string(batch.column("text").type) else pa.large_binary()).to_pylist()
