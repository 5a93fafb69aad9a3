"""Counting quotient filters: sorted, lossless counters of packed n-grams of word ids.

The ids of an n-gram are packed into two limbs of `bits` a word and permuted by a Feistel network,
which is invertible and spreads any n-grams evenly. A permuted key's top bits choose its
range, the next ones are its quotient, all others its full remainder: nothing is lost, so that
counts are exact and n-grams come back from the filter alone. A filter holds, in the order of
keys, for one range

* a bit a quotient: does it occur? and a bit a slot: does a quotient's run end here?
* a bit a slot: is its count over 1? Only those have a counter: a byte, and eight more from 257 on;
* the remainders, each in as few whole bytes as hold its bits.

Filters of equal range are merged by their sorted keys.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np

HEAD = "<IBII"
U = np.uint64


class Keys(NamedTuple):
    """Permuted n-grams in two limbs, and how often each occurs."""

    hi: np.ndarray
    lo: np.ndarray
    n: np.ndarray


class Shape:
    """How n-grams of `order` ids, each of `bits` bits, become keys."""

    def __init__(self, order: int, bits: int) -> None:
        self.order, self.bits, self.head = order, bits, order // 2
        self.high, self.low = self.head * bits, (order - self.head) * bits
        if self.low > 63:
            raise ValueError(f"{order} ids of {bits} bits do not fit two limbs of 63")

    def _mixed(self, x: np.ndarray, turn: int, width: int) -> np.ndarray:
        x = (x + U(turn + 1)) * U(0x9E3779B97F4A7C15)
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        return (x ^ x >> U(32)) & U((1 << width) - 1)

    def permuted(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of n-grams whose i-th ids are in the i-th column."""
        hi, lo = self._packed(columns[: self.head]), self._packed(columns[self.head :])
        for turn in range(0, 4, 2):
            hi ^= self._mixed(lo, turn, self.high)
            lo ^= self._mixed(hi, turn + 1, self.low)
        return hi, lo

    def restored(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        """The columns of ids that the keys were made of."""
        hi, lo = hi.copy(), lo.copy()
        for turn in (2, 0):
            lo ^= self._mixed(hi, turn + 1, self.low)
            hi ^= self._mixed(lo, turn, self.high)
        return self._unpacked(hi, self.head) + self._unpacked(lo, self.order - self.head)

    def _packed(self, columns: list[np.ndarray]) -> np.ndarray:
        out = columns[0].astype(U)
        for c in columns[1:]:
            out = out << U(self.bits) | c.astype(U)
        return out

    def _unpacked(self, x: np.ndarray, count: int) -> list[np.ndarray]:
        return [(x >> U(self.bits * i) & U((1 << self.bits) - 1)).astype(np.int64) for i in range(count - 1, -1, -1)]

    def counted(self, parts: list[Keys]) -> Keys:
        """One sorted entry a key, with the sum of its counts."""
        hi, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(hi):
            return Keys(hi, lo, n)
        order = np.argsort(hi << U(self.low) | lo, kind="stable") if self.high + self.low <= 64 else np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        return Keys(hi[new], lo[new], np.add.reduceat(n, new))

    def filters(self, keys: Keys, spread: int) -> Iterator[tuple[int, bytes]]:
        """(range, filter) of sorted keys; the top `spread` bits are the range."""
        rest = self.high - spread
        ranges = keys.hi >> U(rest)
        at = [0, *np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, len(ranges)] if len(ranges) else []
        for a, b in pairwise(at):
            yield int(ranges[a]), self._filter(keys.hi[a:b] & U((1 << rest) - 1), keys.lo[a:b], keys.n[a:b], rest)

    def _filter(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, rest: int) -> bytes:
        m, q = len(hi), rest
        while q > 8 and 1 << q > 8 * m:
            q -= 8
        quotient = hi >> U(rest - q)
        occupied = np.zeros(1 << q, np.uint8)
        occupied[quotient.astype(np.int64)] = 1
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]])
        more = n > 1
        extra = n[more] - 2
        small, large = np.minimum(extra, 255).astype(np.uint8), extra[extra >= 255].astype("<u8")
        remainder = hi & U((1 << rest - q) - 1)
        return b"".join([
            struct.pack(HEAD, m, q, len(small), len(large)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(more).tobytes(),
            small.tobytes(), large.tobytes(), _whole(remainder, rest - q), _whole(lo, self.low),
        ])

    def keys(self, spread: int, number: int, filter_: bytes) -> Keys:
        """The sorted keys and counts of a filter."""
        rest = self.high - spread
        m, q, smalls, larges = struct.unpack_from(HEAD, filter_)
        at = struct.calcsize(HEAD)

        def bits(count: int) -> np.ndarray:
            nonlocal at
            size = -(-count // 8)
            out = np.unpackbits(np.frombuffer(filter_, np.uint8, size, at), count=count)
            at += size
            return out

        occupied, ends, more = np.flatnonzero(bits(1 << q)), bits(m), bits(m).astype(bool)
        extra = np.frombuffer(filter_, np.uint8, smalls, at).astype(np.int64)
        at += smalls
        extra[extra == 255] = np.frombuffer(filter_, "<u8", larges, at)
        at += 8 * larges
        n = np.ones(m, np.int64)
        n[more] = extra + 2
        quotient = occupied[np.cumsum(ends, dtype=np.int64) - ends].astype(U)
        remainder = _read(filter_, at, m, rest - q)
        at += m * -(-(rest - q) // 8)
        hi = U(number) << U(rest) | quotient << U(rest - q) | remainder
        return Keys(hi, _read(filter_, at, m, self.low), n)


def _whole(x: np.ndarray, width: int) -> bytes:
    """Values in as few whole bytes as hold width bits."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)]).tobytes()


def _read(data: bytes, at: int, m: int, width: int) -> np.ndarray:
    size, out = -(-width // 8), np.zeros((m, 8), np.uint8)
    if size:
        out[:, :size] = np.frombuffer(data, np.uint8, m * size, at).reshape(m, size)
    return out.view("<u8").ravel().astype(U)
