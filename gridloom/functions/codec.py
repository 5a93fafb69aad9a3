"""Horizon profiles as bytes: angles to int16, the first as it is, then differences of one or two bytes; blocks with their length before them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str

SPAN = 50.0
SCALE = 32767 / SPAN
LOW, HIGH = -16384, 16383


def quantised(angles: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.asarray(angles, float), -SPAN, SPAN) * SCALE).astype(np.int32)


def _reached(v: np.ndarray) -> np.ndarray:
    """The values that differences of fifteen bits reach: what a step is clamped by goes to the next one."""
    if len(v) < 2 or np.abs(np.diff(v)).max() <= HIGH:
        return v
    out = v.copy()
    for i in range(1, len(v)):  # only profiles with a step past fifteen bits
        out[i] = out[i - 1] + min(HIGH, max(LOW, int(v[i]) - int(out[i - 1])))
    return out


def packed(values: np.ndarray) -> bytes:
    """The first value in sixteen bits, then differences: seven bits (-64..62) in a byte, else fifteen in two with the high bit set."""
    v = np.asarray(values, np.int32)
    if not len(v):
        return b""
    d = np.diff(_reached(v))
    short = (d >= -64) & (d < 63)
    size = np.where(short, 1, 2)
    at = 2 + np.cumsum(size) - size
    out = np.zeros(2 + int(size.sum()), np.uint8)
    out[:2] = (int(v[0]) >> 8) & 0xFF, int(v[0]) & 0xFF
    out[at[short]] = d[short] & 0x7F
    out[at[~short]], out[at[~short] + 1] = ((d[~short] >> 8) & 0x7F) | 0x80, d[~short] & 0xFF
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    if not len(b):
        return np.zeros(0, np.int32)
    first, b = ((b[0] << 8 | b[1]) ^ 0x8000) - 0x8000, b[2:]
    # a byte is a step's first one unless the byte before it opens a step of two
    opens, at, i, high = [], 0, 0, (b & 0x80).tolist()
    while i < len(high):
        opens.append(i)
        i += 2 if high[i] else 1
    at = np.array(opens, int)
    long = (b[at] & 0x80) > 0
    d = np.where(long, (b[at] & 0x7F) << 8 | b[np.minimum(at + 1, len(b) - 1)], b[at]) if len(at) else np.zeros(0, np.int32)
    d = np.where(long, (d ^ 0x4000) - 0x4000, (d ^ 0x40) - 0x40) if len(at) else d
    return np.cumsum(np.r_[first, d]).astype(np.int32)


def framed(blocks: list[bytes]) -> bytes:
    """Blocks one after another, each after its length in sixteen bits."""
    return b"".join(len(b).to_bytes(2, "little") + b for b in blocks)


def unframed(data: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(data):
        n = int.from_bytes(data[i : i + 2], "little")
        if i + 2 + n > len(data):
            raise ValueError("a block ends past the data")
        out.append(data[i + 2 : i + 2 + n])
        i += 2 + n
    return out


@F.pandas_udf(T.BinaryType())
def _encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else packed(quantised(x)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda b: None if b is None else (unpacked(b) / SCALE).tolist())


def encode(profiles: ColumnOrName) -> Column:
    """Bytes of an array of angles; NULL stays."""
    return _encoded(profiles)


def decode(blocks: ColumnOrName) -> Column:
    """Array of angles of encoded bytes; NULL stays."""
    return _decoded(blocks)
