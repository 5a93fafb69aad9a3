"""Dense blocks: a grid as one row a square of cells, and array functions over blocks with halos.

A block is (br, bc, height, width, cells): `size` x `size` values in row order, NaN where there is none;
blocks start at multiples of size, so that blocks at a grid's edge are filled up with NaN. Against a row a cell, a
shuffle moves eight bytes a cell and no keys, and neighbours exchange only the strips that
their halos need. Blocks without any row do not exist and count as NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 64
BLOCK_SQL = "br long, bc long, cells array<double>"


def _row(br: int, bc: int, cells: np.ndarray) -> pa.Table:
    return pa.table({"br": pa.array([br], pa.int64()), "bc": pa.array([bc], pa.int64()), "cells": pa.array([cells.ravel()], pa.list_(pa.float64()))})


def dense(g: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of g (row, col, v): the one shuffle that moves single cells."""

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        br, bc = (k.as_py() for k in key)
        cells = np.full((size, size), np.nan)
        row, col, v = (rows.column(c).to_numpy() for c in ("row", "col", "v"))  # a missing v is NaN
        cells[row - br * size, col - bc * size] = v
        return _row(br, bc, cells)

    at = [F.floor(F.col(c) / size).cast("long").alias(n) for c, n in (("row", "br"), ("col", "bc"))]
    return g.select(*at, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v")).groupBy("br", "bc").applyInArrow(packed, BLOCK_SQL)


def _ranges(step: int, size: int, halo: int) -> tuple[slice, slice]:
    """What a block gives to the neighbour `step` blocks on, along one axis, and where that puts it in its haloed array."""
    if step == 0:
        return slice(0, size), slice(halo, halo + size)
    return (slice(size - halo, size), slice(0, halo)) if step > 0 else (slice(0, halo), slice(halo + size, None))


def exchanged(blocks: DataFrame, halo: int, size: int = SIZE) -> DataFrame:
    """blocks whose cells are (size + 2 halo) squares: each with strips of its up to eight neighbours, NaN beyond them."""
    if not 0 <= halo <= size:
        raise ValueError(f"a halo of {halo} cells does not fit blocks of {size}")
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)] if halo else [(0, 0)]

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for br, bc, cells in zip(batch.column("br").to_pylist(), batch.column("bc").to_pylist(), batch.column("cells"), strict=True):
                whole = cells.values.to_numpy().reshape(size, size)
                parts = [(br + a, bc + b, a, b, whole[_ranges(a, size, halo)[0], _ranges(b, size, halo)[0]].ravel()) for a, b in steps]
                parts = [p for p in parts if p[2:4] == (0, 0) or not np.isnan(p[4]).all()]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["br", "bc", "a", "b", "cells"])

    def put(key: tuple, rows: pa.Table) -> pa.Table:
        parts = rows.select(["a", "b"]).to_pydict() | {"cells": [x.values.to_numpy() for x in rows.column("cells")]}
        out = np.full((size + 2 * halo, size + 2 * halo), np.nan)
        for a, b, cells in zip(parts["a"], parts["b"], parts["cells"], strict=True):
            at = _ranges(a, size, halo)[1], _ranges(b, size, halo)[1]
            out[at] = cells.reshape(out[at].shape)
        own = (0, 0) in zip(parts["a"], parts["b"], strict=True)  # else these are strips for a block that is not there
        return _row(key[0].as_py(), key[1].as_py(), out).slice(0, int(own))

    return blocks.mapInArrow(strips, "br long, bc long, a int, b int, cells array<double>").groupBy("br", "bc").applyInArrow(put, BLOCK_SQL)


def transformed(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray], halo: int = 0, size: int = SIZE) -> DataFrame:
    """blocks with f of their cells: f takes a (size + 2 halo) square and gives the size square inside it, of any number type."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                whole = batch.column("cells")[i].values.to_numpy().reshape(size + 2 * halo, size + 2 * halo)
                out = np.asarray(f(whole), float)
                if out.shape != (size, size):
                    raise ValueError(f"the function gave {out.shape} for a block of {size} x {size}")
                yield pa.RecordBatch.from_arrays([batch.column("br")[i : i + 1], batch.column("bc")[i : i + 1], pa.array([out.ravel()], pa.list_(pa.float64()))], names=["br", "bc", "cells"])

    return (exchanged(blocks, halo, size) if halo else blocks).mapInArrow(mapped, BLOCK_SQL)


def cells(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """row, col, v of the blocks' cells that have a value."""
    out = blocks.select("br", "bc", F.posexplode("cells").alias("at", "v")).where(~F.isnan("v"))
    return out.select((F.col("br") * size + F.expr(f"at div {size}")).alias("row"), (F.col("bc") * size + F.col("at") % size).alias("col"), "v")


def gradient(axis: int, res: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """A function for transformed() with halo 1: central differences, one-sided next to nothing, as at a grid's edge."""

    def of(z: np.ndarray) -> np.ndarray:
        z = z if axis == 0 else z.T
        before, mid, after = z[:-2, 1:-1], z[1:-1, 1:-1], z[2:, 1:-1]
        out = np.where(np.isnan(before), (after - mid) / res, np.where(np.isnan(after), (mid - before) / res, (after - before) / (2 * res)))
        out = np.where(np.isnan(mid), np.nan, out)
        return out if axis == 0 else out.T

    return of


def opening(n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function for transformed() with halo 2 n: n erosions and n dilations of what is over 0; nothing counts as unset."""

    def of(z: np.ndarray) -> np.ndarray:
        out = np.nan_to_num(z) > 0
        for pick in (np.minimum, np.maximum):
            for _ in range(n):
                rows = pick(pick(out[:-2], out[1:-1]), out[2:])
                out = pick(pick(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
        return np.where(np.isnan(z[2 * n : -2 * n, 2 * n : -2 * n]), np.nan, out)

    return of
