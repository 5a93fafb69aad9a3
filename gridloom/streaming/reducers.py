"""Reducers of tile series, chunk by chunk: init, update and finalize, the same in batch and in streams.

A chunk is (tile, start, times, total, channels, values): `times` time steps of a tile from step
`start` of `total`, values in the order of time, channel, cell, NaN where there are none. Several reducers
go over the same chunks in one pass, each giving one value a cell. Chunks of a tile must come in order and
without gaps, and no tile may be left unfinished; anything else is an error, not a wrong value.

In batch, chunks are sorted by tile and start and stream through the tasks, so that one
tile's states and one batch of chunks are in memory. In streams, a tile's states are kept by
`transformWithState` between triggers, and removed when the tile is finished.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNK_SQL = "tile long, start int, times int, total int, channels int, values array<double>"
OUT_SQL = "tile long, reducer string, values array<double>"


class Reducer(Protocol):
    """What a user writes: any picklable state; chunk is an array of (times, channels, cells)."""

    name: str

    def init(self, cells: int) -> Any: ...
    def update(self, state: Any, chunk: np.ndarray, step: float) -> Any: ...
    def finalize(self, state: Any) -> np.ndarray: ...


@dataclass(frozen=True)
class Average:
    """Mean of a channel times scale, over the steps that have a value."""

    name: str
    channel: int = 0
    scale: float = 1.0

    def init(self, cells: int):
        return np.zeros(cells), np.zeros(cells, np.int64)

    def update(self, state, chunk, step):
        v = chunk[:, self.channel]
        return state[0] + np.nansum(v, 0), state[1] + (~np.isnan(v)).sum(0)

    def finalize(self, state):
        return np.where(state[1] > 0, state[0] / np.maximum(state[1], 1) * self.scale, np.nan)


#: Comparisons that a condition may name.
TESTS = {">=": np.greater_equal, ">": np.greater, "<=": np.less_equal, "<": np.less}


def holds(chunk: np.ndarray, where: Sequence[tuple[int, str, float]]) -> np.ndarray:
    """(times, cells): all conditions (channel, comparison, threshold) hold; a missing value meets none."""
    out = np.ones((chunk.shape[0], chunk.shape[2]), bool)
    for channel, test, threshold in where:
        v = chunk[:, channel]
        out &= TESTS[test](v, threshold) & ~np.isnan(v)
    return out


@dataclass(frozen=True)
class Duration:
    """Time for which all conditions hold."""

    name: str
    where: tuple[tuple[int, str, float], ...]

    def init(self, cells: int):
        return np.zeros(cells)

    def update(self, state, chunk, step):
        return state + holds(chunk, self.where).sum(0) * step

    def finalize(self, state):
        return state


@dataclass(frozen=True)
class LongestRun:
    """The longest time without a break for which all conditions hold, over chunks' borders too."""

    name: str
    where: tuple[tuple[int, str, float], ...]

    def init(self, cells: int):
        return np.zeros(cells, np.int64), np.zeros(cells, np.int64), 1.0

    def update(self, state, chunk, step):
        now, best, _ = state
        for flag in holds(chunk, self.where):
            now = np.where(flag, now + 1, 0)
            best = np.maximum(best, now)
        return now, best, step

    def finalize(self, state):
        return state[1] * state[2]


class Progress:
    """One tile under way."""

    def __init__(self, reducers: Sequence[Reducer], step: float) -> None:
        self.reducers, self.step, self.next, self.states = reducers, step, 0, None

    def take(self, tile: int, start: int, times: int, total: int, channels: int, values: np.ndarray) -> bool:
        """Give a chunk to all reducers; was it the tile's last?"""
        if start != self.next:
            raise ValueError(f"tile {tile}: a chunk came that starts at {start}, {self.next} was due")
        if times < 1 or start + times > total:
            raise ValueError(f"tile {tile}: steps {start} to {start + times} of {total}")
        if channels < 1 or len(values) % (times * channels):
            raise ValueError(f"tile {tile}: {len(values)} values for {times} steps and {channels} channels")
        chunk = np.asarray(values, float).reshape(times, channels, -1)
        if self.states is None:
            self.states = [r.init(chunk.shape[2]) for r in self.reducers]
        self.states = [r.update(s, chunk, self.step) for r, s in zip(self.reducers, self.states, strict=True)]
        self.next = start + times
        return self.next == total

    def results(self) -> list[tuple[str, np.ndarray]]:
        return [(r.name, np.asarray(r.finalize(s), float)) for r, s in zip(self.reducers, self.states, strict=True)]


def _checked(reducers: Sequence[Reducer]) -> list[Reducer]:
    names = [r.name for r in reducers]
    if not names or len(set(names)) < len(names):
        raise ValueError(f"reducers need names of their own, and there must be one: {names}")
    return list(reducers)


def reduced(chunks: DataFrame, reducers: Sequence[Reducer], step: float = 1.0) -> DataFrame:
    """tile, reducer and values (a cell each) of all tiles."""
    reducers = _checked(reducers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tile", "start", "times", "total", "channels")]
            for *row, values in zip(*columns, batch.column("values"), strict=True):
                if row[0] != at or now is None:
                    if now is not None:
                        raise ValueError(f"tile {at} is left after {now.next} steps")
                    at, now = row[0], Progress(reducers, step)
                if now.take(*row, values.values.to_numpy(zero_copy_only=False)):
                    names, found = zip(*now.results(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(names), pa.int64()), pa.array(names), pa.array(found, pa.list_(pa.float64()))], names=["tile", "reducer", "values"])
                    now = None
        if now is not None:
            raise ValueError(f"tile {at} is left after {now.next} steps")

    return chunks.repartition("tile").sortWithinPartitions("tile", "start").mapInArrow(run, OUT_SQL)


class _Keeper(StatefulProcessor):
    """A tile's progress as stored bytes between triggers."""

    def __init__(self, reducers: list[Reducer], step: float) -> None:
        self.reducers, self.step = reducers, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("progress", "next int, states binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = Progress(self.reducers, self.step)
        if self.kept.exists():
            now.next, states = self.kept.get()
            now.states = pickle.loads(states)  # noqa: S301  written below
        done = False
        for r in pd.concat(list(rows)).sort_values("start").itertuples():
            if done:
                raise ValueError(f"tile {key[0]}: a chunk came after the last")
            done = now.take(int(key[0]), int(r.start), int(r.times), int(r.total), int(r.channels), r.values)
        if done:
            self.kept.clear()
            names, found = zip(*now.results(), strict=True)
            yield pd.DataFrame({"tile": [int(key[0])] * len(names), "reducer": names, "values": [x.tolist() for x in found]})
        else:
            self.kept.update((now.next, pickle.dumps(now.states)))

    def close(self) -> None:
        pass


def reduced_stream(chunks: DataFrame, reducers: Sequence[Reducer], step: float = 1.0) -> DataFrame:
    """The same of a stream of chunks: a tile's rows come when its last chunk has. Needs the RocksDB state store (`stored_states`)."""
    return chunks.groupBy("tile").transformWithStateInPandas(_Keeper(_checked(reducers), step), OUT_SQL, "append", "None")


def stored_states(spark) -> None:
    """transformWithState keeps its states in RocksDB only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def chunked(series: DataFrame, cells: int, times: int, channels: Sequence[str], tile: str = "tile", slot: str = "slot", t: str = "t") -> DataFrame:
    """Chunks of at most `times` steps of series (tile, slot 0 to cells - 1, t from 0, channels): one row a cell and step, absent ones are NaN."""
    total = series.agg((F.max(t) + 1).cast("int").alias("total"))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        start, total = key[1].as_py() * times, key[2].as_py()
        n = min(times, total - start)
        out = np.full((n, len(channels), cells), np.nan)
        at, of = rows.column("t").to_numpy() - start, rows.column("slot").to_numpy()
        for i in range(len(channels)):
            out[at, i, of] = rows.column(f"c{i}").to_numpy()
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), **{k: pa.array([v], pa.int32()) for k, v in (("start", start), ("times", n), ("total", total), ("channels", len(channels)))}, "values": pa.array([out.ravel()], pa.list_(pa.float64()))})

    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(channels)]
    rows = series.select(F.col(tile).cast("long").alias("tile"), F.col(slot).cast("int").alias("slot"), F.col(t).cast("int").alias("t"), *columns).join(F.broadcast(total))  # one row
    return rows.withColumn("part", F.expr(f"cast(t div {times} as int)")).groupBy("tile", "part", "total").applyInArrow(packed, CHUNK_SQL)
