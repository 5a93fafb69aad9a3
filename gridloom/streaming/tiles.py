"""Streams of tile chunks: keyed state that takes chunks in order and gives a tile out when all have come."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.sources.tables import shared_dir

CHUNK = "tile long, position int, of int, total decimal(38,9), high double, n long"
OUT = "tile long, chunks int, mean double, high double"
STATE = "expected int, total string, high double, n long"


def chunk_stream(spark: SparkSession, folder: str, files_a_trigger: int = 4) -> DataFrame:
    """A stream of chunk files; few a trigger, which bounds what is in memory."""
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Sums are decimals, which come out alike in any order; a tile without values has no mean and no high."""
    expected, total, high, n = state.get if state.exists else (0, "0", None, 0)
    total = Decimal(total)
    rows = pd.concat(list(batches)).sort_values("position")
    of, due = int(rows["of"].iloc[0]), list(range(expected, expected + len(rows)))
    if rows["position"].tolist() != due or due[-1] >= of:
        raise ValueError(f"tile {key[0]}: chunks {rows['position'].tolist()} came where {due} of {of} were due")
    total, n, top = total + sum(rows["total"].dropna(), Decimal(0)), n + int(rows["n"].sum()), rows["high"].max()
    high = top if high is None or (top == top and top > high) else high
    high = None if high is None or high != high else float(high)
    if due[-1] + 1 == of:
        state.remove()
        yield pd.DataFrame({"tile": [key[0]], "chunks": [of], "mean": [float(total / n) if n else None], "high": [high]})
    else:
        state.update((due[-1] + 1, str(total), high, n))


def reduced(chunks: DataFrame) -> DataFrame:
    """tile, chunks, mean and high of every tile whose chunks have all come, in order."""
    return chunks.groupBy("tile").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def complete(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """done, the finished tiles of chunks, which all must be: a tile that still waits for chunks is an error."""
    left = chunks.select("tile").distinct().join(done, "tile", "left_anti").limit(5).collect()
    if left:
        raise ValueError(f"tiles are left without all of their chunks: {[r['tile'] for r in left]}")
    return done


def run(stream: DataFrame, name: str, source: str | None = None) -> DataFrame:
    """Run a stream over all that there is, through files in the shared folder, and read the result.

    A run with the same source folder goes on where the one before stopped.
    """
    spark = stream.sparkSession
    at = f"{source}-{name}" if source else f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
