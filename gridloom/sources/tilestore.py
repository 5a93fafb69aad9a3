"""A store of horizon tiles: payloads with checks, a table partitioned by tile row, and the move of flat files into it.

A tile is a square of profiles. Its payload is raw (little-endian floats, one profile after another) or
compressed (every profile encoded by `functions.codec`, each after its length in sixteen bits). The store is a Parquet
table partitioned by y, with one row a tile (x, elevation, kind, payload): Spark's commit makes a write
appear whole or not at all, and a reader of some rows of tiles opens their partitions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.codec import SCALE, framed, packed, quantised, unpacked
from gridloom.sources.tables import stored
from gridloom.sources.tilefiles import tile_key

#: Profiles of a tile, and angles of a profile.
PROFILES, SAMPLES = 128 * 128, 1440
#: Floats that older raw files have behind their angles.
TRAILER = 7
KEY = ["y", "x", "elevation", "kind"]
COLUMNS = ["x", "elevation", "kind", "payload", "y"]
STORE_SQL = "x int, elevation int, kind string, payload binary, y int"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and payload of all files in folder and below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("content").alias("payload"))


def kind_of(path: Column) -> Column:
    """raw, compressed, or NULL, by a file's suffix."""
    return F.when(path.rlike(r"(?i)\.bin$"), "raw").when(path.rlike(r"(?i)\.cbin$"), "compressed")


def keyed(files: DataFrame) -> DataFrame:
    """files with y, x, elevation and kind by name, and `valid`: are these all there?"""
    out = files.withColumns({"_k": tile_key(F.col("path")), "kind": kind_of(F.col("path"))})
    return out.select(*files.columns, F.col("_k.y").alias("y"), F.col("_k.x").alias("x"), F.col("_k.elevation").alias("elevation"), "kind", (F.col("_k").isNotNull() & F.col("kind").isNotNull()).alias("valid"))


def decoded(kind: str, payload: bytes, profiles: int, samples: int) -> np.ndarray:
    """Angles of a payload, (profiles, samples); ValueError says what is wrong with it."""
    if kind == "raw":
        whole = profiles * samples
        if len(payload) not in (4 * whole, 4 * (whole + TRAILER)):
            raise ValueError(f"{len(payload)} bytes where {4 * whole} or {4 * (whole + TRAILER)} are due")
        return np.frombuffer(payload, "<f4", whole).reshape(profiles, samples)
    out, at, most = np.empty((profiles, samples), np.float32), 0, 2 * samples
    for i in range(profiles):
        if at + 2 > len(payload):
            raise ValueError(f"the payload ends before the length of profile {i}")
        n = int.from_bytes(payload[at : at + 2], "little")
        if not 0 < n <= most:
            raise ValueError(f"profile {i} has {n} bytes")
        if at + 2 + n > len(payload):
            raise ValueError(f"the payload ends within profile {i}")
        found = unpacked(payload[at + 2 : at + 2 + n])
        if len(found) != samples:
            raise ValueError(f"profile {i} has {len(found)} angles where {samples} are due")
        out[i], at = found / SCALE, at + 2 + n
    if at != len(payload):
        raise ValueError(f"{len(payload) - at} bytes are left behind the last profile")
    return out


def encoded(angles: np.ndarray, kind: str) -> bytes:
    if kind == "raw":
        return np.ascontiguousarray(angles, "<f4").tobytes()
    return framed([packed(quantised(a)) for a in angles])


def payloads(tiles: DataFrame, kind: str = "compressed", profiles: int = PROFILES, samples: int = SAMPLES) -> DataFrame:
    """y, x, elevation, kind and payload of tiles (y, x, elevation, angles: one array, profile after profile)."""
    if kind not in ("raw", "compressed"):
        raise ValueError(f"a payload is raw or compressed, not {kind}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a = batch.column("angles")[i].values.to_numpy(zero_copy_only=False)
                if len(a) != profiles * samples:
                    raise ValueError(f"{len(a)} angles where {profiles} x {samples} are due")
                own = [batch.column(c).slice(i, 1) for c in ("y", "x", "elevation")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([kind]), pa.array([encoded(a.reshape(profiles, samples), kind)], pa.binary())], names=["y", "x", "elevation", "kind", "payload"])

    return tiles.select(*[F.col(c).cast("int").alias(c) for c in ("y", "x", "elevation")], F.col("angles").cast("array<double>").alias("angles")).mapInArrow(encode, "y int, x int, elevation int, kind string, payload binary")


def profiles(tiles: DataFrame, count: int = PROFILES, samples: int = SAMPLES) -> DataFrame:
    """y, x, elevation, profile, angles and problem of tiles (y, x, elevation, kind, payload): a row a profile, or one row that says what is wrong with the payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                y, x, e, kind, payload = (batch.column(c)[i].as_py() for c in ("y", "x", "elevation", "kind", "payload"))
                try:
                    found, problem, n = decoded(kind, payload or b"", count, samples), None, count
                except ValueError as bad:
                    found, problem, n = [None], str(bad), 1
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * n, pa.int32()) for v in (y, x, e)), pa.array(range(n) if problem is None else [None], pa.int32()), pa.array(list(found), pa.list_(pa.float32())), pa.array([problem] * n, pa.string())], names=["y", "x", "elevation", "profile", "angles", "problem"])

    return tiles.select("y", "x", "elevation", "kind", "payload").mapInArrow(read, "y int, x int, elevation int, profile int, angles array<float>, problem string")


def store(spark: SparkSession, root: str) -> DataFrame:
    """The store's tiles; none if it has not been written yet."""
    try:
        return spark.read.schema(STORE_SQL).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE_SQL)


def write(tiles: DataFrame, root: str) -> None:
    """Add tiles (y, x, elevation, kind, payload) to the store; tiles of the same key are replaced, together with the rest of their partitions, in one commit."""
    spark = tiles.sparkSession
    rows = tiles.select(*COLUMNS).dropDuplicates(KEY)
    old = store(spark, root).join(rows.select("y").distinct(), "y", "left_semi").join(rows.select(*KEY), KEY, "left_anti")
    stored(rows.unionByName(old.select(*COLUMNS)), "tiles").repartition("y", "x").write.partitionBy("y").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def sorted_out(files: DataFrame, kept: DataFrame) -> DataFrame:
    """keyed() files with state: invalid by name, skipped where the store has a tile of equal length or another file of the key goes first,
    conflicted where it has one of another length, else moved."""
    named = keyed(files)
    first = named.where("valid").groupBy(*KEY).agg(F.min("path").alias("_first"))
    there = kept.select(*KEY, F.octet_length("payload").cast("long").alias("_there"))
    out = named.join(first, KEY, "left").join(there, KEY, "left")
    state = F.when(~F.col("valid"), "invalid").when(F.col("_there") == F.col("length"), "skipped").when(F.col("_there").isNotNull(), "conflicted").when(F.col("path") > F.col("_first"), "skipped").otherwise("moved")
    return out.withColumn("state", state).drop("_first", "_there")


def migrate(files: DataFrame, root: str) -> DataFrame:
    """Move flat files (path, length, payload) into the store: state and its number of files. What is there stays, so that doing it again moves nothing.

    States are decided against the store as it was; the moved tiles are appended in one commit.
    """
    spark = files.sparkSession
    states = sorted_out(files, store(spark, root))
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}  # four states at most
    moved = states.where("state = 'moved'").select(*COLUMNS)
    moved.repartition("y", "x").write.partitionBy("y").mode("append").parquet(root)
    return spark.createDataFrame([(s, counts.get(s, 0)) for s in ("moved", "skipped", "invalid", "conflicted")], "state string, files long")
