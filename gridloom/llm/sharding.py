"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts are a group, and a group is whole in one shard unless it alone is over a shard's
fair share; such a group is dealt in pieces by the hash of its rows. Groups are vectors (bytes,
tokens, rows). Each is placed where the dot product of its vector with the residual capacity
is highest, among the places that it fits:

* groups over 1/`PARTS` of a shard in some dimension (at most three times PARTS a shard), and the
  pieces of larger ones, are placed one by one on the driver;
* all others are dealt by hash to cells. In its cell every group is placed by the same rule,
  largest first, in one of as many lots as there are shards; a cell streams its sorted groups
  and holds nothing but the lots' residual capacities. The cells' lots are then placed on the
  driver together with the large groups. Their number is bounded by `MOST_CELLS` a shard.

Slots number a shard's rows without gaps. They come from counts of (shard, cell) and row
numbers within a cell, so that no task orders a whole shard.

Defined cases: null text has no bytes and no tokens, and null texts are a group; a text of any
length stays whole, also one larger than a shard; repeated rows (also repeated or null doc_ids)
each get a slot; equal groups go by their key's order; an empty table gives an empty result;
other columns are not carried. The law of this operator is `bytes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import SPACES, WORD_GAP, sized_broadcast, stored, text_of

SHARDS = 40
#: The share of a shard from which a group is placed by itself, and the pieces of a group that is over a whole shard.
PARTS, PIECES = 128, 16
#: Groups that a cell holds on average, and the least and most cells: their lots are what the driver places.
CELL_GROUPS, LEAST_LOT_CELLS, MOST_CELLS = 20_000, 64, 2048
OVERHEAD = 16
#: Cells that a shard's rows are numbered in: one for so many rows, and at least so many.
CELL_ROWS, LEAST_CELLS = 50_000, 64


class Bins:
    """Residual capacities, one row a bin, in shares of a bin."""

    def __init__(self, bins: int, dimensions: int) -> None:
        self.room = np.ones((bins, dimensions))

    def place(self, v: np.ndarray) -> int:
        """The bin that v goes to: the highest dot product with the residual capacity among those that v fits,
        else that which has most room in the first dimension, bytes: the law that must hold."""
        after = self.room - v
        fits = (after >= -1e-9).all(1)
        k = int(np.where(fits, self.room @ v, -np.inf).argmax()) if fits.any() else int(after[:, 0].argmax())
        self.room[k] = after[k]
        return k


def pack(items: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), largest first, by dot product with residual capacity."""
    scaled = items / np.maximum(items.sum(0), 1) * shards  # a shard's fair share is 1 in each dimension
    bins, out = Bins(shards, items.shape[1]), np.zeros(len(items), int)
    for i in np.argsort(-scaled.max(1), kind="stable"):
        out[i] = bins.place(scaled[i])
    return out


def _lotter(shards: int, share: list[float]):
    """Lots of groups that come by cell, largest first; share: what one lot of a cell holds of each dimension."""

    def lots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bins = None, None
        for df in frames:
            v = df[["b", "t", "r"]].to_numpy(float) / np.maximum(share, 1e-9)
            out = np.zeros(len(df), np.int32)
            for i, cell in enumerate(df["cell"].tolist()):
                if cell != now:
                    now, bins = cell, Bins(shards, 3)
                out[i] = bins.place(v[i])
            yield pd.DataFrame({"key": df["key"], "item": "#" + df["cell"].astype(str) + "/" + pd.Series(out, df.index).astype(str)})

    return lots


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs."""
    spark = docs.sparkSession
    body = F.btrim(text_of(), F.lit(SPACES))
    rows = stored(docs.select(
        "doc_id",
        (F.octet_length(text_of()) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.when(body == "", 0).otherwise(F.size(F.split(body, WORD_GAP, -1))).cast("long").alias("tokens"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("key"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("deal"),
    ), "sizes")
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    groups = stored(rows.groupBy("key").agg(*sums), "groups")
    whole = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btr"]).first()
    of_shard = F.greatest(*[F.col(c) * (float(shards) / max(1, whole[c])) for c in "btr"])
    groups = groups.withColumn("share", of_shard)
    # at most three times PARTS a shard
    heavy = stored(groups.where(F.col("share") > 1 / PARTS).select("key", "b", "t", "r", F.when(F.col("share") > 1, F.ceil(F.col("share") * PIECES)).otherwise(1).cast("int").alias("pieces")), "heavy")
    light = groups.where(F.col("share") <= 1 / PARTS)
    rest = light.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btr"]).first()
    cells = max(LEAST_LOT_CELLS, min(MOST_CELLS, rest["n"] // CELL_GROUPS))
    dealt = light.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")).repartition("cell").sortWithinPartitions("cell", F.desc("share"), "key")
    lots = stored(dealt.select("key", "b", "t", "r", "cell").mapInPandas(_lotter(shards, [rest[c] / (cells * shards) for c in "btr"]), "key string, item string"), "lots")
    large = rows.join(F.broadcast(heavy.select("key", "pieces")), "key").withColumn("item", F.when(F.col("pieces") > 1, F.concat("key", F.lit("/"), F.pmod("deal", "pieces").cast("string"))).otherwise(F.col("key"))).drop("pieces")
    small = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(sized_broadcast(lots, rest["n"], 200_000), "key")
    known = stored(large.unionByName(small), "items")
    items = known.groupBy("item").agg(*sums).orderBy("item").collect()  # lots, large groups and pieces: bounded by shards, PARTS, PIECES and MOST_CELLS
    to = pack(np.array([[x["b"], x["t"], x["r"]] for x in items], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(x["item"], int(k)) for x, k in zip(items, to, strict=True)], "item string, shard int")
    parts = max(LEAST_CELLS, whole["r"] // (shards * CELL_ROWS))
    out = known.join(F.broadcast(placed), "item").withColumn("part", F.pmod("deal", F.lit(parts)).cast("int"))
    counts = out.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # shards x parts
    before, at = [], {}
    for k, c, n in sorted(tuple(x) for x in counts):
        before.append((k, c, at.get(k, 0)))
        at[k] = at.get(k, 0) + n
    offset = spark.createDataFrame(before, "shard int, part int, before long")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("deal", "doc_id"))
    slot = (F.col("before") + number - 1).cast("long")
    return out.join(F.broadcast(offset), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
