"""Helpers that several operators share: word patterns, sized broadcasts, rows carried whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import BROADCAST_ROWS, sized_broadcast, stored, table

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "SPACES", "WORD_GAP", "byte_sized_broadcast", "sized_broadcast", "stored", "table", "text_of", "whole_rows"]

#: Words of the removal and near-duplicate operators: runs of anything but these bytes.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of values up to which a lookup with texts or arrays is broadcast.
BROADCAST_BYTES = 32 << 20


def byte_sized_broadcast(df: DataFrame, size: int) -> DataFrame:
    """df with a broadcast hint if its values have few enough bytes, else unchanged: Spark shuffles it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def whole_rows(docs: DataFrame) -> DataFrame:
    """`_row` (all of docs' columns), doc_id and th, the hash of text: no column of docs can clash with an operator's own."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"))
