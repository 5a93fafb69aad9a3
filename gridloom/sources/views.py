"""Grids, cubes, intervals and gazetteers read from the data folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.tables import table


def grid(spark: SparkSession, sf_dir: str, value: str = "v") -> DataFrame:
    """Dense grid (row, col, v, label): a row an embedding, a column a position in it."""
    e = table(spark, sf_dir, "embeddings")
    g = e.select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("col", value))
    return g.withColumn(value, F.when(F.isnan(value), None).otherwise(F.col(value).cast("double")))


def second_grid(spark: SparkSession, sf_dir: str, value: str = "w") -> DataFrame:
    """The grid mirrored in its columns, without data where (row + col) is divisible by seven."""
    g = grid(spark, sf_dir, value).withColumn("col", 63 - F.col("col")).drop("label")
    return g.withColumn(value, F.when((F.col("row") + F.col("col")) % 7 != 0, F.col(value)))


GRID_SQL = "G AS (SELECT vec_id AS row, label, unnest(range(0, 64))::INTEGER AS col, unnest(embedding)::DOUBLE AS v FROM embeddings)"
SECOND_SQL = "G2 AS (SELECT row, (63 - col)::INTEGER AS col, CASE WHEN (row + 63 - col) % 7 <> 0 THEN v END AS w FROM G)"


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named features with type, importance, diameter, centre and extent, from the part table."""
    p = table(spark, sf_dir, "part")
    x, y = F.pmod(F.col("p_partkey") * 37, F.lit(360)).cast("double"), (F.pmod(F.col("p_partkey") * 53, F.lit(180)) - 90).cast("double")
    clean = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "))
    d = F.col("p_size") / 10.0
    g = p.select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"), clean.alias("clean_name"), F.col("p_type").alias("feature_type"), F.col("p_retailprice").alias("importance"), F.col("p_size").cast("double").alias("diameter"), x.alias("x"), y.alias("y"), d.alias("d"))
    box = F.col("feature_id") % 5 != 0
    return g.select("feature_id", "name", "clean_name", "feature_type", "importance", "diameter", "x", "y", *[F.when(box, c).alias(n) for n, c in (("min_x", F.col("x") - F.col("d")), ("max_x", F.col("x") + F.col("d")), ("min_y", F.col("y") - F.col("d")), ("max_y", F.col("y") + F.col("d")))])


GAZETTEER_SQL = """Z0 AS (
  SELECT p_partkey AS feature_id, p_name AS name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS clean_name, p_type AS feature_type, p_retailprice AS importance,
    p_size::DOUBLE AS diameter, ((p_partkey * 37) % 360)::DOUBLE AS x, ((p_partkey * 53) % 180 - 90)::DOUBLE AS y, p_size / 10.0::DOUBLE AS d FROM part
), Z AS (
  SELECT * EXCLUDE (d), CASE WHEN feature_id % 5 <> 0 THEN x - d END AS min_x, CASE WHEN feature_id % 5 <> 0 THEN x + d END AS max_x,
    CASE WHEN feature_id % 5 <> 0 THEN y - d END AS min_y, CASE WHEN feature_id % 5 <> 0 THEN y + d END AS max_y FROM Z0)"""
