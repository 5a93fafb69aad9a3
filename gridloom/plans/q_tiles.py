"""Queries of reducers over tile chunks and of the tile store."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from gridloom.plans.q_time import HD, dense
from gridloom.plans.registry import query
from gridloom.sources import tilestore as S
from gridloom.sources.tables import shared_dir, stored, table
from gridloom.streaming import reducers as R
from gridloom.streaming import tiles

CELLS, TIMES = 8, 192


class Swing:
    """A reducer as a user writes one: highest less lowest value of the first channel."""

    name = "swing"

    def init(self, cells):
        return np.full(cells, np.inf), np.full(cells, -np.inf)

    def update(self, state, chunk, step):
        return np.fmin(state[0], np.fmin.reduce(chunk[:, 0], 0)), np.fmax(state[1], np.fmax.reduce(chunk[:, 0], 0))

    def finalize(self, state):
        return np.where(state[1] >= state[0], state[1] - state[0], np.nan)


SUNNY = ((0, ">=", 20.0), (1, ">=", 6.0))
REDUCERS = (R.Average("mean"), R.Duration("sunny", SUNNY), R.LongestRun("longest", SUNNY), Swing())

REDUCED = HD + """, L AS (SELECT min(t) AS t0 FROM D), F AS (SELECT cell, t, value, coalesce(value >= 20 AND t % 24 >= 6, false) AS f FROM D),
 I AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY t) - row_number() OVER (PARTITION BY cell, f ORDER BY t) AS g FROM F),
 Q AS (SELECT cell, max(n) AS n FROM (SELECT cell, g, count(*) AS n FROM I WHERE f GROUP BY cell, g) GROUP BY cell),
 V AS (SELECT cell, avg(value) AS mean, count(*) FILTER (f) / 2.0 AS sunny, coalesce(any_value(n), 0) / 2.0 AS longest, max(value) - min(value) AS swing FROM F LEFT JOIN Q USING (cell) GROUP BY cell)
 SELECT cell, reducer, round(x::DOUBLE, 9) AS value FROM (SELECT cell, unnest(['mean', 'sunny', 'longest', 'swing']) AS reducer, unnest([mean, sunny, longest, swing]) AS x FROM V)"""


def chunks(spark, sf_dir):
    """Two channels, the hourly value and the hour of the day, of eight cells a tile in chunks of 192 hours."""
    d = dense(spark, sf_dir)
    first = d.agg(F.min("t").alias("t0"))
    d = d.join(F.broadcast(first)).select(F.floor(F.col("cell") / CELLS).alias("tile"), (F.col("cell") % CELLS).alias("slot"), (F.col("t") - F.col("t0")).alias("t"), "value", (F.col("t") % 24).alias("hour"))  # one row
    return stored(R.chunked(d, CELLS, TIMES, ["value", "hour"]), "chunks")


def by_cell(found):
    """A row a cell that occurs: one whose hours have a value."""
    out = found.select("tile", "reducer", F.posexplode("values").alias("slot", "value")).select((F.col("tile") * CELLS + F.col("slot")).cast("long").alias("cell"), "reducer", F.round("value", 9).alias("value")).where("value is not null and not isnan(value)")
    known = out.where("reducer = 'mean'").select("cell")
    return out.join(known, "cell", "left_semi")


@query("agg_reducer_protocol", REDUCED)
def reducer_protocol(spark, sf_dir):
    return by_cell(R.reduced(chunks(spark, sf_dir), REDUCERS, 0.5))


@query("str_reducer_protocol", REDUCED)
def reducer_stream(spark, sf_dir):
    """The same by a stream that stops half-way and is started again from its checkpoint."""
    rows = chunks(spark, sf_dir)
    folder = f"{shared_dir(spark)}/gridloom-chunks-{uuid.uuid4().hex}"
    half = rows.agg(F.expr(f"cast(max(start) div {2 * TIMES} as int) * {TIMES}")).first()[0] or 0
    R.stored_states(spark)
    done = None
    for part in (rows.where(F.col("start") < half), rows.where(F.col("start") >= half)):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(R.CHUNK_SQL).parquet(folder)
        done = tiles.run(R.reduced_stream(stream, REDUCERS, 0.5), "reducers", folder)
    return by_cell(tiles.complete(rows, done))


#: A tile a vector, of one profile; every seventh file has a bad name. Of every fifth and eleventh key the store has a tile, of the eleventh one of another length.
SAMPLES = 64


def flat_files(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("angles"))
    v = v.withColumns({"y": (F.col("k") % 10 * 128).cast("int"), "x": (F.floor(F.col("k") / 10) * 128).cast("int"), "elevation": F.lit(20)})
    return v, S.payloads(v, "raw", 1, SAMPLES)


STATES = "SELECT CASE WHEN vec_id % 7 = 0 THEN 'invalid' WHEN vec_id % 11 = 0 THEN 'conflicted' WHEN vec_id % 5 = 0 THEN 'skipped' ELSE 'moved' END AS a FROM embeddings"


@query("src_tile_migration", f"""WITH S AS ({STATES}), T AS (SELECT 1 AS run, a AS state FROM S UNION ALL SELECT 2, CASE a WHEN 'moved' THEN 'skipped' ELSE a END FROM S)
SELECT r.run, s.state, count(T.state) AS files FROM (VALUES (1), (2)) AS r(run) CROSS JOIN (VALUES ('moved'), ('skipped'), ('invalid'), ('conflicted')) AS s(state) LEFT JOIN T ON T.run = r.run AND T.state = s.state GROUP BY r.run, s.state""")
def migration(spark, sf_dir):
    """Flat files moved into a store that has some of them already, twice."""
    root = f"{shared_dir(spark)}/gridloom-store-{uuid.uuid4().hex}"
    _, raw = flat_files(spark, sf_dir)
    k = F.floor(F.col("x") / 128) * 10 + F.floor(F.col("y") / 128)
    trailer = F.unhex(F.lit("00" * 4 * S.TRAILER))
    S.write(raw.where((k % 5 == 0) | (k % 11 == 0)).withColumn("payload", F.when(k % 11 == 0, F.concat("payload", trailer)).otherwise(F.col("payload"))), root)
    name = F.format_string("%s_%05d_%05d_%03d.bin", F.when(k % 7 == 0, "tile").otherwise("horizon"), "y", "x", "elevation")
    files = stored(raw.select(F.concat(F.lit("root/"), name).alias("path"), F.octet_length("payload").cast("long").alias("length"), "payload"), "files")
    first = S.migrate(files, root).withColumn("run", F.lit(1))
    return first.unionByName(S.migrate(files, root).withColumn("run", F.lit(2))).select("run", "state", "files")


@query("src_tile_store", """SELECT (vec_id % 10 * 128)::INTEGER AS y, (vec_id // 10 * 128)::INTEGER AS x, unnest(range(0, 64))::INTEGER AS i, round((round_even(unnest(embedding)::DOUBLE * 32767 / 50, 0) * 50 / 32767)::FLOAT::DOUBLE, 5) AS angle FROM embeddings""")
def tile_store(spark, sf_dir):
    """Compressed tiles written to a store and read back."""
    root = f"{shared_dir(spark)}/gridloom-store-{uuid.uuid4().hex}"
    v, _ = flat_files(spark, sf_dir)
    S.write(S.payloads(v, "compressed", 1, SAMPLES), root)
    return S.profiles(S.store(spark, root), 1, SAMPLES).select("y", "x", F.posexplode("angles").alias("i", "angle")).select("y", "x", "i", F.round(F.col("angle").cast("double"), 5).alias("angle"))
