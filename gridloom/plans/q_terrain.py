"""Queries of terrain kernels, the horizon codec and tile streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import codec
from gridloom.operators import terrain as K
from gridloom.plans.q_time import SECONDS, dense, hourly
from gridloom.plans.registry import query
from gridloom.sources.tables import shared_dir, stored, table
from gridloom.sources.views import GRID_SQL, grid
from gridloom.streaming import tiles

G = f"WITH {GRID_SQL}"
RAYS = G + """, O AS (SELECT row * 64 + col AS id, row, col, v AS z0 FROM G), R AS (SELECT id, row AS r0, col AS c0, z0, d, s,
  floor(row - cos(d * (2 * pi() / {dirs})) * s + 0.5)::BIGINT AS row, floor(col + sin(d * (2 * pi() / {dirs})) * s + 0.5)::BIGINT AS col FROM O, unnest(range(0, {dirs})) AS a(d), unnest(range(1, {past})) AS b(s)),
S AS (SELECT id, d, s, R.row, R.col, (G.v - x * x / (2 * 1737400.0) - z0 - 0.05) / x AS slope FROM (SELECT *, sqrt((row - r0) * (row - r0) + (col - c0) * (col - c0)) AS x FROM R) R JOIN G ON G.row = R.row AND G.col = R.col)"""


def observers(spark, sf_dir):
    """Every cell."""
    return grid(spark, sf_dir).select((F.col("row") * 64 + F.col("col")).alias("id"), "row", "col")


@query("krn_viewshed", RAYS.format(dirs=16, past=17) + """, V AS (SELECT *, max(slope) OVER (PARTITION BY id, d ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM S)
SELECT row, col, count(DISTINCT id)::INTEGER AS observers FROM (SELECT row, col, id FROM V WHERE top IS NULL OR slope + 1e-8 >= top UNION SELECT row, col, id FROM O) GROUP BY row, col""")  # fmt: skip
def viewshed(spark, sf_dir):
    return K.viewshed(observers(spark, sf_dir), grid(spark, sf_dir), 16, 16).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "observers")


@query("krn_viewshed_any", RAYS.replace("AS z0 FROM G)", "AS z0 FROM G WHERE v > 0.2)").format(dirs=16, past=17) + """, V AS (SELECT *, max(slope) OVER (PARTITION BY id, d ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM S),
N AS (SELECT DISTINCT row, col FROM (SELECT row, col FROM V WHERE top IS NULL OR slope + 1e-8 >= top UNION SELECT row, col FROM O))
SELECT G.row, G.col, (N.row IS NOT NULL)::INTEGER AS v FROM G LEFT JOIN N ON N.row = G.row AND N.col = G.col""")  # fmt: skip
def viewshed_any(spark, sf_dir):
    """What is seen from any cell of a mask."""
    dem = grid(spark, sf_dir)
    seen = K.viewshed(K.observers_of(dem, mask=dem.select("row", "col", (F.col("v") > 0.2).cast("int").alias("m"))), dem, 16, 16)
    return K.merged(seen, dem)


@query("krn_horizon", RAYS.format(dirs=12, past=65) + " SELECT id, d AS direction, round(degrees(atan(max(slope))), 5) AS angle FROM S GROUP BY id, d")
def horizon(spark, sf_dir):
    h = K.horizons(observers(spark, sf_dir), grid(spark, sf_dir), 12, 64)
    return h.select("id", F.posexplode("horizon").alias("direction", "angle")).where("angle > -90").select("id", F.col("direction").cast("long").alias("direction"), F.round("angle", 5).alias("angle"))


LIT = "WITH P AS (SELECT vec_id AS id, embedding AS h, (s * 15 % 360)::DOUBLE AS az, 0.1 * (s % 5) - 0.1 AS el, s FROM embeddings, unnest(range(0, 24)) AS r(s)), {q} "
AT = "(h[(((floor({a} / 360 * 64 - 0.5)::BIGINT) % 64) + 64) % 64 + 1]::DOUBLE * (1 - (({a} / 360 * 64 - 0.5) - floor({a} / 360 * 64 - 0.5))) + h[(((floor({a} / 360 * 64 - 0.5)::BIGINT) + 1) % 64 + 64) % 64 + 1]::DOUBLE * (({a} / 360 * 64 - 0.5) - floor({a} / 360 * 64 - 0.5)))"


def lit(spark, sf_dir):
    """Horizon arrays (the embeddings) and a body's 24 places."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("s"))
    return e.withColumns({"az": (F.col("s") * 15 % 360).cast("double"), "el": 0.1 * (F.col("s") % 5) - 0.1})


@query("krn_shadow_mask", LIT.format(q=f"M AS (SELECT id, max(el - {AT.format(a='az')}) AS m FROM P GROUP BY id)") + "SELECT id, round(m, 6) AS margin, CASE WHEN m > -0.2725 THEN 0 ELSE 255 END AS mask FROM M")
def shadow(spark, sf_dir):
    m = lit(spark, sf_dir).groupBy("id").agg(F.max(K.margin(F.col("h"), F.col("az"), F.col("el"))).alias("m"))
    return m.select("id", F.round("m", 6).alias("margin"), K.shadow_byte(F.col("m")).alias("mask"))


COLUMNS = [((i + 0.5) / 16 * 2 - 1) * 0.27 for i in range(16)]
HALVES = [(0.27**2 - x * x) ** 0.5 for x in COLUMNS]
PARTS = " + ".join(f"least(greatest(el + {h} - {AT.format(a=f'((az + 360 + {x}) % 360)')}, 0), {2 * h})" for x, h in zip(COLUMNS, HALVES, strict=True))


@query("krn_sun_fraction", LIT.format(q=f"M AS (SELECT id, s, ({PARTS}) / {2 * sum(HALVES)} AS f FROM P)") + "SELECT id, s, round(f, 5) AS fraction FROM M")
def fraction(spark, sf_dir):
    return lit(spark, sf_dir).select("id", F.col("s").cast("long").alias("s"), F.round(K.disc_fraction(F.col("h"), F.col("az"), F.col("el")), 5).alias("fraction"))


@query("src_synthetic_ephemeris", "SELECT event_id, round(cos(s / 86400.0 * 2 * pi()) / sqrt(1.04) * 1737400, 3) AS x, round(sin(s / 86400.0 * 2 * pi()) / sqrt(1.04) * 1737400, 3) AS y, round(0.2 / sqrt(1.04) * 1737400, 3) AS z FROM (SELECT event_id, floor(epoch(ts) - 1704067200) AS s FROM events)")
def ephemeris(spark, sf_dir):
    """The fallback direction at every event's time."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(SECONDS).alias("s"))
    x, y, z = K.sun_vector(F.col("s"))
    return e.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query("krn_horizon_codec", """WITH E AS (SELECT vec_id, unnest(range(1, 65)) AS i, CAST(round_even(unnest(embedding)::DOUBLE * 10 * 32767 / 50, 0) AS BIGINT) AS q FROM embeddings),
 D AS (SELECT vec_id, i, q, q - lag(q) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM E)
 SELECT vec_id, string_agg(CASE WHEN i = 1 THEN lpad(hex(q & 65535), 4, '0') WHEN d >= -64 AND d < 63 THEN lpad(hex(d & 127), 2, '0') ELSE lpad(hex((d & 32767) | 32768), 4, '0') END, '' ORDER BY i) AS bytes, true AS near FROM D GROUP BY vec_id""")
def coded(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("h"))
    back = e.select("vec_id", "h", codec.encode("h").alias("c")).select("vec_id", "h", "c", codec.decode("c").alias("b"))
    return back.select("vec_id", F.hex("c").alias("bytes"), F.forall(F.zip_with("h", "b", lambda x, y: F.abs(x - y) <= 0.001), lambda ok: ok).alias("near"))


@query("krn_sun_vector_reduction", "WITH P AS (SELECT user_id % 5 AS probe, floor(value / 360 * 1440)::BIGINT % 1440 AS bin, event_id, value FROM events) SELECT DISTINCT arg_max(event_id, (value, event_id)) AS event_id FROM P GROUP BY probe, bin")
def reduction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("probe"), (F.floor(F.col("value") / 360 * 1440) % 1440).alias("bin"), "event_id", "value")
    return e.groupBy("probe", "bin").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id")).select("event_id").distinct()


@query("str_tile_reduction", "WITH H AS (SELECT user_id AS cell, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS t, avg(value) AS value FROM events GROUP BY 1, 2) SELECT cell AS tile, 4 AS chunks, round(sum(CAST(round(value, 9) AS DECIMAL(28,9)))::DOUBLE / count(value), 6) AS mean, round(max(value), 6) AS high FROM H GROUP BY cell")
def streamed(spark, sf_dir):
    h = dense(spark, sf_dir).withColumn("position", F.least(F.floor(F.col("t") / 192), F.lit(3)).cast("int"))
    total = F.sum(F.round("value", 9).cast("decimal(28,9)")).cast("decimal(38,9)")
    rows = stored(h.groupBy(F.col("cell").cast("long").alias("tile"), "position").agg(F.lit(4).alias("of"), total.alias("total"), F.max("value").alias("high"), F.count("value").alias("n")), "chunks")
    done = None
    folder = f"{shared_dir(spark)}/gridloom-chunks-{uuid.uuid4().hex}"
    for i in range(4):  # four batches, in order: one run of the stream for each
        rows.where(F.col("position") == i).write.mode("append").parquet(folder)
        done = tiles.run(tiles.reduced(tiles.chunk_stream(spark, folder, 1_000)), "tiles", folder)
    return tiles.complete(rows, done).select("tile", "chunks", F.round("mean", 6).alias("mean"), F.round("high", 6).alias("high"))


@query("krn_light_curve", "WITH H AS (SELECT user_id AS cell, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS t, avg(value) AS value FROM events GROUP BY 1, 2) SELECT t, round(value, 6) AS value FROM H WHERE cell = 7")
def light_curve(spark, sf_dir):
    return hourly(spark, sf_dir).where("cell = 7").select("t", F.round("value", 6).alias("value"))
