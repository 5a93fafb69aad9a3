"""Queries of hierarchical and reference horizons, their comparison, and functions over dense blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import blocks as B
from gridloom.operators import horizon as H
from gridloom.plans.q_terrain import observers
from gridloom.plans.registry import query
from gridloom.sources.tables import stored
from gridloom.sources.views import GRID_SQL, grid

#: Twelve directions, near samples every half cell up to four cells, cells of 20 m, eyes at 2 m; heights of the grid in units of 100 m.
HOW = {"directions": 12, "near": 4, "fine": 0.5, "eye": 2.0, "cell": 20.0}
ROW0, COL0 = 250.5, 32.5


def dem(spark, sf_dir):
    return grid(spark, sf_dir).withColumn("v", F.col("v") * 100)


SAMPLES = f"""WITH {GRID_SQL}, O AS (SELECT row * 64 + col AS id, row, col, v * 100 AS v FROM G),
C AS (SELECT row, col, v AS v00, v01, lead(v) OVER down AS v10, lead(v01) OVER down AS v11 FROM (SELECT *, lead(v) OVER (PARTITION BY row ORDER BY col) AS v01 FROM O) WINDOW down AS (PARTITION BY col ORDER BY row)),
E AS (SELECT max(row) AS last_row, max(col) AS last_col FROM O),
R AS (SELECT id, row, col, v, d, d * (2 * pi() / 12) AS a, last_row, last_col FROM O, E, unnest(range(0, 12)) AS r(d)),
N AS (SELECT *, least(CASE WHEN abs(cos(a)) > 1e-9 THEN greatest(row / cos(a), (row - last_row) / cos(a)) ELSE 1e9 END, CASE WHEN abs(sin(a)) > 1e-9 THEN greatest(-col / sin(a), (last_col - col) / sin(a)) ELSE 1e9 END) AS far FROM R),
S0 AS (SELECT *, CASE WHEN k <= 8 THEN k * 0.5::DOUBLE ELSE k - 4.0::DOUBLE END AS t FROM (SELECT *, unnest(range(1, 9 + greatest(0, floor(far)::BIGINT - 3))) AS k FROM N))"""
HEIGHT = "CASE WHEN (1 - fr) * (1 - fc) > 0 THEN v00 * ((1 - fr) * (1 - fc)) ELSE 0 END + CASE WHEN (1 - fr) * fc > 0 THEN v01 * ((1 - fr) * fc) ELSE 0 END + CASE WHEN fr * (1 - fc) > 0 THEN v10 * (fr * (1 - fc)) ELSE 0 END + CASE WHEN fr * fc > 0 THEN v11 * (fr * fc) ELSE 0 END"


@query("krn_ray_horizon", SAMPLES + f""", S AS (SELECT id, d, v, t, floor(y)::BIGINT AS row, floor(x)::BIGINT AS col, y - floor(y) AS fr, x - floor(x) AS fc FROM (SELECT *, row + round(-cos(a) * t, 9) AS y, col + round(sin(a) * t, 9) AS x FROM S0)),
H AS (SELECT id, d, v, t * 20 AS x, {HEIGHT} AS h FROM S LEFT JOIN C ON S.row = C.row AND S.col = C.col)
SELECT id, d AS direction, coalesce(round(degrees(atan(max((h - x * x / (2 * 1737400.0) - v - 2) / x))), 5), -90) AS angle FROM H GROUP BY id, d""")  # fmt: skip
def ray_horizon(spark, sf_dir):
    h = H.horizons(observers(spark, sf_dir), dem(spark, sf_dir), **HOW)
    return h.select("id", F.posexplode("horizon").alias("direction", "angle")).select("id", F.col("direction").cast("long").alias("direction"), F.round("angle", 5).alias("angle"))


SPHERE = SAMPLES + f""", P AS (SELECT *, x / q AS px, y / q AS py, (2 - q) / q AS pz, (x * sin(a) + y * cos(a)) / 2 AS dq, t * 20 / 1737400.0 AS arc FROM (SELECT *, 1 + (x * x + y * y) / 4 AS q FROM (SELECT *, (col - {COL0}) * 20 / 1737400.0 AS x, ({ROW0} - row) * 20 / 1737400.0 AS y FROM S0))),
M AS (SELECT id, d, v, t, arc, px * cos(arc) + (sin(a) - x * dq / q) * sin(arc) AS tx, py * cos(arc) + (cos(a) - y * dq / q) * sin(arc) AS ty, pz * cos(arc) - 2 * dq / q * sin(arc) AS tz FROM P),
S AS (SELECT id, d, v, arc, floor(y)::BIGINT AS row, floor(x)::BIGINT AS col, y - floor(y) AS fr, x - floor(x) AS fc FROM (SELECT id, d, v, arc, round({ROW0} - 2 / (1 + tz) * ty * 86870.0, 9) AS y, round({COL0} + 2 / (1 + tz) * tx * 86870.0, 9) AS x FROM M)),
U AS (SELECT id, d, (z - v - 2) * cos(arc) - (v + 2 + 1737400.0) * 2 * sin(arc / 2) ** 2 AS u, (z + 1737400.0) * sin(arc) AS h FROM (SELECT id, d, arc, v, {HEIGHT} AS z FROM S JOIN C ON S.row = C.row AND S.col = C.col) WHERE z IS NOT NULL)"""  # fmt: skip


@query("krn_reference_horizon", SPHERE + " SELECT id, d AS direction, round(max(degrees(atan2(u, h))), 4) AS angle FROM U GROUP BY id, d")
def reference_horizon(spark, sf_dir):
    h = H.reference(observers(spark, sf_dir), dem(spark, sf_dir), ROW0, COL0, **HOW)
    return h.select("id", F.col("direction").cast("long").alias("direction"), F.round("angle", 4).alias("angle"))


@query("krn_horizon_comparison")
def horizon_comparison(spark, sf_dir):
    """Both horizons by direction and by the exact one's distance; their rays meet where they are cast."""
    return H.comparison(observers(spark, sf_dir), dem(spark, sf_dir), ROW0, COL0, **HOW)


EDGE = "CASE WHEN {0} IS NULL AND {1} IS NULL THEN NULL WHEN {0} IS NULL THEN {1} - v WHEN {1} IS NULL THEN v - {0} ELSE ({1} - {0}) / 2 END"


@query("udf_block_gradient", f"WITH {GRID_SQL} SELECT row::BIGINT AS row, col::BIGINT AS col, round({EDGE.format('lag(v) OVER down', 'lead(v) OVER down')}, 9) AS dz_dy, round({EDGE.format('lag(v) OVER across', 'lead(v) OVER across')}, 9) AS dz_dx FROM G WINDOW down AS (PARTITION BY col ORDER BY row), across AS (PARTITION BY row ORDER BY col)")
def block_gradient(spark, sf_dir):
    blocks = stored(B.dense(grid(spark, sf_dir)), "blocks")
    y, x = (B.cells(B.transformed(blocks, B.gradient(axis), 1)).select("row", "col", F.round("v", 9).alias(name)) for axis, name in ((0, "dz_dy"), (1, "dz_dx")))
    return y.join(x, ["row", "col"])


MASK = f"{GRID_SQL}, B AS (SELECT row, col, (v > -0.05)::INTEGER AS m FROM G)"


@query("udf_block_opening", f"""WITH {MASK}, N AS (SELECT b.row + r.i AS row, b.col + c.j AS col, m FROM B b, unnest([-1, 0, 1]) AS r(i), unnest([-1, 0, 1]) AS c(j)),
E AS (SELECT row, col, (count(*) = 9 AND min(m) = 1)::INTEGER AS m FROM N GROUP BY row, col),
D AS (SELECT e.row + r.i AS row, e.col + c.j AS col, m FROM E e, unnest([-1, 0, 1]) AS r(i), unnest([-1, 0, 1]) AS c(j))
SELECT b.row::BIGINT AS row, b.col::BIGINT AS col, max(D.m)::INTEGER AS m FROM B b JOIN D ON D.row = b.row AND D.col = b.col GROUP BY b.row, b.col""")  # fmt: skip
def block_opening(spark, sf_dir):
    mask = grid(spark, sf_dir).withColumn("v", (F.col("v") > -0.05).cast("int"))
    return B.cells(B.transformed(B.dense(mask), B.opening(1), 2)).select("row", "col", F.col("v").cast("int").alias("m"))
