"""Queries of map algebra, grid alignment, neighbourhoods and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.operators import grids as R
from gridloom.plans.registry import query
from gridloom.sources.tables import table
from gridloom.sources.views import GRID_SQL, SECOND_SQL, grid, second_grid

G = f"WITH {GRID_SQL}"
GG = f"WITH {GRID_SQL}, {SECOND_SQL}"


def v():
    return F.col("v")


def w():
    return F.col("w")


def r6(c):
    return F.round(c, 6)


def pair(spark, sf_dir):
    """Two identical grids, aligned cell by cell."""
    return grid(spark, sf_dir).join(second_grid(spark, sf_dir), ["row", "col"])


@query("exp_flagship_where", GG + """ SELECT row, col, round(coalesce(CASE WHEN v > 0 AND w < 0.1 THEN v - w END, -9999.0), 6) AS value FROM G JOIN G2 USING (row, col)""")
def flagship(spark, sf_dir):
    masked = C.compare(v(), ">", F.lit(0.0)) & C.compare(w(), "<", F.lit(0.1))
    return pair(spark, sf_dir).select("row", "col", r6(C.as_continuous(C.where(masked, v() - w(), C.nodata()), v(), w())).alias("value"))


@query("exp_arithmetic", GG + """ SELECT row, col, round(v + w, 6) AS a, round(v - w, 6) AS s, round(v * w, 6) AS m, round(v / nullif(w, 0), 6) AS d, round(v * v, 6) AS p, -v AS n FROM G JOIN G2 USING (row, col)""")
def arithmetic(spark, sf_dir):
    return pair(spark, sf_dir).select("row", "col", r6(v() + w()).alias("a"), r6(v() - w()).alias("s"), r6(v() * w()).alias("m"), r6(C.divide(v(), w())).alias("d"), r6(C.power(v(), 2.0)).alias("p"), (-v()).alias("n"))


@query("exp_logic", GG + """ SELECT row, col, CAST(coalesce(v > 0, false) AND coalesce(w <> 0, false) AS INTEGER) AS b, CAST(coalesce(v > 0, false) OR coalesce(w <> 0, false) AS INTEGER) AS e, CAST(NOT coalesce(w <> 0, false) AS INTEGER) AS n FROM G JOIN G2 USING (row, col)""")
def logic(spark, sf_dir):
    a = (v() > 0).cast("int")
    return pair(spark, sf_dir).select("row", "col", C.both(a, w()).cast("int").alias("b"), C.either(a, w()).cast("int").alias("e"), (~C.truth(w())).cast("int").alias("n"))


@query("exp_comparisons", GG + """ SELECT row, col, coalesce(v > w, false) AS gt, coalesce(v >= w, false) AS ge, coalesce(v < w, false) AS lt, coalesce(v <= w, false) AS le, coalesce(v = w, false) AS eq, coalesce(v <> w, true) AS ne FROM G JOIN G2 USING (row, col)""")
def comparisons(spark, sf_dir):
    names = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}
    return pair(spark, sf_dir).select("row", "col", *[C.compare(v(), op, w()).alias(n) for n, op in names.items()])


@query("exp_constant_fill", G + """ SELECT row, col, 2.5::DOUBLE AS value, 0.25::DOUBLE AS time_step_hours FROM G""")
def constant(spark, sf_dir):
    return grid(spark, sf_dir).select("row", "col", F.lit(2.5).alias("value"), F.lit(0.25).alias("time_step_hours"))


@query("exp_encode", GG + """ SELECT row, col, CAST(coalesce(w > 0, false) AS SMALLINT) AS mask, CAST(least(greatest(round_even(v * 1000, 0), 0), 255) AS SMALLINT) AS byte, round(coalesce(w, -9999.0), 6) AS continuous FROM G JOIN G2 USING (row, col)""")
def encode(spark, sf_dir):
    return pair(spark, sf_dir).select("row", "col", C.as_mask(w() > 0).alias("mask"), C.as_byte(v() * 1000).alias("byte"), r6(C.as_continuous(w())).alias("continuous"))


@query("exp_mask_threshold", GG + """ SELECT row, col FROM G2 WHERE coalesce(w, -9999.0) > 0.15 AND coalesce(w, -9999.0) <> -9999.0""")
def mask_threshold(spark, sf_dir):
    return second_grid(spark, sf_dir).where(C.over_threshold(F.coalesce(w(), F.lit(C.NODATA)), 0.15)).select("row", "col")


@query("exp_let_bindings", GG + """ SELECT row, col, round((v + w) * (v + w) - (v - w), 6) AS value FROM G JOIN G2 USING (row, col)""")
def let_bindings(spark, sf_dir):
    df = pair(spark, sf_dir).withColumns({"up": v() + w(), "down": v() - w()})
    return df.select("row", "col", r6(F.col("up") * F.col("up") - F.col("down")).alias("value"))


@query("exp_digest", """SELECT p_partkey, substr(sha256(trim(regexp_replace(p_type, '\\s+', ' ', 'g')) || '|' || array_to_string(list_sort([p_brand, p_name]), ',')), 1, 12) AS digest FROM part""")
def expression_digest(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.digest(F.col("p_type"), F.array("p_name", "p_brand")).alias("digest"))


@query("exp_nodata_union", GG + """ SELECT row, col, (v IS NULL OR w IS NULL) AS nodata FROM G FULL JOIN G2 USING (row, col)""")
def nodata_union(spark, sf_dir):
    return grid(spark, sf_dir).join(second_grid(spark, sf_dir), ["row", "col"], "full").select("row", "col", (v().isNull() | w().isNull()).alias("nodata"))


def targets(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.select((F.col("row") * 64 + F.col("col")).alias("id"), (F.col("row") + 0.25).alias("y"), (F.col("col") + 0.5).alias("x"))


T = ", T AS (SELECT row * 64 + col AS id, row + 0.25::DOUBLE AS y, col + 0.5::DOUBLE AS x FROM G)"


@query("jn_resample_bilinear", G + T + """ SELECT T.id, T.y, T.x, round(a.v * 0.75 * 0.5 + b.v * 0.75 * 0.5 + c.v * 0.25 * 0.5 + d.v * 0.25 * 0.5, 6) AS v FROM T
 LEFT JOIN G a ON a.row = floor(y) AND a.col = floor(x) LEFT JOIN G b ON b.row = floor(y) AND b.col = floor(x) + 1 LEFT JOIN G c ON c.row = floor(y) + 1 AND c.col = floor(x) LEFT JOIN G d ON d.row = floor(y) + 1 AND d.col = floor(x) + 1""")
def resample_bilinear(spark, sf_dir):
    return R.bilinear(grid(spark, sf_dir), targets(spark, sf_dir)).withColumn("v", r6(v()))


@query("jn_resample_nearest", G + T + """ SELECT T.id, T.y, T.x, G.v FROM T LEFT JOIN G ON G.row = floor(y + 0.5) AND G.col = floor(x + 0.5)""")
def resample_nearest(spark, sf_dir):
    return R.nearest(grid(spark, sf_dir), targets(spark, sf_dir))


GRAD = G + """, V AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 11 <> 0 THEN v END AS v FROM G), B AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM V),
 D AS (SELECT V.row, V.col, V.v,
  CASE WHEN V.row = r0 THEN n.v - V.v WHEN V.row = r1 THEN V.v - p.v ELSE (n.v - p.v) / 2 END AS dy,
  CASE WHEN V.col = c0 THEN e.v - V.v WHEN V.col = c1 THEN V.v - w.v ELSE (e.v - w.v) / 2 END AS dx
  FROM V CROSS JOIN B LEFT JOIN V n ON n.row = V.row + 1 AND n.col = V.col LEFT JOIN V p ON p.row = V.row - 1 AND p.col = V.col
  LEFT JOIN V e ON e.col = V.col + 1 AND e.row = V.row LEFT JOIN V w ON w.col = V.col - 1 AND w.row = V.row)"""


def holed(spark, sf_dir):
    """The grid without data in one cell of eleven."""
    return grid(spark, sf_dir).withColumn("v", F.when((F.col("row") * 7 + F.col("col") * 3) % 11 != 0, v()))


@query("win_gradient", GRAD + " SELECT row, col, round(dy, 6) AS dz_dy, round(dx, 6) AS dz_dx FROM D")
def gradient(spark, sf_dir):
    return R.gradients(holed(spark, sf_dir)).select("row", "col", r6(F.col("dz_dy")).alias("dz_dy"), r6(F.col("dz_dx")).alias("dz_dx"))


@query("win_slope_aspect", GRAD + """ SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope,
  round(((90 - degrees(atan2(dy, -dx))) % 360 + 360) % 360, 5) AS aspect FROM D""")
def slope_aspect(spark, sf_dir):
    g = R.gradients(holed(spark, sf_dir))
    return g.select("row", "col", F.round(R.slope_degrees(), 5).alias("slope"), F.round(R.aspect_degrees(), 5).alias("aspect"))


@query("win_hillshade", GRAD + """ SELECT row, col, CAST(coalesce(floor(greatest(0, least(1, sin(radians(45.0)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45.0)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135.0) - atan2(dy, -dx)))) * 255), 0) AS SMALLINT) AS shade FROM D""")
def hillshade(spark, sf_dir):
    return R.gradients(holed(spark, sf_dir)).select("row", "col", R.hillshade().alias("shade"))


@query("win_surface_normal", GRAD + """ SELECT row, col, round(-dx / sqrt(dx * dx + dy * dy + 1), 6) AS nx, round(-dy / sqrt(dx * dx + dy * dy + 1), 6) AS ny, round(1 / sqrt(dx * dx + dy * dy + 1), 6) AS nz FROM D""")
def surface_normal(spark, sf_dir):
    g, n = R.gradients(holed(spark, sf_dir)), F.sqrt(F.col("dz_dx") * F.col("dz_dx") + F.col("dz_dy") * F.col("dz_dy") + 1)
    return g.select("row", "col", r6(-F.col("dz_dx") / n).alias("nx"), r6(-F.col("dz_dy") / n).alias("ny"), r6(1 / n).alias("nz"))


def mask(spark, sf_dir, over: float = -0.15):
    return grid(spark, sf_dir).select("row", "col", (v() > over).cast("int").alias("m"))


M = G + ", M AS (SELECT row, col, CASE WHEN v > -0.15 THEN 1 ELSE 0 END AS m FROM G)"
AROUND = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) AS o(dr, dc)"
ERODE = M + f", E AS (SELECT M.row, M.col, CASE WHEN count(n.m) = 9 THEN min(n.m) ELSE 0 END AS m FROM M, {AROUND} LEFT JOIN M n ON n.row = M.row + dr AND n.col = M.col + dc GROUP BY 1, 2)"


@query("win_erosion", ERODE + " SELECT row, col, m FROM E")
def erosion(spark, sf_dir):
    return R.eroded(mask(spark, sf_dir))


@query("win_opening", ERODE + f" SELECT E.row, E.col, max(n.m) AS m FROM E, {AROUND} JOIN E n ON n.row = E.row + dr AND n.col = E.col + dc GROUP BY 1, 2")
def opening(spark, sf_dir):
    return R.opened(mask(spark, sf_dir))


@query("win_borders", ERODE + " SELECT row, col, (M.m = 1 AND E.m = 0) AS border FROM M JOIN E USING (row, col)")
def borders(spark, sf_dir):
    m = mask(spark, sf_dir)
    return m.join(R.eroded(m).withColumnRenamed("m", "e"), ["row", "col"]).select("row", "col", ((F.col("m") == 1) & (F.col("e") == 0)).alias("border"))


@query("win_support_count", M + f" SELECT M.row, M.col, (sum(n.m) - any_value(M.m))::BIGINT AS support FROM M, {AROUND} JOIN M n ON n.row = M.row + dr AND n.col = M.col + dc GROUP BY 1, 2")
def support(spark, sf_dir):
    return R.neighbour_sums(mask(spark, sf_dir)).select("row", "col", "support")


K = G + """, K AS (SELECT row, col, row * 64 + col AS k FROM G WHERE v > 0.2), E AS (
  SELECT a.k AS a, b.k AS b FROM K a JOIN K b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1)"""
REGION = "WITH RECURSIVE " + K[5:] + """, R(k, s) AS (SELECT k, k FROM K UNION SELECT E.b, R.s FROM R JOIN E ON E.a = R.k WHERE R.s < E.b),
 L AS (SELECT K.row, K.col, least(min(R.s), K.k) AS seed FROM K LEFT JOIN R ON R.k = K.k GROUP BY K.row, K.col, K.k)"""


def high(spark, sf_dir):
    return grid(spark, sf_dir).where(v() > 0.2).select("row", "col")


@query("win_label_regions", REGION + " SELECT row, col, dense_rank() OVER (ORDER BY seed)::INTEGER AS label FROM L")
def label_regions(spark, sf_dir):
    return R.labelled(high(spark, sf_dir)).select("row", "col", "label")


@query("win_region_sizes", REGION + " SELECT row, col, count(*) OVER (PARTITION BY seed) AS size FROM L")
def region_sizes(spark, sf_dir):
    r = R.regions(high(spark, sf_dir))
    return r.join(r.groupBy("seed").count().withColumnRenamed("count", "size"), "seed").select("row", "col", "size")


@query("win_filter_regions", REGION + " SELECT row, col FROM L QUALIFY count(*) OVER (PARTITION BY seed) >= 3")
def filter_regions(spark, sf_dir):
    r = R.regions(high(spark, sf_dir))
    return r.join(r.groupBy("seed").count().where("count >= 3"), "seed", "left_semi").select("row", "col")


@query("agg_region_histogram", REGION + " SELECT size, count(*) AS regions FROM (SELECT count(*) AS size FROM L GROUP BY seed) GROUP BY size")
def region_histogram(spark, sf_dir):
    sizes = R.regions(high(spark, sf_dir)).groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("regions"))


@query("agg_connectivity", REGION + ", N AS (SELECT count(*) AS n FROM L), P AS (SELECT count(*) AS size FROM L GROUP BY seed), A AS (SELECT count(DISTINCT a) AS touching FROM E WHERE a <> b) SELECT (SELECT count(*) FROM P) AS components, (SELECT max(size) FROM P) AS largest, round(touching / (SELECT n FROM N), 6) AS adjacency FROM A")
def connectivity(spark, sf_dir):
    h = high(spark, sf_dir)
    sizes = R.regions(h).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    mask = grid(spark, sf_dir).select("row", "col", F.coalesce((v() > 0.2).cast("int"), F.lit(0)).alias("m"))
    near = R.neighbour_sums(mask).where("m = 1").agg(F.avg((F.col("support") > 0).cast("int")).alias("adjacency"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest")).join(F.broadcast(near)).select("components", "largest", r6(F.col("adjacency")).alias("adjacency"))


@query("aux_class_regions", "WITH RECURSIVE " + G[5:] + """, K AS (SELECT row, col, row * 64 + col AS k, CASE WHEN v > 0.15 THEN 2 WHEN v < -0.15 THEN 1 ELSE 255 END AS c FROM G), F AS (SELECT * FROM K WHERE c <> 255),
 E AS (SELECT a.k AS a, b.k AS b FROM F a JOIN F b ON a.c = b.c AND abs(a.row - b.row) + abs(a.col - b.col) = 1), R(k, s) AS (SELECT k, k FROM F UNION SELECT E.b, R.s FROM R JOIN E ON E.a = R.k WHERE R.s < E.b)
 SELECT c AS class, count(*) AS cells, count(DISTINCT s) AS regions FROM (SELECT F.c, F.k, min(R.s) AS s FROM F JOIN R ON R.k = F.k GROUP BY 1, 2) GROUP BY c""")
def class_regions(spark, sf_dir):
    g = grid(spark, sf_dir).select("row", "col", F.when(v() > 0.15, 2).when(v() < -0.15, 1).otherwise(255).alias("class")).where("class <> 255")
    r = R.regions(g, neighbours=4, same="class")
    return r.groupBy("class").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("seed").alias("regions"))


@query("agg_max_pyramid", G + " SELECT (row // 4)::INTEGER AS row, (col // 4)::INTEGER AS col, max(v) AS v, 1 AS level FROM G GROUP BY 1, 2 UNION ALL SELECT (row // 16)::INTEGER, (col // 16)::INTEGER, max(v), 2 FROM G GROUP BY 1, 2")
def max_pyramid(spark, sf_dir):
    one = R.downsampled(grid(spark, sf_dir), 4)
    return one.withColumn("level", F.lit(1)).unionByName(R.downsampled(one, 4).withColumn("level", F.lit(2)))


@query("agg_merge_max", GG + " SELECT row, col, max(x) AS x FROM (SELECT row, col, v AS x FROM G UNION ALL SELECT row, col, w FROM G2) GROUP BY 1, 2")
def merge_max(spark, sf_dir):
    return grid(spark, sf_dir).select("row", "col", v().alias("x")).union(second_grid(spark, sf_dir).select("row", "col", "w")).groupBy("row", "col").agg(F.max("x").alias("x"))


@query("agg_value_range", GG + " SELECT min(w) AS low, max(w) AS high FROM G2")
def value_range(spark, sf_dir):
    return second_grid(spark, sf_dir).agg(F.min("w").alias("low"), F.max("w").alias("high"))


@query("aux_band_statistics", GG + """ SELECT label, count(w) AS valid, count(*) AS total, round(100.0 * count(w) / count(*), 6) AS percent, min(w) AS low, max(w) AS high, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std,
 round(quantile_cont(w, 0.05), 6) AS p5, round(quantile_cont(w, 0.25), 6) AS p25, round(quantile_cont(w, 0.5), 6) AS p50, round(quantile_cont(w, 0.75), 6) AS p75, round(quantile_cont(w, 0.95), 6) AS p95
 FROM G JOIN G2 USING (row, col) GROUP BY label""")
def band_statistics(spark, sf_dir):
    at = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return pair(spark, sf_dir).groupBy("label").agg(
        F.count("w").alias("valid"), F.count(F.lit(1)).alias("total"), r6(100.0 * F.count("w") / F.count(F.lit(1))).alias("percent"), F.min("w").alias("low"), F.max("w").alias("high"), r6(F.avg("w")).alias("mean"),
        r6(F.stddev_pop("w")).alias("std"), *[r6(F.percentile("w", p)).alias(n) for n, p in at.items()])


@query("aux_percentile_stretch", G + """, P AS (SELECT label, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM G GROUP BY label)
 SELECT row, col, CAST(round_even(greatest(0, least(1, (v - a) / nullif(b - a, 0))) * 255, 0) AS SMALLINT) AS byte FROM G JOIN P USING (label)""")
def percentile_stretch(spark, sf_dir):
    g = grid(spark, sf_dir)
    p = g.groupBy("label").agg(F.percentile("v", 0.02).alias("a"), F.percentile("v", 0.98).alias("b"))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), C.divide(v() - F.col("a"), F.col("b") - F.col("a"))))
    return g.join(p, "label").select("row", "col", F.rint(x * 255).cast("smallint").alias("byte"))


@query("aux_histogram", G + """, B AS (SELECT unnest(range(0, 16))::INTEGER AS bin), H AS (SELECT least(floor((v + 1) / 2 * 16), 15)::INTEGER AS bin, count(*) AS n FROM G WHERE v BETWEEN -1 AND 1 GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM B LEFT JOIN H USING (bin)""")
def histogram(spark, sf_dir):
    h = grid(spark, sf_dir).where(v().between(-1, 1)).groupBy(F.least(F.floor((v() + 1) / 2 * 16), F.lit(15)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(16).select(F.col("id").cast("int").alias("bin")).join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("aux_roughness_tpi", G + f""" SELECT G.row, G.col, round(any_value(G.v) - (sum(n.v) - any_value(G.v)) / (count(*) - 1), 6) AS tpi, round(max(n.v) - min(n.v), 6) AS roughness
 FROM G, {AROUND} JOIN G n ON n.row = G.row + dr AND n.col = G.col + dc GROUP BY 1, 2""")
def roughness_tpi(spark, sf_dir):
    from pyspark.sql.window import Window

    h = R.haloed(grid(spark, sf_dir))
    for part, order, first in (("col", "row", True), ("row", "col", False)):
        w = Window.partitionBy("tr", "tc", part).orderBy(order).rangeBetween(-1, 1)
        src = dict.fromkeys(("s", "lo", "hi"), "v") if first else {k: k for k in ("s", "lo", "hi")}
        n = F.count(F.lit(1)).over(w) if first else F.sum("n").over(w)
        h = h.withColumns({"s": F.sum(src["s"]).over(w), "lo": F.min(src["lo"]).over(w), "hi": F.max(src["hi"]).over(w), "n": n})
    return h.where("own").select("row", "col", r6(v() - (F.col("s") - v()) / (F.col("n") - 1)).alias("tpi"), r6(F.col("hi") - F.col("lo")).alias("roughness"))


@query("aux_nodata_backup", GG + " SELECT row, col, coalesce(w, v) AS value FROM G2 JOIN G USING (row, col)")
def nodata_backup(spark, sf_dir):
    return pair(spark, sf_dir).select("row", "col", F.coalesce("w", "v").alias("value"))


@query("aux_array_utilities", G + """, A AS (SELECT min(v) AS low, max(v) AS high, count(*) FILTER (v > 0.3) AS over, min(row * 64 + col) FILTER (v > 0.3) AS first_at, bool_and(v > -2) AS every FROM G) SELECT * FROM A""")
def array_utilities(spark, sf_dir):
    hit = v() > 0.3
    return grid(spark, sf_dir).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(hit).alias("over"), F.min(F.when(hit, F.col("row") * 64 + F.col("col"))).alias("first_at"), F.bool_and(v() > -2).alias("every"))
