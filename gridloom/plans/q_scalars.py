"""Queries of geometry, colour and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geometry as M
from gridloom.functions import style as S
from gridloom.functions import text as X
from gridloom.plans.registry import query
from gridloom.sources.tables import table
from gridloom.sources.views import GAZETTEER_SQL, GRID_SQL, gazetteer, grid

G, Z = f"WITH {GRID_SQL}", f"WITH {GAZETTEER_SQL}"
AFFINE = (0.5, 0.1, 100.0, -0.2, -0.4, 900.0)
R = 1737400.0


def r6(c):
    return F.round(c, 6)


@query("fn_affine", G + " SELECT row, col, round(0.5::DOUBLE * (col + 0.5) + 0.1 * (row + 0.5) + 100, 6) AS x, round(-0.2::DOUBLE * (col + 0.5) - 0.4 * (row + 0.5) + 900, 6) AS y, row + 0.5::DOUBLE AS row_back, col + 0.5::DOUBLE AS col_back FROM G")
def affine(spark, sf_dir):
    g = grid(spark, sf_dir)
    x, y = M.affine(F.col("row") + 0.5, F.col("col") + 0.5, *AFFINE)  # pixel centres
    row, col = M.affine_inverse(F.col("x0"), F.col("y0"), *AFFINE)
    return g.withColumns({"x0": x, "y0": y}).select("row", "col", r6(F.col("x0")).alias("x"), r6(F.col("y0")).alias("y"), r6(row).alias("row_back"), r6(col).alias("col_back"))


@query("fn_stereographic", Z + f""", P AS (SELECT feature_id, x - 180 AS lon, y * 0.9 AS lat, 2.0 / (1 + sin(radians(-80.0)) * sin(radians(y * 0.9)) + cos(radians(-80.0)) * cos(radians(y * 0.9)) * cos(radians(x - 180 - 10))) AS k FROM Z)
SELECT feature_id, round({R} * k * cos(radians(lat)) * sin(radians(lon - 10)), 3) AS px, round({R} * k * (cos(radians(-80.0)) * sin(radians(lat)) - sin(radians(-80.0)) * cos(radians(lat)) * cos(radians(lon - 10))), 3) AS py, round(k, 6) AS scale, true AS back FROM P""")  # fmt: skip
def stereographic(spark, sf_dir):
    p = gazetteer(spark, sf_dir).select("feature_id", (F.col("x") - 180).alias("lon"), (F.col("y") * 0.9).alias("lat"))
    x, y = M.stereographic(F.col("lon"), F.col("lat"), 10.0, -80.0)
    p = p.withColumns({"x": x, "y": y, "scale": M.stereographic_scale(F.col("lon"), F.col("lat"), 10.0, -80.0)})
    lon, lat = M.stereographic_inverse(F.col("x"), F.col("y"), 10.0, -80.0)
    turn = F.pmod(lon - F.col("lon") + 180, F.lit(360.0)) - 180
    back = (F.abs(lat - F.col("lat")) < 1e-6) & (F.abs(turn * F.cos(F.radians("lat"))) < 1e-6)
    return p.select("feature_id", F.round("x", 3).alias("px"), F.round("y", 3).alias("py"), r6(F.col("scale")).alias("scale"), back.alias("back"))


@query("fn_convergence", Z + """, P AS (SELECT feature_id, radians(x - 180 - 10) AS lo, radians(y * 0.9) AS la, radians(-80.0) AS p FROM Z)
SELECT feature_id, round(degrees(atan2(sin(lo) * (sin(la) + sin(p)), cos(la) * cos(p) + cos(lo) * (1 + sin(la) * sin(p)))), 6) AS convergence FROM P""")  # fmt: skip
def convergence(spark, sf_dir):
    p = gazetteer(spark, sf_dir).select("feature_id", (F.col("x") - 180).alias("lon"), (F.col("y") * 0.9).alias("lat"))
    return p.select("feature_id", r6(M.stereographic_convergence(F.col("lon"), F.col("lat"), 10.0, -80.0)).alias("convergence"))


@query("fn_body_fixed_azimuth", Z + f""", P AS (SELECT feature_id, radians(x) AS lo, radians(y) AS la, {R} + diameter AS r FROM Z), Q AS (SELECT feature_id, r * cos(la) * cos(lo) - {R} AS dx, r * cos(la) * sin(lo) AS dy, r * sin(la) AS dz FROM P)
SELECT feature_id, round(dx, 3) AS dx, round(dy, 3) AS dy, round(dz, 3) AS dz, round(degrees(atan2(dx, sqrt(dy * dy + dz * dz))), 6) AS elevation FROM Q""")  # fmt: skip
def fixed(spark, sf_dir):
    g = gazetteer(spark, sf_dir)
    zero = F.lit(0.0)
    v, o = M.body_fixed(F.col("x"), F.col("y"), F.col("diameter")), M.body_fixed(zero, zero, zero)
    e, n, u = M.local_frame(v, o, zero, zero)
    return g.select("feature_id", F.round(u, 3).alias("dx"), F.round(e, 3).alias("dy"), F.round(n, 3).alias("dz"), r6(M.azimuth_elevation(e, n, u)[1]).alias("elevation"))


@query("fn_sag_drop_slope", Z + f""", P AS (SELECT feature_id, importance AS d, diameter AS h, ((diameter - 2) * (2 * {R} + diameter + 2) - importance * importance) / (2 * ({R} + 2)) AS z FROM Z)
SELECT feature_id, round(pow(d, 4) / (8 * pow({R}, 3)) * 1e6, 6) AS sag, round(d * d / (2 * {R}), 6) AS fall, round(CASE WHEN d < 500 THEN (h - 2) / d ELSE z / sqrt(d * d - z * z) END, 6) AS slope FROM P""")  # fmt: skip
def sag(spark, sf_dir):
    g, d = gazetteer(spark, sf_dir), F.col("importance")
    return g.select("feature_id", r6(M.sag(d) * 1e6).alias("sag"), r6(M.drop(d)).alias("fall"), r6(M.seen_slope(F.col("diameter"), d, F.lit(2.0))).alias("slope"))


@query("fn_circular_interpolation", "WITH P AS (SELECT vec_id, embedding AS e, (vec_id * 7) % 360 / 360.0 * 64 - 0.5 AS a FROM embeddings) SELECT vec_id, round(e[((floor(a)::BIGINT % 64) + 64) % 64 + 1]::DOUBLE * (1 - (a - floor(a))) + e[((floor(a)::BIGINT + 1) % 64 + 64) % 64 + 1]::DOUBLE * (a - floor(a)), 6) AS v FROM P")
def circular(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", r6(M.circular(F.col("embedding").cast("array<double>"), (F.pmod(F.col("vec_id") * 7, F.lit(360))).cast("double"))).alias("v"))


STOPS = [(0.2, (0.0, 0.0, 64.0, 255.0)), (0.6, (10.0, 200.0, 30.0, 255.0)), (0.9, (255.0, 255.0, 255.0, 128.0))]


@query("fn_colormap", G + """, N AS (SELECT row, col, v, CASE WHEN v IS NOT NULL THEN least(greatest((v + 0.5) / 1.0, 0), 1) END AS x FROM G)
SELECT row, col, round(CASE WHEN x <= 0.2 THEN 0 WHEN x <= 0.6 THEN (x - 0.2) / 0.4 * 10 WHEN x <= 0.9 THEN 10 + (x - 0.6) / 0.3 * 245 WHEN x IS NOT NULL THEN 255 END, 4) AS red,
  CASE WHEN x >= 0.9 THEN 255.0 WHEN x >= 0.6 THEN 200.0 WHEN x IS NOT NULL THEN 0.0 END::DOUBLE AS green,
  round(((v % 0.3) + 0.3) % 0.3 / 0.3, 4) AS cycle, round(least(greatest((x - 0.5) * 1.5 + 0.6, 0), 1), 6) AS tone, coalesce(least(((v % 0.25) + 0.25) % 0.25, 0.25 - ((v % 0.25) + 0.25) % 0.25) <= 0.01, false) AS contour FROM N""")  # fmt: skip
def colormap(spark, sf_dir):
    g, v = grid(spark, sf_dir), F.col("v")
    x = S.normalised(v, -0.5, 0.5)
    return g.select("row", "col", F.round(S.continuous(x, STOPS, 0), 4).alias("red"), S.discrete(x, STOPS, 1).alias("green"), F.round(S.cyclic(v, 0.0, 0.3), 4).alias("cycle"), r6(S.toned(x, 1.5, 0.1)).alias("tone"), S.contour(v, 0.25, 0.02).alias("contour"))


@query("fn_clean_name", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS clean, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS kebab, contains(' ' || lower(translate(p_type, ',/', '  ')) || ' ', ' brass ') AS brass FROM part")
def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_name(F.col("p_name")).alias("clean"), X.kebab(F.col("p_type")).alias("kebab"), X.has_type(F.col("p_type"), "brass").alias("brass"))


T = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query("fn_snippet_estimate", f"SELECT doc_id, CASE WHEN length({T}) <= 240 THEN {T} ELSE rtrim({T}[:239]) || '…' END AS snippet, greatest(1, round_even(len(list_filter(string_split({T}, ' '), lambda x: x <> '')) * 1.3, 0))::INTEGER AS tokens FROM documents")
def snippets(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(t).alias("snippet"), X.token_estimate(t).alias("tokens"))


STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("fn_query_terms", f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_:./-]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL}))[1:24], ' ') AS terms FROM conversations")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.terms(F.col("text")), " ").alias("terms"))


@query("fn_message_compaction", r"SELECT conv_id, string_agg('[' || upper(role) || '] ' || replace(coalesce(text, ''), chr(10), ' ')[:240], chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id")
def compaction(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 240))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("m"))
    return rows.select("conv_id", F.array_join("m.line", "\n").alias("body"))


@query("fn_boolish_lists", "SELECT event_id, json_extract_string(props, '$.device') IS NOT NULL AS has_device, lower(event_type) IN ('1', 'true', 'yes', 'y', 'on') AS flag, len(list_filter(list_transform(string_split(event_type || '; x ;;' || event_id, ';'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM events")
def lists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat("event_type", F.lit("; x ;;"), F.col("event_id").cast("string"))
    return e.select("event_id", F.get_json_object("props", "$.device").isNotNull().alias("has_device"), X.boolish(F.col("event_type")).alias("flag"), F.size(X.listed(text)).cast("long").alias("n"))


@query("fn_content_key", "SELECT n_nationkey, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS key FROM nation")
def content_key(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), 256).alias("key"))
