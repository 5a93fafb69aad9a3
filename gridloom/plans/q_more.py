"""Queries of chunkers, scores, geometry and statistics beside the first ones."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import geometry as M
from gridloom.functions import text as X
from gridloom.operators import grids as R
from gridloom.operators import search as S
from gridloom.plans.q_grids import AROUND, G, high, mask
from gridloom.plans.q_grids import REGION as REGION_SQL
from gridloom.plans.registry import query
from gridloom.sources.tables import table
from gridloom.sources.views import GAZETTEER_SQL, gazetteer, grid


def r6(c):
    return F.round(c, 6)


PACK = """list_reduce(parts, lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + 2 + length(x) <= {most} THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END)"""

PARAGRAPHS = rf"""WITH P AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL),
 C AS (SELECT doc_id, string_split({PACK.format(most=1800)}, chr(1)) AS chunks FROM P WHERE len(parts) > 0)
 SELECT doc_id, (i - 1)::INTEGER AS ordinal, length(chunks[i])::INTEGER AS chars, md5(chunks[i]) AS digest FROM C, unnest(range(1, len(chunks) + 1)) AS u(i)"""


def digested(chunks):
    return chunks.select("doc_id", "ordinal", F.length("content").alias("chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("ret_paragraph_chunks", PARAGRAPHS)
def paragraph_chunks(spark, sf_dir):
    return digested(S.paragraphs(table(spark, sf_dir, "documents")))


HEADED = "'# ' || item_id || chr(10) || text || chr(10) || '## more' || chr(10) || text || chr(10) || chr(10) || '### end'"


@query("ret_markdown_chunks", rf"""WITH T AS (SELECT item_id AS doc_id, {HEADED} AS text FROM benchmark WHERE text IS NOT NULL), P AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(^|\n)(#{{1,3}} )', chr(2) || '\2', 'g'), chr(2)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts FROM T),
 C AS (SELECT doc_id, string_split({PACK.format(most=400)}, chr(1)) AS chunks FROM P)
 SELECT doc_id, (i - 1)::INTEGER AS ordinal, length(chunks[i])::INTEGER AS chars, md5(chunks[i]) AS digest FROM C, unnest(range(1, len(chunks) + 1)) AS u(i)""")
def markdown_chunks(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    text = F.concat(F.lit("# "), F.col("item_id").cast("string"), F.lit("\n"), "text", F.lit("\n## more\n"), "text", F.lit("\n\n### end"))
    return digested(S.markdown(b.select(F.col("item_id").alias("doc_id"), text.alias("text")), 400))


@query("ret_csv_chunks", """WITH L AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
 SELECT doc_id, (k // 3)::INTEGER AS ordinal, 'key' || chr(10) || string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY k) AS content FROM L GROUP BY doc_id, k // 3""")
def csv_chunks(spark, sf_dir):
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "\n")
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("key\n"), keys).alias("text"))
    return S.csv_rows(docs, 3)


Z = f"WITH {GAZETTEER_SQL}"


@query("fn_unit_name_score", Z + " SELECT feature_id, CASE WHEN clean_name = '' THEN 0 WHEN clean_name = w THEN 1 WHEN starts_with(clean_name, w) THEN 0.92 WHEN contains(clean_name, w) THEN 0.86 ELSE 0 END::DOUBLE AS score FROM Z, (SELECT split_part(min(clean_name), ' ', 1) AS w FROM Z)")
def unit_name_score(spark, sf_dir):
    g = gazetteer(spark, sf_dir)
    first = g.agg(F.substring_index(F.min("clean_name"), " ", 1).alias("w"))
    return g.join(F.broadcast(first)).select("feature_id", X.unit_name_score(F.col("clean_name"), F.col("w")).alias("score"))  # one row


SCENARIO = """S AS (SELECT p_partkey, lower(p_name) AS f1, lower(p_type) AS f2, lower(p_brand) AS f3, lower(p_brand || ' ' || p_name) AS f4, w FROM part, unnest(['standard', 'brand#13', 'small', 'tin box', '']) AS u(w)),
 C AS (SELECT p_partkey, w, CASE WHEN w = '' THEN 0 WHEN w = f1 THEN 1000 WHEN w = f2 THEN 950 WHEN w = f3 THEN 900 WHEN w = f4 THEN 880 ELSE greatest(
  CASE WHEN contains(f1, w) THEN 700 ELSE 0 END, CASE WHEN contains(f2, w) THEN 650 ELSE 0 END, CASE WHEN contains(f3, w) THEN 620 ELSE 0 END, CASE WHEN contains(f4, w) THEN 610 ELSE 0 END,
  CASE WHEN starts_with(f1, w) THEN 780 ELSE 0 END, CASE WHEN starts_with(f2, w) THEN 740 ELSE 0 END, CASE WHEN starts_with(f3, w) THEN 720 ELSE 0 END,
  CASE WHEN len(list_filter(string_split(w, ' '), lambda t: NOT contains(concat_ws(' ', f1, f2, f3, f4), t))) = 0 THEN 600 + least(40, 10 * len(string_split(w, ' '))) ELSE 0 END) END::INTEGER AS score FROM S)"""


def scenarios(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", *[F.lower(c).alias(f"f{i}") for i, c in enumerate((F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.concat_ws(" ", "p_brand", "p_name")), 1)])
    p = p.withColumn("w", F.explode(F.array(*map(F.lit, ("standard", "brand#13", "small", "tin box", "")))))
    return p.select("p_partkey", "w", X.scenario_score([F.col(f"f{i}") for i in range(1, 5)], F.col("w")).cast("int").alias("score"))


@query("fn_scenario_score", f"WITH {SCENARIO} SELECT * FROM C")
def scenario_score(spark, sf_dir):
    return scenarios(spark, sf_dir)


@query("srt_scenario_match", f"WITH {SCENARIO}, T AS (SELECT *, max(score) OVER (PARTITION BY w) AS top FROM C WHERE score > 0), K AS (SELECT w, p_partkey, score, row_number() OVER (PARTITION BY w ORDER BY score DESC, p_partkey) AS place, count(*) FILTER (score >= top - 40) OVER (PARTITION BY w) > 1 AND top < 900 AS ambiguous, score >= top - 40 AS near FROM T) SELECT w, p_partkey, score, ambiguous FROM K WHERE CASE WHEN ambiguous THEN near AND place <= 5 ELSE place = 1 END")
def scenario_match(spark, sf_dir):
    every, order = Window.partitionBy("w"), Window.partitionBy("w").orderBy(F.desc("score"), "p_partkey")
    s = scenarios(spark, sf_dir).where("score > 0").withColumn("top", F.max("score").over(every)).withColumn("near", F.col("score") >= F.col("top") - 40)
    s = s.withColumns({"place": F.row_number().over(order), "ambiguous": (F.count_if("near").over(every) > 1) & (F.col("top") < 900)})
    return s.where("if(ambiguous, near and place <= 5, place = 1)").select("w", "p_partkey", "score", "ambiguous")


@query("win_turn_order", "WITH I AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN conv_id::VARCHAR WHEN 1 THEN conv_id || '.followup' WHEN 2 THEN conv_id || '.other' ELSE conv_id || '.turn' || turn END AS id FROM conversations) SELECT conv_id, id, CASE turn WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 99 ELSE turn END::INTEGER AS place FROM I")
def turn_order(spark, sf_dir):
    c, conv = table(spark, sf_dir, "conversations"), F.col("conv_id").cast("string")
    name = F.when(F.col("turn") == 0, conv).when(F.col("turn") == 1, F.concat(conv, F.lit(".followup"))).when(F.col("turn") == 2, F.concat(conv, F.lit(".other"))).otherwise(F.concat(conv, F.lit(".turn"), F.col("turn").cast("string")))
    return c.select("conv_id", name.alias("id")).withColumn("place", X.turn_order(F.col("id")).cast("int"))


@query("exp_token_filter", "SELECT p_partkey FROM part WHERE len(list_filter(['re', 'wid'], lambda t: len(list_filter(string_split(lower(p_name), ' '), lambda w: contains(w, t))) = 0)) = 0")
def token_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(X.all_tokens_in(F.array(F.lit("re"), F.lit("wid")), F.split(F.lower("p_name"), " "))).select("p_partkey")


@query("set_token_overlap", "SELECT conv_id, turn, len(list_intersect(string_split(lower(text), ' '), ['the', 'data', 'how', 'please']))::INTEGER AS shared FROM conversations WHERE text IS NOT NULL")
def token_overlap(spark, sf_dir):
    hints = F.array(*map(F.lit, ("the", "data", "how", "please")))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", X.overlap(F.split(F.lower("text"), " "), hints).alias("shared"))


@query("fn_polygon_area", """WITH P AS (SELECT feature_id, [min_x, max_x + 1, max_x, min_x - 2] AS xs, [min_y, min_y, max_y, max_y] AS ys FROM Z WHERE min_x IS NOT NULL)
 SELECT feature_id, round(abs(xs[1]*ys[2]-xs[2]*ys[1] + xs[2]*ys[3]-xs[3]*ys[2] + xs[3]*ys[4]-xs[4]*ys[3] + xs[4]*ys[1]-xs[1]*ys[4]) / 2, 6) AS area FROM P""".replace("WITH P", Z + ", P", 1))
def polygon_area(spark, sf_dir):
    g = gazetteer(spark, sf_dir).where("min_x is not null")
    xs, ys = F.array("min_x", F.col("max_x") + 1, "max_x", F.col("min_x") - 2), F.array("min_y", "min_y", "max_y", "max_y")
    return g.select("feature_id", r6(M.polygon_area(xs, ys)).alias("area"))


@query("fn_pixel_size", "SELECT vec_id, CASE WHEN abs(a) > 0 AND abs(e) > 0 THEN (abs(a) + abs(e)) / 2 ELSE greatest(abs(a), abs(e), 1.0) END AS size FROM (SELECT vec_id, (vec_id % 4)::DOUBLE AS a, -(vec_id % 3)::DOUBLE AS e FROM embeddings)")
def pixel_size(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 4).cast("double").alias("a"), (-(F.col("vec_id") % 3)).cast("double").alias("e"))
    return e.select("vec_id", M.mean_pixel_size(F.col("a"), F.col("e")).alias("size"))


@query("fn_remap_clip", "SELECT event_id, round(10 + least(greatest((value - 20) / 60, 0), 1) * -30, 6) AS mapped FROM events WHERE value IS NOT NULL")
def remap(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", r6(M.remapped(F.col("value"), 20.0, 80.0, 10.0, -20.0)).alias("mapped"))


@query("fn_degrees_text", Z + " SELECT feature_id, CASE WHEN q < 0 THEN '-' ELSE '' END || printf('%d°%02d''%05.2f', floor(abs(q))::INTEGER, (floor(abs(q) * 60) % 60)::INTEGER, round((abs(q) * 3600) % 60, 2)) AS hms FROM (SELECT feature_id, y + diameter / 64 AS q FROM Z)")
def degrees_text(spark, sf_dir):
    return gazetteer(spark, sf_dir).select("feature_id", X.degrees_text(F.col("y") + F.col("diameter") / 64).alias("hms"))


W, HG, B0, HW = 0.32, 0.25, 1.2, 0.06


@query("fn_reflectance", f"""WITH A AS (SELECT event_id, (value % 90 + 1) / 91 AS m0, (value % 70 + 1) / 71 AS m, cos(value / 50) AS c FROM events WHERE value IS NOT NULL)
 SELECT event_id, round(greatest(0, {W} / (4 * pi()) * m0 / (m0 + m) * ((1 + {B0} / (1 + sqrt(greatest(0, (1 - c) / (1 + c + 1e-12))) / {HW})) * {1 - HG * HG} / pow(1 + {2 * HG} * c + {HG * HG}, 1.5)
  + (1 + 2 * m0) / (1 + 2 * m0 * {math.sqrt(1 - W)}) * (1 + 2 * m) / (1 + 2 * m * {math.sqrt(1 - W)}) - 1)), 6) AS r FROM A""")
def reflectance(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", ((v % 90 + 1) / 91).alias("m0"), ((v % 70 + 1) / 71).alias("m"), F.cos(v / 50).alias("c"))
    return e.select("event_id", r6(M.hapke(F.col("m0"), F.col("m"), F.col("c"), W, HG, B0, HW)).alias("r"))


@query("agg_observer_density", G + " SELECT label, round(count(*) FILTER (v > 0.2) / count(*), 6) AS density FROM G GROUP BY label")
def density(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("label").agg(r6(F.count_if(F.col("v") > 0.2) / F.count(F.lit(1))).alias("density"))


@query("agg_family_readiness", "SELECT p_brand AS family, count(*) AS cases, round(avg((p_size > 10)::INTEGER), 6) AS ready_rate, round(avg((p_size > 40)::INTEGER), 6) AS clean_rate, bool_and(p_size > 0) AS all_run FROM part GROUP BY p_brand")
def readiness(spark, sf_dir):
    p, rate = table(spark, sf_dir, "part"), lambda c: r6(F.avg(F.expr(c).cast("int")))
    return p.groupBy(F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("cases"), rate("p_size > 10").alias("ready_rate"), rate("p_size > 40").alias("clean_rate"), F.bool_and(F.col("p_size") > 0).alias("all_run"))


@query("srt_leaderboard_keys", "WITH L AS (SELECT o_custkey AS model, CASE WHEN bool_or(o_orderstatus = 'O') THEN 0 ELSE 1 END AS rank, round(avg(o_totalprice)::DOUBLE, 2) AS score, round(avg((o_orderstatus = 'F')::INTEGER), 6) AS success, count(*) FILTER (o_totalprice > 200000) AS errors, round(avg(o_orderkey), 2) AS duration FROM orders GROUP BY 1) SELECT *, row_number() OVER (ORDER BY rank, score DESC, success DESC, errors, duration, model) AS place FROM L QUALIFY place <= 25")
def leaderboard(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("model")).agg(
        F.when(F.bool_or(F.col("o_orderstatus") == "O"), 0).otherwise(1).alias("rank"), F.round(F.avg(F.col("o_totalprice").cast("double")), 2).alias("score"), r6(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("success"),
        F.count_if(F.col("o_totalprice") > 200000).alias("errors"), F.round(F.avg("o_orderkey"), 2).alias("duration"))
    top = rows.orderBy("rank", F.desc("score"), F.desc("success"), "errors", "duration", "model").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy("rank", F.desc("score"), F.desc("success"), "errors", "duration", "model")).cast("long"))  # 25 rows


@query("aux_byte_histogram", G + " SELECT floor(greatest(0, least(1, v / 2 + 0.5)) * 255)::INTEGER AS byte, count(*) AS n FROM G WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1")
def byte_histogram(spark, sf_dir):
    byte = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 2 + 0.5)) * 255).cast("int")
    return grid(spark, sf_dir).where("v is not null").groupBy(byte.alias("byte")).agg(F.count(F.lit(1)).alias("n"))


@query("aux_js_divergence", """WITH H AS (SELECT event_type, least(floor(value / 10), 30)::INTEGER AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2), T AS (SELECT min(event_type) AS a, max(event_type) AS b FROM H),
 P AS (SELECT bin, n / sum(n) OVER () AS p FROM H, T WHERE event_type = a), Q AS (SELECT bin, n / sum(n) OVER () AS q FROM H, T WHERE event_type = b),
 J AS (SELECT greatest(coalesce(p, 0), 1e-15) AS p, greatest(coalesce(q, 0), 1e-15) AS q, greatest((coalesce(p, 0) + coalesce(q, 0)) / 2, 1e-15) AS m FROM P FULL JOIN Q USING (bin))
 SELECT round(0.5 * sum(p * ln(p / m) + q * ln(q / m)), 6) AS divergence, CASE WHEN sum(p * ln(p / m) + q * ln(q / m)) / 2 < 0.03 THEN 'good' WHEN sum(p * ln(p / m) + q * ln(q / m)) / 2 < 0.1 THEN 'moderate' ELSE 'poor' END AS label FROM J""")
def js_divergence(spark, sf_dir):
    h = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", F.least(F.floor(F.col("value") / 10), F.lit(30)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    pair = h.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    of = h.join(F.broadcast(pair)).groupBy("bin").agg(F.sum(F.when(F.col("event_type") == F.col("a"), F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("event_type") == F.col("b"), F.col("n")).otherwise(0)).alias("y"))  # one row
    both = of.where("x + y > 0").join(F.broadcast(of.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))))
    tiny = lambda e: f"greatest({e}, 1e-15D)"
    both = both.selectExpr(f"{tiny('x / sx')} as p", f"{tiny('y / sy')} as q", f"{tiny('(x / sx + y / sy) / 2')} as m")
    d = both.agg(F.expr("0.5D * sum(p * ln(p / m) + q * ln(q / m)) as d"))
    return d.select(r6(F.col("d")).alias("divergence"), F.when(F.col("d") < 0.03, "good").when(F.col("d") < 0.1, "moderate").otherwise("poor").alias("label"))


@query("aux_ruggedness", G + f" SELECT G.row, G.col, round(sum(abs(n.v - G.v)) / (count(n.v) - 1), 6) AS tri FROM G, {AROUND} JOIN G n ON n.row = G.row + dr AND n.col = G.col + dc GROUP BY 1, 2")
def ruggedness(spark, sf_dir):
    """Mean absolute difference to the neighbours, over those of the eight that there are."""
    h = R.haloed(grid(spark, sf_dir))
    across, down = Window.partitionBy("tr", "tc", "row").orderBy("col"), Window.partitionBy("tr", "tc", "col").orderBy("row")
    h = h.withColumns({"l": F.lag("v").over(across), "r": F.lead("v").over(across)}).withColumn("three", F.array("l", "v", "r"))
    h = h.withColumn("nine", F.concat(F.coalesce(F.lag("three").over(down), F.array().cast("array<double>")), "three", F.coalesce(F.lead("three").over(down), F.array().cast("array<double>"))))
    near = F.filter("nine", lambda x: x.isNotNull())
    total = F.aggregate(near, F.lit(0.0), lambda s, x: s + F.abs(x - F.col("v")))
    return h.where("own").select("row", "col", r6(total / (F.size(near) - 1)).alias("tri"))


@query("win_filter_small_regions", REGION_SQL + " SELECT row, col FROM L QUALIFY count(*) OVER (PARTITION BY seed) <= 2")
def filter_small(spark, sf_dir):
    return R.of_size(R.regions(high(spark, sf_dir)), "<=", 2).select("row", "col")


@query("win_filter_opened_regions")
def filter_opened(spark, sf_dir):
    """Whole regions of the mask of which an opened part of four cells or more is left."""
    m = mask(spark, sf_dir, 0.0)
    return R.seeded(m.where("m = 1").select("row", "col"), R.of_size(R.regions(R.opened(m).where("m = 1").select("row", "col")), ">=", 4)).select("row", "col")


@query("fn_ttl_expired", "SELECT event_id, ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events")
def ttl(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("interval 6 hours") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("expired"))


@query("fn_flattened_records", "SELECT doc_id, k AS key, v AS value FROM (SELECT doc_id, unnest(['doc.lang', 'doc.source', 'size.chars']) AS k, unnest([lang, source, n_chars::VARCHAR]) AS v FROM documents) WHERE v IS NOT NULL")
def flattened(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.struct("lang", "source").alias("doc"), F.struct(F.col("n_chars").alias("chars")).alias("size")).alias("r"))
    return S.flattened(d, "doc_id", "r")


@query("fn_section", "SELECT item_id, 'Item ' || item_id AS section FROM benchmark WHERE text IS NOT NULL")
def section(spark, sf_dir):
    text = F.concat(F.lit("\nnote\n## Item "), F.col("item_id").cast("string"), F.lit("\n"), "text")
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", X.section(text).alias("section"))
