"""Queries of temporal reducers, runs, crossings and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import timeline as T
from gridloom.plans.registry import query
from gridloom.sources.tables import stored, table

SECONDS = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
H = "WITH H AS (SELECT user_id AS cell, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS t, avg(value) AS value FROM events GROUP BY 1, 2)"
HD = H + ", D AS (SELECT cell, t, value FROM (SELECT DISTINCT cell FROM H) CROSS JOIN (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM H) LEFT JOIN H USING (cell, t))"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, t, value): a user's mean event value by hour since 2024."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("cell"), F.floor(F.expr(SECONDS) / 3600).alias("t")).agg(F.avg("value").alias("value"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every hour, gaps as NULL."""
    return T.filled(stored(hourly(spark, sf_dir), "hours"))


def r6(c):
    return F.round(c, 6)


@query("agg_temporal_reducers", H + " SELECT cell, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM H GROUP BY cell")
def reducers(spark, sf_dir):
    return T.reduced(hourly(spark, sf_dir)).select("cell", *[r6(F.col(c)).alias(c) for c in ("low", "high", "mean", "deviation")])


@query("agg_average_fraction", H + " SELECT cell, round(avg(least(floor(value / 2), 255)) / 255, 6) AS fraction FROM H GROUP BY cell")
def average_fraction(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("cell").agg(r6(F.avg(F.least(F.floor(F.col("value") / 2), F.lit(255))) / 255).alias("fraction"))


@query("agg_cumulative_duration", H + " SELECT cell, coalesce(sum(CASE WHEN value >= 50 THEN 1.0::DOUBLE END), 0.0) AS duration FROM H GROUP BY cell")
def cumulative(spark, sf_dir):
    return T.total_duration(hourly(spark, sf_dir), F.col("value") >= 50)


RUNS = HD + ", F AS (SELECT cell, t, coalesce({flag}, false) AS f FROM D), I AS (SELECT cell, t, f, row_number() OVER (PARTITION BY cell ORDER BY t) - row_number() OVER (PARTITION BY cell, f ORDER BY t) AS g FROM F), R AS (SELECT cell, g, min(t) AS first, max(t) AS last, count(*) AS n FROM I WHERE f GROUP BY cell, g)"


@query("win_runs", RUNS.format(flag="value >= 20") + " SELECT cell, first, last, n FROM R")
def runs(spark, sf_dir):
    return T.runs(dense(spark, sf_dir), F.col("value") >= 20)


LONGEST = " SELECT cell, coalesce(max(n), 0)::DOUBLE AS duration FROM (SELECT DISTINCT cell FROM D) LEFT JOIN R USING (cell) GROUP BY cell"


@query("agg_longest_duration", RUNS.format(flag="value >= 20") + LONGEST)
def longest(spark, sf_dir):
    return T.longest_run(dense(spark, sf_dir), F.col("value") >= 20)


@query("agg_combined_longest_duration", RUNS.format(flag="value >= 20 AND t % 24 >= 6") + LONGEST)
def combined(spark, sf_dir):
    return T.longest_run(dense(spark, sf_dir), (F.col("value") >= 20) & (F.col("t") % 24 >= 6))


@query("aux_longest_sunny_period", RUNS.format(flag="value > 0") + " SELECT cell, coalesce(max(n), 0) * 0.5::DOUBLE AS duration FROM (SELECT DISTINCT cell FROM D) LEFT JOIN R USING (cell) GROUP BY cell")
def sunny(spark, sf_dir):
    return T.longest_run(dense(spark, sf_dir), F.col("value") > 0, 0.5)


@query("win_local_minima", H + " SELECT cell, t, round(value, 6) AS value FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM H WINDOW w AS (PARTITION BY cell ORDER BY t)) WHERE b > value AND value <= a")
def minima(spark, sf_dir):
    return T.local_minima(hourly(spark, sf_dir)).select("cell", "t", r6(F.col("value")).alias("value"))


@query("win_below_threshold_regions", H + ", I AS (SELECT cell, t, value < 30 AS f, row_number() OVER (PARTITION BY cell ORDER BY t) - row_number() OVER (PARTITION BY cell, value < 30 ORDER BY t) AS g FROM H) SELECT cell, min(t) AS first, max(t) AS last FROM I WHERE f GROUP BY cell, g")
def below(spark, sf_dir):
    return T.runs(hourly(spark, sf_dir), F.col("value") < 30).drop("n")


@query("win_crossings", H + ", L AS (SELECT *, lag(value) OVER w AS v0, lag(t) OVER w AS t0 FROM H WINDOW w AS (PARTITION BY cell ORDER BY t)) SELECT cell, t0 AS before, t AS after, value >= 40 AS rising, round(t0 + (40 - v0) / (value - v0) * (t - t0), 6) AS at FROM L WHERE (v0 >= 40) <> (value >= 40)")
def crossings(spark, sf_dir):
    return T.crossings(hourly(spark, sf_dir), 40.0).withColumn("at", r6(F.col("at")))


PASSES = H + """, I AS (SELECT cell, t, value >= 40 AS f, row_number() OVER (PARTITION BY cell ORDER BY t) - row_number() OVER (PARTITION BY cell, value >= 40 ORDER BY t) AS g, min(t) OVER (PARTITION BY cell) AS a, max(t) OVER (PARTITION BY cell) AS b FROM H),
P AS (SELECT cell, min(t) AS start, max(t) AS stop FROM I WHERE f GROUP BY cell, g, a, b HAVING min(t) > a AND max(t) < b)"""


@query("fn_station_passes", PASSES + " SELECT cell, start, stop FROM P")
def passes(spark, sf_dir):
    return T.passes(hourly(spark, sf_dir), 40.0)


MERGED = PASSES + """, Q AS (SELECT cell % 10 AS site, start, stop FROM P),
N AS (SELECT site, start, stop, sum(fresh) OVER (PARTITION BY site ORDER BY start, stop) AS n FROM (
  SELECT *, CASE WHEN max(stop) OVER (PARTITION BY site ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS fresh FROM Q)),
M AS (SELECT site, min(start) AS start, max(stop) AS stop FROM N GROUP BY site, n)"""


def site_passes(spark, sf_dir):
    """Passes of all stations of a site together: a bag union."""
    return T.passes(hourly(spark, sf_dir), 40.0).select((F.col("cell") % 10).alias("site"), "start", "stop")


@query("set_station_union", PASSES + " SELECT cell % 10 AS site, start, stop FROM P")
def union(spark, sf_dir):
    return site_passes(spark, sf_dir)


@query("fn_coalesce_intervals", MERGED + " SELECT site, start, stop FROM M")
def merged(spark, sf_dir):
    return T.coalesced(site_passes(spark, sf_dir), "site")


@query("fn_coverage_gaps", MERGED + " SELECT site, stop AS start, nxt AS stop FROM (SELECT site, stop, lead(start) OVER (PARTITION BY site ORDER BY start) AS nxt FROM M) WHERE nxt IS NOT NULL")
def coverage_gaps(spark, sf_dir):
    return T.gaps(site_passes(spark, sf_dir), "site")


@query("jn_as_of_frame", H + ", K AS (SELECT cell, unnest(range(0, 720, 5))::BIGINT AS t FROM (SELECT DISTINCT cell FROM H)) SELECT K.cell, K.t, round(H.value, 6) AS value FROM K ASOF LEFT JOIN H ON K.cell = H.cell AND K.t >= H.t")
def as_of(spark, sf_dir):
    h = hourly(spark, sf_dir)
    asked = h.select("cell").distinct().select("cell", F.explode(F.expr("sequence(0L, 719L, 5L)")).alias("t"))
    return T.as_of(asked, h, "cell").select("cell", "t", r6(F.col("value")).alias("value"))


@query("fn_interval_relations", MERGED + " SELECT a.site, a.start, a.stop, count(*) AS touching FROM M a JOIN P b ON a.site = b.cell % 10 AND b.start <= a.stop AND b.stop >= a.start GROUP BY a.site, a.start, a.stop")
def relations(spark, sf_dir):
    p = site_passes(spark, sf_dir)
    m, q = T.coalesced(p, "site").alias("m"), p.alias("q")
    met = m.join(q, (F.col("m.site") == F.col("q.site")) & (F.col("q.start") <= F.col("m.stop")) & (F.col("q.stop") >= F.col("m.start")))
    return met.groupBy("m.site", "m.start", "m.stop").agg(F.count(F.lit(1)).alias("touching"))


@query("krn_safe_haven", H + """, I AS (SELECT cell, t, value < 30 AS f, row_number() OVER (PARTITION BY cell ORDER BY t) - row_number() OVER (PARTITION BY cell, value < 30 ORDER BY t) AS g FROM H),
E AS (SELECT cell, min(t) AS first, max(t) AS last FROM I WHERE f GROUP BY cell, g),
B AS (SELECT E.cell, first, last, t, value > 10 AS ok FROM E JOIN H ON H.cell = E.cell AND t >= first AND t < last),
G AS (SELECT *, row_number() OVER (PARTITION BY cell, first ORDER BY t) - row_number() OVER (PARTITION BY cell, first, ok ORDER BY t) AS g FROM B),
X AS (SELECT cell, first, max(n) AS n FROM (SELECT cell, first, g, count(*) AS n FROM G WHERE ok GROUP BY cell, first, g) GROUP BY cell, first)
SELECT cell, first, last, CAST(least(coalesce(n, 0), 255) AS INTEGER) AS duration FROM E LEFT JOIN X USING (cell, first)""")  # fmt: skip
def haven(spark, sf_dir):
    return T.lowest_windows(hourly(spark, sf_dir), 30.0, 10.0)


@query("fn_time_axis", H + " SELECT cell, unnest(range(min(t), max(t) + 1, 6))::BIGINT AS t FROM H GROUP BY cell")
def axis(spark, sf_dir):
    """Every sixth hour of each series, from its first to its last."""
    return T.time_axes(hourly(spark, sf_dir), 6)


@query("aux_date_starts", "SELECT event_id, CAST(date_trunc('month', ts) AS VARCHAR)[:10] AS month, CAST(date_trunc('week', ts) AS VARCHAR)[:10] AS week, CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, hour(ts)::INTEGER AS hour FROM events")
def starts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *[F.date_format(F.date_trunc(k, "ts"), "yyyy-MM-dd").alias(k) for k in ("month", "week", "day")], F.hour("ts").alias("hour"))


@query("krn_static_over_time", HD + ", S AS (SELECT cell, avg(value) AS base FROM H GROUP BY cell) SELECT cell, count(value) AS n, coalesce(sum(CASE WHEN value > base THEN 1 END), 0)::BIGINT AS over_base FROM D JOIN S USING (cell) GROUP BY cell")
def static(spark, sf_dir):
    h = stored(hourly(spark, sf_dir), "hours")  # once: means that are taken twice may differ in their last digits
    d = T.filled(h)
    base = h.groupBy("cell").agg(F.avg("value").alias("base"))
    return d.join(base, "cell").groupBy("cell").agg(F.count("value").alias("n"), F.coalesce(F.sum(F.when(F.col("value") > F.col("base"), 1)), F.lit(0)).cast("long").alias("over_base"))


@query("krn_light_curve_lists", H + """, M AS (SELECT DISTINCT list, t FROM (SELECT t, unnest(list_filter([CASE WHEN t % 3 = 0 THEN 'thirds' END, CASE WHEN t % 24 BETWEEN 6 AND 17 THEN 'days' END], lambda x: x IS NOT NULL)) AS list FROM H)),
 X AS (SELECT cell, list, t, value, row_number() OVER w AS i, lag(value) OVER w AS b, value >= 20 AS f FROM H JOIN M USING (t) WINDOW w AS (PARTITION BY cell, list ORDER BY t)),
 G AS (SELECT *, i - row_number() OVER (PARTITION BY cell, list, f ORDER BY t) AS g FROM X), R AS (SELECT cell, list, max(n) AS n FROM (SELECT cell, list, g, count(*) AS n FROM G WHERE f GROUP BY cell, list, g) GROUP BY cell, list)
 SELECT cell, list, round(count(*) FILTER (f) / count(*), 6) AS share, coalesce(any_value(n), 0)::INTEGER AS longest, round(coalesce(max(abs(value - b)), 0), 6) AS largest FROM G LEFT JOIN R USING (cell, list) GROUP BY cell, list""")
def light_curve_lists(spark, sf_dir):
    """Two lists of times over the same series, three reducers in one pass."""
    h = hourly(spark, sf_dir)
    both = F.array(F.when(F.col("t") % 3 == 0, "thirds"), F.when((F.col("t") % 24).between(6, 17), "days"))
    lists = h.select("t").distinct().select("t", F.explode(F.array_compact(both)).alias("list"))
    found = T.light_curves(h, lists, {"share": T.share_above(20), "longest": T.longest_above(20), "largest": T.largest_step})
    return found.select("cell", "list", r6(F.col("share")).alias("share"), "longest", r6(F.col("largest")).alias("largest"))
