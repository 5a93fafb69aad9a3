"""File names, patches, front matter, channels, metrics and rays on literal rows."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators import grids, scoring, search, terrain
from gridloom.sources import tilefiles


def test_tile_names(spark):
    names = ["r/00128/horizon_00128_00256_015.cbin", "r/horizon_00128_00256_015.bin", "HORIZON_00000_00128_000", "r/horizon_128_00256_015.bin", "r/horizon_00128_00256_015_x.bin", "", None]
    f = spark.createDataFrame([(n,) for n in names], "path string")
    assert {tuple(r) for r in tilefiles.tile_files(f).collect()} == {(128, 256, 15, names[0]), (0, 128, 0, names[2])}
    assert [r.path for r in tilefiles.tile_files(f, 0.0).collect()] == [names[2]]


def test_patches_left_and_filled(spark):
    p = tilefiles.patches(spark, 256, 384)
    assert [tuple(r) for r in p.orderBy("index").collect()] == [(0, 0, 0), (1, 0, 128), (2, 0, 256), (3, 128, 0), (4, 128, 128), (5, 128, 256)]
    done = spark.createDataFrame([(0, 128, 2.0), (128, 0, None)], "y long, x long, v double")
    assert {r["index"] for r in tilefiles.left_to_do(p, done).collect()} == {0, 2, 4, 5}
    assert [r.v for r in tilefiles.filled(p, done, "v", -1.0).orderBy("index").collect()] == [-1.0, 2.0, -1.0, -1.0, -1.0, -1.0]
    assert {r["index"] for r in tilefiles.patches(spark, 256, 384, (128, 0, 256, 256)).collect()} == {1, 4}
    with pytest.raises(ValueError):
        tilefiles.patches(spark, 256, 100)


def test_frames(spark):
    f = spark.createDataFrame([("d/a_2024-02-03T04-05-06.tif",), ("a-2024-02-03-04-05-06",), ("a_2024-13-40T04-05-06.tif",), ("d.e/plain.tif",)], "path string")
    at = datetime.datetime(2024, 2, 3, 4, 5, 6)
    assert [(r.at, r.series) for r in tilefiles.frames(f).collect()] == [(at, "a_"), (at, "a-"), (None, "a_"), (None, "plain")]


def test_newest_file_and_empty_tree(spark):
    f = spark.createDataFrame([("a/b/x", 1, 5), ("a/y", 2, 7), ("z", 4, 9)], "path string, bytes long, mtime long")
    assert {tuple(r) for r in tilefiles.tree_stats(f).collect()} == {("a", 2, 3, 7), ("a/b", 1, 1, 5)}
    assert tilefiles.tree_stats(f.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (2, "c", 1)], "k int, path string, mtime long")
    assert {r.path for r in tilefiles.newest(same, "k").collect()} == {"b", "c"}


def test_front_matter(spark):
    texts = ["a: 1\nA: 2\n\nbody: x\n", "body only", "k: v", "", None, "a:no space\nb: 1"]
    f = search.front_matter(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {r.doc_id: (r.metadata, r.body) for r in f.collect()}
    assert got == {0: ({"a": "2"}, "body: x"), 1: ({}, "body only"), 2: ({"k": "v"}, ""), 3: ({}, ""), 4: ({}, ""), 5: ({}, "a:no space\nb: 1")}


def test_channels(spark):
    q = spark.createDataFrame([("How to run a moon job",), ("Moon surface run",), ("run moon",), ("run run moon crater",), ("  ",), (None,)], "q string")
    assert [r.c for r in q.select(X.routed(F.col("q"), "domain").alias("c")).collect()] == ["procedural", "domain", "domain", "domain", "mixed", "mixed"]
    split = lambda k, i, p, d: tuple(spark.range(1).select(X.channel_split(F.lit(k), F.lit(i), F.lit(p), F.lit(d)).alias("s")).first().s)
    assert [split(8, "procedural", 0.8, 0.2), split(1, "domain", 0.2, 0.8), split(5, "mixed", 0.0, 0.0), split(3, "mixed", 0.5, 0.5)] == [(6, 2), (1, 1), (2, 2), (1, 2)]


def test_sanitised(spark):
    t = spark.createDataFrame([("a  b\r\nc\td\r\r\r é x \n \n",), ("",)], "t string")
    assert [r.t for r in t.select(X.sanitised(F.col("t")).alias("t")).collect()] == ["a b c d\n\nx", ""]


def test_metrics_of_no_rows(spark):
    t = spark.createDataFrame([], "base int, order int, eligible boolean, first_try boolean")
    assert tuple(scoring.prefilter(t).first()) == (0.0, 0.0, 0.0)
    one = spark.createDataFrame([(1, 1, False, True), (1, 2, True, True), (2, 1, None, True), (3, 1, True, True), (4, 1, True, None)], t.schema)
    assert tuple(round(x, 4) for x in scoring.prefilter(one).first()) == (0.6667, 0.3333, 1.0)


def test_extra_and_missing_ids(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert {(r.id, r.state) for r in scoring.matched(a, b).collect()} == {(1, "missing"), (2, "matched"), (3, "extra")}


def test_nested_grid(spark):
    fine = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)], "row long, col long, v double")
    coarse = spark.createDataFrame([(0, 0, 7.0), (-1, 0, 8.0)], "row long, col long, v double")
    got = {(r.row, r.col): r.v for r in grids.nested(fine, coarse, 1, 2).collect()}
    assert len(got) == 16 and got[0, 0] == 1.0 and got[0, 1] == 7.0 and got[-1, 0] == 8.0 and got[2, 2] is None


def test_horizons_of_every_cell(spark):
    z = np.random.default_rng(3).normal(0, 5, (6, 7))
    dem = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(6) for c in range(7)], "row long, col long, v double")
    got = {r.id: r.horizon for r in terrain.horizons(dem.select((F.col("row") * 7 + F.col("col")).alias("id"), "row", "col"), dem, 8, 9).collect()}
    assert len(got) == 42
    for r in range(6):
        for c in range(7):
            for d in range(8):
                best, a = -90.0, 2 * math.pi * d / 8
                for s in range(1, 10):
                    y, x = math.floor(r - math.cos(a) * s + 0.5), math.floor(c + math.sin(a) * s + 0.5)
                    if 0 <= y < 6 and 0 <= x < 7:
                        far = math.hypot(y - r, x - c)
                        best = max(best, math.degrees(math.atan((z[y, x] - far**2 / (2 * 1737400.0) - z[r, c] - 0.05) / far)))
                assert got[r * 7 + c][d] == pytest.approx(best)


def test_tiles_beyond_five_digits(spark):
    """Names take as many digits as a cell needs; a catalog's own key goes before a name that has no room for it."""
    names = ["r/horizon_00128_100096_020.bin", "r/horizon_000128_00256_015.bin", "r/horizon_1000000000_00256_015.bin"]
    f = spark.createDataFrame([(n,) for n in names], "path string")
    assert [tuple(r) for r in tilefiles.tile_files(f).collect()] == [(128, 100096, 20, names[0])]
    known = [("r/horizon_00128_10009_020.bin", 128, 100096, 20), ("r/tile_00128_10009_020.bin", 128, 100224, 20)]
    found = tilefiles.tile_files(spark.createDataFrame(known, "path string, y int, x int, elevation int"), 2.0)
    assert [tuple(r) for r in found.collect()] == [(128, 100096, 20, known[0][0])]


def test_equal_names_are_resolved_once(spark, monkeypatch):
    """As many features and mentions of one name as there are: only the first feature of a name and type goes into the join."""
    kept = {}
    monkeypatch.setattr(search, "stored", lambda df, name, stored=search.stored: kept.setdefault(name, stored(df, name)))
    f = spark.range(300).select(F.col("id").alias("feature_id"), F.lit("mons a").alias("clean_name"), F.when(F.col("id") % 2 == 0, "Mons, x").otherwise("Mare").alias("feature_type"), F.when(F.col("id") > 9, F.col("id") % 7).cast("double").alias("importance"))
    m = spark.range(400).select("id", F.when(F.col("id") < 300, "Mons A").when(F.col("id") < 399, "mons  a").alias("name"), F.when(F.col("id") % 2 == 0, "sea").alias("type"))
    got = {r.id: r.feature_id for r in search.resolved(m, f).collect()}
    assert got == {i: 13 for i in range(399)}  # 13 is Mare and the least of importance 6; without a type it is the first of all
    assert kept["firsts"].count() == 2 and kept["variants"].select("name", "type").distinct().count() <= 4


def test_name_variants_evaluate_their_parts_once(spark):
    df = spark.createDataFrame([(" Mons  A ", "mountain"), ("Mare", None), ("a mare", "Sea"), (None, "x"), (" ", None)], "n string, t string").select(X.name_variants(F.col("n"), F.col("t")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 20
    got = [[(x.name, x.type) for x in r.v] for r in df.collect()]
    assert got[0] == [("Mons A", "Mons"), ("A", "Mons"), ("A Mons", "Mons"), ("Mons A", None)]
    assert got[1] == [("Mare", None)] and got[3] == [] and got[4] == []
    assert got[2] == [("a mare", "Mare"), ("a", "Mare"), ("Mare a", "Mare"), ("a mare", None)]


def test_terms_are_counted_in_their_texts(spark):
    docs = spark.createDataFrame([(1, "The of the"), (1, "of"), (2, None), (3, "!"), (4, "other_1 words"), (None, "the")], "doc_id long, text string")
    q = ["the", "of", "the"]
    a, b = search.counted_texts(docs, q), search.counted(search.postings(docs), q)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert "Generate" not in a._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.matched) for r in search.best(search.scored(a, 2), 2, 5).collect()] == [(1, 2)]
