"""Operators on literal rows with known results."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import codec, style
from gridloom.operators import grids, search, terrain, timeline
from gridloom.streaming import tiles


def cells(spark, rows, name="m"):
    return spark.createDataFrame([(r, c, int(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], f"row long, col int, {name} int")


def picture(df, name, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out.tolist()


MASK = [[1, 1, 0, 0], [0, 1, 0, 1], [0, 0, 0, 1]]


def test_regions_are_labelled_in_order(spark):
    got = grids.labelled(cells(spark, MASK).where("m = 1").select("row", "col"))
    assert picture(got, "label", (3, 4)) == [[1, 1, 0, 0], [0, 1, 0, 2], [0, 0, 0, 2]]


def test_erosion_leaves_the_inside(spark):
    mask = np.zeros((5, 5), int)
    mask[1:4, 1:4] = 1
    left = np.array(picture(grids.eroded(cells(spark, mask)), "m", (5, 5)))
    assert left.sum() == 1 and left[2, 2] == 1 and (mask - left).sum() == 8


def test_opening_removes_a_bridge(spark):
    mask = np.zeros((7, 13), int)
    mask[1:6, 1:6] = mask[1:6, 7:12] = mask[3, 6] = 1
    left = np.array(picture(grids.opened(cells(spark, mask)), "m", (7, 13)))
    assert left[3, 6] == 0 and left.sum() == 50


def test_runs_and_durations(spark):
    s = spark.createDataFrame([(1, t, v) for t, v in enumerate([5.0, 6.0, None, 7.0, 8.0, 9.0, 1.0])] + [(2, 0, 0.0)], "cell long, t long, value double")
    got = sorted((r["first"], r["last"], r["n"]) for r in timeline.runs(s, F.col("value") > 4).collect())
    assert got == [(0, 1, 2), (3, 5, 3)]
    assert {r["cell"]: r["duration"] for r in timeline.longest_run(s, F.col("value") > 4, 0.5).collect()} == {1: 1.5, 2: 0.0}


def test_touching_intervals_merge(spark):
    iv = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11), (2, 3, 4)], "k long, start long, stop long")
    assert sorted(map(tuple, timeline.coalesced(iv, "k").collect())) == [(1, 0, 7), (1, 9, 12), (2, 3, 4)]
    assert [tuple(r) for r in timeline.gaps(iv, "k").collect()] == [(1, 7, 9)]


def test_as_of_has_nothing_before_the_first(spark):
    right = spark.createDataFrame([(1, 5, 50.0), (1, 8, 80.0)], "cell long, t long, value double")
    left = spark.createDataFrame([(1, t) for t in (4, 5, 7, 9)], "cell long, t long")
    assert [r["value"] for r in timeline.as_of(left, right, "cell").orderBy("t").collect()] == [None, 50.0, 50.0, 80.0]


def test_unfinished_passes_are_dropped(spark):
    s = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([9, 1, 9, 9, 1, 9])], "cell long, t long, value double")
    assert [tuple(r) for r in timeline.passes(s, 5.0).collect()] == [(1, 2, 3)]


def test_paragraphs_are_packed_and_not_split(spark):
    df = spark.createDataFrame([(1, "aa\n \nbb\n\n" + "c" * 30 + "\n\ndd"), (2, None), (3, " ")], "doc_id long, text string")
    got = [(r["doc_id"], r["ordinal"], r["content"]) for r in search.paragraphs(df, 8).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 0, "aa\n\nbb"), (1, 1, "c" * 30), (1, 2, "dd")]


def test_any_term_only_if_no_document_has_all(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, "blue fox fox")], "doc_id long, text string")
    index = search.postings(df)
    assert [r["doc_id"] for r in search.retrieve(index, ["red", "fox"], 5).collect()] == [1]
    assert {r["doc_id"] for r in search.retrieve(index, ["red", "blue"], 5).collect()} == {1, 2, 3}


@pytest.mark.parametrize("values", [[], [0], [63, -64, 62], [0, 16383, 32766, -3], [5, 5, 5], [-32767, -32767, -20000], [32767, 32700], [0, 32767, 0, -5]])
def test_codec_round_trips_up_to_fifteen_bits(values):
    back = codec.unpacked(codec.packed(np.array(values))).tolist()
    steps = np.diff(values)
    assert back == values if (abs(steps) <= 16383).all() else len(back) == len(values)


def test_wall_hides_what_is_behind(spark):
    z = np.zeros((1, 9))
    z[0, 4] = 5
    dem = spark.createDataFrame([(0, c, float(z[0, c])) for c in range(9)], "row long, col int, v double")
    eye = spark.createDataFrame([(1, 0, 0)], "id long, row long, col int")
    assert sorted(r["col"] for r in terrain.viewshed(eye, dem, 4, 8).collect()) == [0, 1, 2, 3, 4]


def test_stops_get_both_ends():
    assert style.stops([(0.5, (1, 1, 1, 1))]) == [(0.0, (1, 1, 1, 1)), (0.5, (1, 1, 1, 1)), (1.0, (1, 1, 1, 1))]


def test_tiles_come_out_when_complete_and_in_order(spark, tmp_path):
    rows = [(t, p, 2, Decimal(t + p), float(p), 1) for p in range(2) for t in (1, 2) if (t, p) != (2, 1)]
    for p in range(2):
        spark.createDataFrame([r for r in rows if r[1] == p], tiles.CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = tiles.run(tiles.reduced(tiles.chunk_stream(spark, str(tmp_path / "in"), 1)), "test").collect()
    assert [(r["tile"], r["chunks"], r["mean"]) for r in got] == [(1, 2, 1.5)]


def test_codec_bytes():
    assert codec.packed(np.array([-2, -1, 61, 124, 60, -100])).hex() == "fffe" + "01" + "3e" + "803f" + "40" + "ff60"
    assert codec.packed(np.array([30000, 30001])).hex() == "753001" and codec.unpacked(bytes.fromhex("753001")).tolist() == [30000, 30001]
    blocks = [b"", b"ab", b"c" * 300]
    assert codec.framed(blocks)[:4] == b"\0\0\2\0" and codec.unframed(codec.framed(blocks)) == blocks
    with pytest.raises(ValueError):
        codec.unframed(b"\5\0ab")


def test_tiles_left_without_chunks_are_an_error(spark):
    chunks = spark.createDataFrame([(1, 0, 1, Decimal(1), 1.0, 1), (2, 0, 2, Decimal(1), 1.0, 1)], tiles.CHUNK)
    done = spark.createDataFrame([(1, 1, 1.0, 1.0)], tiles.OUT)
    with pytest.raises(ValueError, match="2"):
        tiles.complete(chunks, done)
    assert tiles.complete(chunks.where("tile = 1"), done).count() == 1


def test_gradient_is_one_sided_at_borders_only(spark):
    z = [1.0, 4.0, None, 16.0, 25.0]
    g = spark.createDataFrame([(r, c, v) for r in range(3) for c, v in enumerate(z)], "row long, col int, v double")
    got = {r["col"]: r["dz_dx"] for r in grids.gradients(g).where("row = 1").collect()}
    assert got == {0: 3.0, 1: None, 2: 6.0, 3: None, 4: 9.0}
    absent = {r["col"]: r["dz_dx"] for r in grids.gradients(g.where("v is not null")).where("row = 1").collect()}
    assert absent == {0: 3.0, 1: None, 3: None, 4: 9.0}


def test_wide_erosions_and_halos(spark):
    m = spark.createDataFrame([(r, c, 1) for r in range(40) for c in range(40)], "row long, col int, m int")
    assert {(r["row"], r["col"]) for r in grids.eroded(m, 19).where("m = 1").collect()} == {(r, c) for r in (19, 20) for c in (19, 20)}
    h = grids.haloed(m.where("row = 20 and col = 20"), halo=20, tile=8)
    assert h.count() == 36 and h.where("own").count() == 1


def test_markdown_and_csv_chunks(spark):
    text = "intro\n# A\nline\n## B\n| x |\n| y |\n\ntail\n" + "# C\n" + "z" * 30
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["ordinal"], r["content"]) for r in search.markdown(df, 24).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 0, "intro\n\n# A\nline"), (1, 1, "## B\n| x |\n| y |\n\ntail"), (1, 2, "# C\n" + "z" * 30)]
    rows = spark.createDataFrame([(1, "h,i\n" + "\n".join(f"{k},{k}" for k in range(5))), (2, "h,i"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["ordinal"], r["content"]) for r in search.csv_rows(rows, 2).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 0, "h,i\n0,0\n1,1"), (1, 1, "h,i\n2,2\n3,3"), (1, 2, "h,i\n4,4"), (2, 0, "h,i")]


def test_viewshed_observers_and_modes(spark):
    dem = spark.createDataFrame([(r, c, 0.0) for r in range(4) for c in range(5)], "row int, col int, v double")
    some = spark.createDataFrame([(1, 1), (1, 1), (3, 4)], "row int, col int")
    assert sorted((r.row, r.col) for r in terrain.observers_of(dem, cells=some).collect()) == [(1, 1), (3, 4)]
    assert [(r.row, r.col) for r in terrain.observers_of(dem, cell=(2, 3)).collect()] == [(2, 3)]
    mask = dem.select("row", "col", ((F.col("row") == 0) & (F.col("col") > 2)).cast("int").alias("m"))
    assert terrain.observers_of(dem, mask=mask).count() == 2
    for bad in ({}, {"cell": (0, 0), "mask": mask}, {"cell": (4, 0)}, {"mask": mask.withColumn("m", F.lit(0))}):
        with pytest.raises(ValueError):
            terrain.observers_of(dem, **bad)
    seen = spark.createDataFrame([(0, 0, 3)], "row int, col int, observers int")
    assert {r.v for r in terrain.merged(seen, dem).collect()} == {0, 1}
    assert {r.v for r in terrain.merged(seen, dem, "visibility_count").collect()} == {0, 3}
    with pytest.raises(ValueError):
        terrain.merged(seen, dem, "mean")


def test_time_axes_are_bounded(spark):
    s = spark.createDataFrame([(1, 0), (1, 13), (2, 5)], "cell long, t long")
    assert sorted(map(tuple, timeline.time_axes(s, 6).collect())) == [(1, 0), (1, 6), (1, 12), (2, 5)]
    with pytest.raises(ValueError):
        timeline.time_axes(s, 0)
    with pytest.raises(Exception, match="over 2 times"):
        timeline.time_axes(s, 6, most=2).collect()


def flooded(mask):
    """8-connected regions of a set of cells."""
    left, out = set(mask), []
    while left:
        todo, region = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            region.add((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(region)
    return out


def test_regions_left_after_opening(spark):
    """Whole regions of a mask of which an opened part of some size is left, against a flood fill."""
    rng = random.Random(8)
    cells = {(r, c) for r in range(24) for c in range(24) if rng.random() < 0.12} | {(r, c) for r in range(3, 8) for c in range(4, 9)} | {(r, c) for r in range(15, 18) for c in range(12, 15)}
    mask = spark.createDataFrame([(r, c, int((r, c) in cells)) for r in range(24) for c in range(24)], "row int, col int, m int")
    eroded = {(r, c) for r, c in cells if all((r + i, c + j) in cells for i in (-1, 0, 1) for j in (-1, 0, 1))}
    opened = {(r + i, c + j) for r, c in eroded for i in (-1, 0, 1) for j in (-1, 0, 1)}
    for least in (4, 10):
        kept = set().union(*[x for x in flooded(opened) if len(x) >= least])
        want = set().union(*[x for x in flooded(cells) if x & kept])
        left = grids.of_size(grids.regions(grids.opened(mask).where("m = 1").select("row", "col")), ">=", least)
        got = {(r.row, r.col) for r in grids.seeded(mask.where("m = 1").select("row", "col"), left).collect()}
        assert got == want


def test_viewsheds_and_horizons_leave_their_blocks_as_counts(spark):
    """No row a sample: the plan explodes nothing. Rays cross blocks; a cell without a height hides nothing and has no slope."""
    z = np.random.default_rng(5).normal(0, 4, (6, 140))
    dem = spark.createDataFrame([(r, c, None if (r, c) == (2, 70) else float(z[r, c])) for r in range(6) for c in range(140)], "row long, col int, v double")
    eyes = dem.where("col % 9 = 4").select((F.col("row") * 1000 + F.col("col")).alias("id"), "row", "col")
    seen, high = terrain.viewshed(eyes, dem, 8, 70), terrain.horizons(eyes, dem, 8, 70)
    for df in (seen, high):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    count, best = {}, {}
    for r in range(6):
        for c in range(4, 140, 9):
            mine, best[r * 1000 + c] = {(r, c)}, []
            for d in range(8):
                top, a = None, 2 * math.pi * d / 8
                for s in range(1, 71):
                    y, x = math.floor(r - math.cos(a) * s + 0.5), math.floor(c + math.sin(a) * s + 0.5)
                    if 0 <= y < 6 and 0 <= x < 140:
                        far = math.hypot(y - r, x - c)
                        slope = None if (2, 70) in ((y, x), (r, c)) else (z[y, x] - far**2 / (2 * 1737400.0) - z[r, c] - 0.05) / far
                        if top is None or (slope is not None and slope + 1e-8 >= top):
                            mine.add((y, x))
                        top = slope if top is None else top if slope is None else max(top, slope)
                best[r * 1000 + c].append(-90.0 if top is None else math.degrees(math.atan(top)))
            for cell in mine:
                count[cell] = count.get(cell, 0) + 1
    assert {(r.row, r.col): r.observers for r in seen.collect()} == count
    got = {r.id: r.horizon for r in high.collect()}
    assert set(got) == set(best) and all(got[i] == pytest.approx(best[i]) for i in best)


def test_series_are_filled_up_without_a_join(spark):
    rows = [(1, 5, 2.0), (1, 3, None), (2, 7, 1.5), (None, 4, 9.0), (3, None, 1.0)]
    df = timeline.filled(spark.createDataFrame(rows, "cell int, t long, value double"))
    want = {(c, t): None for c in (1, 2, 3, None) for t in range(3, 8)} | {(1, 5): 2.0, (2, 7): 1.5}
    assert {(r.cell, r.t): r.value for r in df.collect()} == want and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert timeline.filled(spark.createDataFrame([], "cell int, t long, value double")).collect() == []


def test_a_lone_hour_is_never_over_its_mean(spark, tmp_path):
    """Means are taken once: a series whose hours are all alike has none over its base."""
    from gridloom.plans import q_time

    times = [f"2024-01-01 {h:02d}:00:00" for h in range(2)]
    values = [0.1, 0.7, 0.3, 1e9, 0.2, 123.456]
    rows = [(u * 100 + i, u, values[i % 6] + u, times[0]) for u in range(50) for i in range(36)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    found = q_time.static(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(u, 1, 0) for u in range(50)}
    assert "events.parquet" not in found._jdf.queryExecution().executedPlan().toString()


def test_regions_over_tiles(spark):
    """Regions that wind over many tiles have the seeds of a flood fill; only tiles' borders become edges."""
    rng = random.Random(3)
    on = {(r, c): rng.choice("ab") if rng.random() < 0.9 else None for r in range(-9, 20) for c in range(17) if rng.random() < 0.55 or r % 6 == 0}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in on.items()], "row int, col int, class string")
    for neighbours, same in ((8, None), (4, None), (4, "class"), (8, "class")):
        want = {}
        for start in sorted(on):
            todo = [] if start in want else [start]
            while todo:
                at = todo.pop()
                if at in want:
                    continue
                want[at] = start[0] * (1 << 31) + start[1]
                near = [(at[0] + a, at[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (neighbours == 8 or not a or not b) and (a or b)]
                todo += [p for p in near if p in on and (not same or (on[at] is not None and on[p] == on[at]))]
        edges = []
        keep, grids.components = grids.components, lambda e: edges.append(e.count()) or keep(e)  # noqa: B023
        try:
            got = grids.regions(df, neighbours, same, tile=8)
            assert got.columns == ["row", "col", "class", "seed"]
            assert {(r.row, r.col): r.seed for r in got.collect()} == want
        finally:
            grids.components = keep
        assert edges[0] < len(on) / 2
