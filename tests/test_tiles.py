"""Reducers in batch and in streams against numpy, and what they refuse; tile payloads, store and migration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.plans.q_tiles import REDUCERS
from gridloom.sources import tilestore as S
from gridloom.streaming import reducers as R
from gridloom.streaming import tiles


def series(seed=1, n_tiles=5, cells=3, total=23):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n_tiles, total, 2, cells)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    return x


def chunk_rows(x, cuts):
    total = x.shape[1]
    return [(k, a, b - a, total, 2, x[k, a:b].ravel().tolist()) for k in range(len(x)) for a, b in zip([0, *cuts], [*cuts, total], strict=True)]


def want(x, step=0.5):
    out = {}
    for k, tile in enumerate(x):
        v, hour = tile[:, 0], tile[:, 1]
        sunny = (v >= 20) & (hour >= 6)
        out[k, "mean"], out[k, "sunny"] = np.nanmean(v, 0), sunny.sum(0) * step
        best = []
        for c in range(v.shape[1]):
            run = most = 0
            for f in sunny[:, c]:
                run = run + 1 if f else 0
                most = max(most, run)
            best.append(most * step)
        out[k, "longest"], out[k, "swing"] = np.array(best), np.nanmax(v, 0) - np.nanmin(v, 0)
    return out


def same(rows, x):
    got, due = {(r.tile, r.reducer): np.array(r["values"], float) for r in rows}, want(x)
    assert len(rows) == len(got) and set(got) == set(due)
    for k in due:
        assert got[k] == pytest.approx(due[k])


@pytest.mark.parametrize("cuts", [[], [1], [4, 5, 20]])
def test_batch(spark, cuts):
    x = series()
    chunks = spark.createDataFrame(chunk_rows(x, cuts), R.CHUNK_SQL).repartition(3)
    same(R.reduced(chunks, REDUCERS, 0.5).collect(), x)


def test_stream_stops_and_goes_on(spark, tmp_path):
    """A chunk a run: each run starts from the checkpoint of the one before, and tiles come once, at their end."""
    x, folder = series(), f"{tmp_path}/chunks"
    R.stored_states(spark)
    rows = spark.createDataFrame(chunk_rows(x, [6, 11]), R.CHUNK_SQL).cache()
    counts = []
    for start in (0, 6, 11):
        rows.where(F.col("start") == start).write.mode("append").parquet(folder)
        done = tiles.run(R.reduced_stream(spark.readStream.schema(R.CHUNK_SQL).parquet(folder), REDUCERS, 0.5), "r", folder)
        counts.append(done.count())
    assert counts == [0, 0, 5 * len(REDUCERS)]
    same(tiles.complete(rows, done).collect(), x)


@pytest.mark.parametrize(("cut", "what"), [(lambda r: r[:1] + r[2:], "was due"), (lambda r: r[:-1], "is left after"), (lambda r: [*r, r[-1]], "was due"), (lambda r: [(*r[0][:3], 2, *r[0][4:]), *r[1:]], "of 2"), (lambda r: [(*r[0][:5], r[0][5][1:]), *r[1:]], "values for")])
def test_refuses(spark, cut, what):
    rows = cut(chunk_rows(series(n_tiles=1), [4, 9]))
    with pytest.raises(Exception, match=what):
        R.reduced(spark.createDataFrame(rows, R.CHUNK_SQL), REDUCERS).collect()


def test_reducers_need_names(spark):
    for bad in ([], [R.Average("a"), R.Average("a")]):
        with pytest.raises(ValueError):
            R.reduced(spark.createDataFrame([], R.CHUNK_SQL), bad)


def test_chunks_of_series(spark):
    x = series(2, 4, 3, 10)
    rows = [(k, c, t, float(x[k, t, 0, c]), float(x[k, t, 1, c])) for k in range(4) for t in range(10) for c in range(3) if not np.isnan(x[k, t]).all()]
    got = R.chunked(spark.createDataFrame(rows, "tile long, slot int, t int, a double, b double"), 3, 4, ["a", "b"]).collect()
    assert sorted((r.tile, r.start, r.times) for r in got) == [(k, s, n) for k in range(4) for s, n in ((0, 4), (4, 4), (8, 2))]
    for r in got:
        assert np.allclose(np.array(r["values"]).reshape(r.times, 2, 3), x[r.tile, r.start : r.start + r.times], equal_nan=True)


# the tile store


def files(spark, tmp_path, n=6, profiles=4, samples=10):
    """Tile files on disk, read back by Spark; their angles."""
    rng, angles = np.random.default_rng(5), {}
    root = tmp_path / "flat"
    root.mkdir()
    for i in range(n):
        a = np.cumsum(rng.normal(0, 0.3, (profiles, samples)), 1)
        kind = "compressed" if i % 2 else "raw"
        angles[i * 128] = a
        data = S.encoded(a, kind)
        (root / f"horizon_{i * 128:05d}_00256_020.{'cbin' if i % 2 else 'bin'}").write_bytes(data + (b"\0" * 28 if i == 2 else b""))
    (root / "horizon_00000_00256_020.txt").write_bytes(b"x")
    (root / "other_00000_00256_020.bin").write_bytes(b"x")
    return S.listed(spark, str(root)), angles


def counts(df):
    return {r.state: r.files for r in df.collect()}


def test_migration_twice(spark, tmp_path):
    found, angles = files(spark, tmp_path)
    root = f"{tmp_path}/store"
    assert counts(S.migrate(found, root)) == {"moved": 6, "skipped": 0, "invalid": 2, "conflicted": 0}
    assert counts(S.migrate(found, root)) == {"moved": 0, "skipped": 6, "invalid": 2, "conflicted": 0}
    assert counts(S.migrate(found.withColumn("length", F.col("length") + 1), root)) == {"moved": 0, "skipped": 0, "invalid": 2, "conflicted": 6}
    rows = S.profiles(S.store(spark, root), 4, 10).collect()
    assert len(rows) == 24 and all(r.problem is None for r in rows)
    for r in rows:
        assert r.angles == pytest.approx(angles[r.y][r.profile], abs=1e-3)


def test_write_replaces_only_its_tiles(spark, tmp_path):
    root = f"{tmp_path}/store"
    tile = lambda y, x, v: (y, x, 20, [float(v)] * 6)
    frame = lambda rows: S.payloads(spark.createDataFrame(rows, "y int, x int, elevation int, angles array<double>"), "raw", 2, 3)
    S.write(frame([tile(0, 0, 1), tile(0, 128, 2), tile(128, 0, 3)]), root)
    S.write(frame([tile(0, 0, 9)]), root)
    got = {(r.y, r.x): r.angles[0] for r in S.profiles(S.store(spark, root), 2, 3).collect()}
    assert got == {(0, 0): 9.0, (0, 128): 2.0, (128, 0): 3.0}


@pytest.mark.parametrize(("kind", "change", "what"), [
    ("raw", lambda b: b[:-1], "are due"), ("raw", lambda b: b + b"\0" * 4, "are due"), ("compressed", lambda b: b[:-1], "ends within"), ("compressed", lambda b: b + b"\1", "left behind"),
    ("compressed", lambda b: b"\0\0" + b[2:], "has 0 bytes"), ("compressed", lambda b: b[:1], "before the length"), ("compressed", lambda b: (3).to_bytes(2, "little") + b[2:5] + b[2:], "angles where"),
])
def test_payload_checks(spark, kind, change, what):
    good = S.encoded(np.linspace(-3, 3, 12).reshape(2, 6), kind)
    rows = [(0, 0, 20, kind, bytearray(good)), (0, 128, 20, kind, bytearray(change(good))), (0, 256, 20, kind, None)]
    got = S.profiles(spark.createDataFrame(rows, "y int, x int, elevation int, kind string, payload binary"), 2, 6).collect()
    assert [r.x for r in got if r.problem is None] == [0, 0]
    assert what in next(r.problem for r in got if r.x == 128)
    assert next(r for r in got if r.x == 256).problem


def test_empty_store(spark, tmp_path):
    assert S.store(spark, f"{tmp_path}/nothing").count() == 0
