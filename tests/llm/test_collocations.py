"""Counting quotient filters round trip; phrases against a plain version, by every path."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import collocations
from gridloom.llm.quotient import Keys, Shape

DOCS = "lang string, text string"


@settings(deadline=None, max_examples=100)
@given(st.integers(2, 4), st.integers(1, 31), st.integers(0, 2**31), st.integers(0, 300), st.integers(0, 12))
def test_filters_lose_nothing(order, bits, seed, m, spread):
    rng, shape = np.random.default_rng(seed), Shape(order, bits)
    columns = [rng.integers(0, 1 << bits, m) for _ in range(order)]
    hi, lo = shape.permuted(columns)
    assert all((a == b).all() for a, b in zip(shape.restored(hi, lo), columns, strict=True))
    n = rng.choice([1, 2, 3, 255, 256, 257, 258, 10**12], m)
    want = Counter()
    for *gram, k in zip(*[c.tolist() for c in columns], n.tolist(), strict=True):
        want[tuple(gram)] += k
    spread = min(spread, shape.high)
    keys = shape.counted([Keys(hi[: m // 2], lo[: m // 2], n[: m // 2]), Keys(hi[m // 2 :], lo[m // 2 :], n[m // 2 :])])
    got = Counter()
    for number, blob in shape.filters(keys, spread):
        k = shape.keys(spread, number, blob)
        assert (k.hi >> np.uint64(shape.high - spread) == number).all()
        got.update(dict(zip(zip(*[c.tolist() for c in shape.restored(k.hi, k.lo)], strict=True), k.n.tolist(), strict=True)))
    assert got == want


def test_filters_are_small():
    shape, rng = Shape(3, 20), np.random.default_rng(1)
    keys = shape.counted([Keys(*shape.permuted([rng.integers(1, 1 << 20, 100_000) for _ in range(3)]), np.ones(100_000, np.int64))])
    assert sum(len(x) for _, x in shape.filters(keys, 9)) < 7 * 100_000  # 60 bits and a count in under 7 bytes


def plain(rows, words=3, least=10, within=50, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in candidates.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], a)
        found = []
        for g, a in candidates.items():
            if g in inside and 100 * inside[g] >= within * a:
                continue
            score, k = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)] + ["É", "Don't", "a\x01b"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text + " hot phrase here" * rng.randint(0, 4)))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", " . , "), ("xx", "only here")] + [("en", "same text again")] * 12


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("words", [2, 3, 4])
def test_phrases(spark, words):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", n long, rank int")
    assert got(collocations.phrases(docs, words)) == plain(rows, words)
    assert got(collocations.phrases(docs, words, 3, 80, 5)) == plain(rows, words, 3, 80, 5)


def test_turns_of_merging_and_short_runs(spark, monkeypatch):
    """Filters of few n-grams, ranges merged in several turns, texts of many runs."""
    for name, value in (("HELD", 20), ("RUN", 7), ("SPREAD", 1), ("FAN", 1), ("SALTS", 2)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus()
    assert got(collocations.phrases(spark.createDataFrame(rows, DOCS).repartition(5))) == plain(rows)


def test_dictionary_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(collocations, "RUN", 9)
    rows = corpus()
    assert got(collocations.phrases(spark.createDataFrame(rows, DOCS).repartition(5))) == plain(rows)


def test_weak_sieve(spark, monkeypatch):
    """A sieve that lets everything pass changes nothing."""
    monkeypatch.setattr(collocations, "sieve_of", lambda grams, shape, power: b"\xff" * (1 << power - 3))
    rows = corpus()
    assert got(collocations.phrases(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_nothing(spark):
    assert got(collocations.phrases(spark.createDataFrame([], DOCS))) == []
    assert got(collocations.phrases(spark.createDataFrame([("en", "too rare a phrase")], DOCS))) == []


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**13, 10**14, 95 * 10**12)], "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s")).first()
    assert row.s == 1000000 * (9 * 10**13) ** 2 // (10**14 * 95 * 10**12)


def test_ngrams_are_made_of_few_runs_at_once():
    """A batch of many runs is parted by words, each run whole and once; no batch of runs is larger than 10,000 times RUN words."""
    lists = [[i + 1] * (i % 7) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, collocations.RUNS.field(0).type), pa.array([len(x) for x in lists], pa.int32())], schema=collocations.RUNS)
    parts = list(collocations.portions(batch, 10))
    assert [x for p in parts for x in p.column("ids").to_pylist()] == lists
    assert all(len(p) == 1 or sum(map(len, p.column("ids").to_pylist())) <= 10 for p in parts)
    got = [collocations.ngrams(p, 2)[0][0].tolist() for p in parts]
    assert [x for g in got for x in g] == collocations.ngrams(batch, 2)[0][0].tolist()
    assert list(collocations.portions(batch.slice(0, 0))) == []
    assert 10_000 * (collocations.RUN + 2) * 8 < 64 << 20


def test_only_rarer_words_are_joined(spark, monkeypatch):
    """A dictionary too large to be sent is sent in part: the most frequent words need no join."""
    kept = {}
    monkeypatch.setattr(collocations, "stored", lambda df, name, stored=collocations.stored: kept.setdefault(name, stored(df, name)))
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", 700)
    monkeypatch.setattr(collocations, "RUN", 9)
    rows = corpus()
    assert got(collocations.phrases(spark.createDataFrame(rows, DOCS).repartition(5))) == plain(rows)
    spelt, words = kept["spelt"], sum(r.n for r in kept["words"].collect())
    assert 0 < spelt.agg(F.sum(F.size("unknown"))).first()[0] < words
    assert spelt.where("exists(ids, x -> x > 0)").count() > 0
