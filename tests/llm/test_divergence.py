"""The audit against a plain version, on corpora with many sources, rare languages and nulls."""

import random
import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import divergence

DOCS = "text string, lang string, source string"


def plain(rows, least=10, first=10):
    docs = [((t or "").translate({c: c + 32 for c in range(65, 91)}), la or "", s or "") for t, la, s in rows]
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), la, s) for t, la, s in docs]
    often, n = defaultdict(Counter), defaultdict(Counter)
    for w, la, _ in found:
        often[la].update(set(w))
    kept = {la: sorted(t for t, k in c.items() if k >= least) for la, c in often.items()}
    for w, la, s in found:
        n[la, s].update(t for t in w if t in set(kept[la]))
    out = []
    for la, terms in kept.items():
        v = len(terms)

        def shares(count, v=v, terms=terms):
            return {t: 1 + 10**9 * (count[t] + 2) // (sum(count.values()) + 2 * v) for t in terms}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(c) for (x, s), c in n.items() if x == la}
        q = shares(sum((c for (x, _), c in n.items() if x == la), Counter()))
        for s in p:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in terms), o.encode(), o) for o in p if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in terms if n[la, s][t] and p[s][t] > q[t]]
            out += [(la, s, "pair", item, -x, i + 1) for i, (x, _, item) in enumerate(sorted(pair))]
            out += [(la, s, "term", item, -x, i + 1) for i, (x, _, item) in enumerate(sorted(term)[:first])]
    return sorted(out)


def corpus(n=150, sources=7, seed=3):
    rng = random.Random(seed)
    vocab = [f"{chr(97 + i)}word" for i in range(20)] + ["É", "straße", "Mixed", "x'y", "it1s", "a_b"]
    text = lambda: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=rng.randint(0, 25)))
    rows = [(text(), rng.choice(["en", "fr", None]), rng.choice([f"s{i}" for i in range(sources)] + [None])) for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", "en", "empty too"), ("12 - 3", "en", "s0"), (None, "xx", "alone"), ("few", "yy", "a"), ("few", "yy", "b"), ("", "", "")] + [("again again", "fr", "copies")] * 12


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", value int, part string")
    assert got(divergence.audit(docs)) == plain(rows)
    assert got(divergence.audit(docs, 3, 4)) == plain(rows, 3, 4)


def test_tiles_and_blocks(spark, monkeypatch):
    """Many sources and terms over several tiles and blocks."""
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK", 4)
    rows = corpus(200, 11)
    assert got(divergence.audit(spark.createDataFrame(rows, DOCS), 5)) == plain(rows, 5)


@pytest.mark.parametrize("rows", [[], [("one text", "en", "a")], [(None, None, None), (None, None, "b")]])
def test_no_terms(spark, rows):
    assert got(divergence.audit(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_only_blank_documents(spark):
    """A language of enough documents, none with a term."""
    rows = [(" . ", "en", "a")] * 15 + [("", "en", "b")]
    assert got(divergence.audit(spark.createDataFrame(rows, DOCS))) == plain(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_large_counts_are_exact(spark):
    row = spark.createDataFrame([(9 * 10**15, 10**16, 5)], "n long, total long, v long").select(divergence.share("n").alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 10)
