"""Packing against the tokenizers library, text by text, and by the laws that any packing must meet."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm.queries import QUERIES, tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


@given(st.integers(1, 40_000), st.sampled_from([4096, 1000, 64]))
def test_cuts(n, capacity):
    found = packing.cuts(n, capacity)
    assert sum(found) == n and all(0 < x <= capacity for x in found)
    assert len(found) <= n // capacity + 5
    for x in found:
        k = capacity // x
        assert x >= (capacity // k) * (1 - packing.SLACK) and k * x <= capacity


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=8) | st.sampled_from(["Don't", "stop.", "<|endoftext|>", "<|ENDOFTEXT|>.", "Á,", "a,́", "x\x1cy", "12.5", "İİ", "ΟΔΟΣ"]), max_size=12), st.sampled_from(" \n\t"))
def test_ids_of_words_are_the_librarys(parts, space):
    words, tokenizer = both()
    text = space.join(parts)
    assert words.of(text.encode()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def both(kept=[]):  # noqa: B006  one for all examples
    if not kept:
        with open(FILE, encoding="utf-8") as f:
            kept.append((packing.WordIds(f.read()), Tokenizer.from_file(FILE)))
    return kept[0]


def held(rows, docs, plain, capacity=packing.CAPACITY):
    """Checks that rows pack docs (pairs of doc_id and text; ids may repeat); the share that is padding."""
    left = {}
    for doc_id, text in docs:
        left.setdefault(doc_id, []).append(plain(text))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(left)
    for doc_id, texts in left.items():
        want = sorted(x for ids in texts for x in zip(range(len(ids)), ids, [len(ids)] * len(ids), strict=True))
        got = sorted((r["start"] + i, x, r["doc_tokens"]) for r in by_doc[doc_id] for i, x in enumerate(r["ids"]))
        assert got == want
    used = padded = 0
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) > 0
            at += r["length"]
        assert at <= capacity
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else capacity)
    return 1 - used / padded if padded else 0


def test_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    share = held(packing.pack(docs, FILE).collect(), [tuple(r) for r in docs.collect()], plain)
    assert share <= packing.SLACK


def test_edges(spark, plain):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (3, "one two"), (None, "three"), (4, "word " * 9000), (5, "x" * 3000), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA + ", sequence_id int, ids string")
    held(packing.pack(docs, FILE).collect(), rows, plain)
    assert packing.pack(docs.limit(0), FILE).collect() == []


def test_rounds(spark, plain, monkeypatch):
    """Open sequences pass through several rounds."""
    monkeypatch.setattr(packing, "LAST", 2000)
    rng = np.random.default_rng(1)
    rows = [(i, "the word " * int(n)) for i, n in enumerate(rng.integers(1, 90, 300))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(16)
    got = packing.pack(docs, FILE, 256).collect()
    assert held(got, rows, plain, 256) <= 0.03
    assert len({r["sequence_id"] >> 56 for r in got}) >= 3


def test_stretches():
    text = b"ab  cd\n" + b"e" * 30 + b" f"
    assert b"".join(packing.stretches(text, 4)) == text
    assert [p.split() for p in packing.stretches(text, 4)] == [[b"ab", b"cd"], [b"e" * 30], [b"f"]]


def test_query(spark, plain):
    got = QUERIES["op12_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = dict(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    for r in got:
        ids = plain(texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(len(plain(t)) for t in texts.values())
