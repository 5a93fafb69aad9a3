"""Substring dedup: suffix automata of reference shards give matching statistics of repeated text.

A span of `WINDOW` words that also starts in a document with a smaller id is removed. Three
steps, each a shuffle over narrow rows:

1. Every window's smallest five-word hash (winnowing) is its anchor, so two documents that
   share a window share an anchor. Anchors of one document only are dropped.
2. Around each shared anchor the words of its windows (the context) go to the anchor's
   shard, distinct contexts once with the smallest id that holds them. A shard's contexts are
   the reference: one suffix automaton a shard, its states annotated with the smallest id.
   The contexts are streamed through it, and each window end yields that id. All windows
   with an anchor meet in one shard, so no pair of shards has to be compared, and none of the
   automata has to be sent to every executor.
3. The verdicts return to the documents, windows merge to maximal spans, words are cut.

An anchor with more than `HOT` distinct contexts (a phrase in a footer that very many documents
have) is split by content: its contexts' windows are held one by one, with the same result.

Equal word sequences are one node: of them only the smallest id takes part, the others are
removed whole. Defined cases: null text has no words; a document without id neither removes
nor loses words; ids may be any 64-bit integers; repeated ids are told apart by their words and
don't remove each other; an empty table gives an empty result; texts of any length are read
whole; other columns are carried only by `keep`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import sized_broadcast, stored, whole_rows
from gridloom.llm.words import WordHashes, rolling, rows_of, texts

WINDOW = 13
GRAM = 5
#: Least id of words that no reference holds: no id is greater.
NO_ID = (1 << 63) - 1
#: Distinct contexts a shard holds on average, about 25 MB as an automaton, and those of one anchor from which it is split.
SHARD, HOT = 3_000, 1_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors_of(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The smallest gram hash of every window of words; empty if there is no window."""
    if len(h) < window:
        return h[:0]
    low, have, want = rolling(h, gram), 1, window - gram + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _reader(window: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in rows_of(whole):
                n, key, sha, found = [], [], [], []
                for t in texts(batch):
                    words = t.split() if t else []
                    joined = b" ".join(words)
                    n.append(len(words))
                    key.append(hashlib.md5(joined).digest())
                    sha.append(hashlib.sha256(joined).hexdigest())
                    found.append(np.unique(anchors_of(hashes.of(words), window)).view(np.int64) if len(words) >= window else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(key, pa.binary()), batch.column("th"), pa.array(n, pa.int64()), pa.array(sha), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "tk", "th", "n_words", "sha", "anchors"])

    return read


def _surrounder(window: int):
    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in rows_of(whole):
                ids, ths, shared = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("anchors")
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i, t in enumerate(texts(batch)):
                    words = t.split()
                    h = hashes.of(words)
                    low = anchors_of(h, window)
                    hit = np.isin(low, np.asarray(shared[i].values).view(np.uint64))
                    edge = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (hit[1:] != hit[:-1])]) if len(low) else low
                    for s, e in zip(edge, np.r_[edge[1:], len(low)], strict=True):
                        if hit[s]:
                            ctx = b" ".join(words[s : e + window - 1])
                            out[0].append(low[s].view(np.int64))
                            out[1].append(int.from_bytes(hashlib.md5(ctx).digest()[:8], "little", signed=True))
                            out[2].append(ctx)
                            out[3].append(ids[i])
                            out[4].append(ths[i])
                            out[5].append(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                    names=["anchor", "ck", "ctx", "doc_id", "th", "start"])

    return surround


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; each state knows the smallest id of its places."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NO_ID]

    def _state(self, length: int, link: int, nxt: dict[bytes, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.least.append(NO_ID)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.length[p] + 1, link[q], dict(nxt[q]))
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                new, p = self._state(length[last] + 1, 0, {}), last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = new
            if doc < least[last]:
                least[last] = doc

    def finish(self) -> None:
        """Hand the smallest ids down the suffix links."""
        link, least = self.link, self.least
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[v]
            if least[v] < least[p]:
                least[p] = least[v]

    def least_ids(self, words: list[bytes], window: int) -> list[int]:
        """For every window of words, the smallest id at which the automaton holds it; NO_ID if it doesn't."""
        nxt, link, length = self.next, self.link, self.length
        v, n, out = 0, 0, []
        for j, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v, n = nxt[v][w], n + 1
            while length[link[v]] >= window:
                v = link[v]
                n = length[v]
            if j >= window - 1:
                out.append(self.least[v] if n >= window else NO_ID)
        return out


def _matcher(window: int):
    def match(shard: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        words = [c.split() for c in shard["ctx"]]
        for w, doc in zip(words, shard["low"], strict=True):
            automaton.add(w, doc)
        automaton.finish()
        return pd.DataFrame({"anchor": shard["anchor"], "ck": shard["ck"], "least": [automaton.least_ids(w, window) for w in words]})

    return match


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_of(whole):
                gone_at, n_removed, sha, kept = batch.column("at"), [], [], []
                for i, t in enumerate(texts(batch)):
                    spans = [m.span() for m in WORD.finditer(t)]
                    gone = np.zeros(len(spans) + window, bool)
                    at = np.unique(np.asarray(gone_at[i].values))
                    for j in range(window):
                        gone[at + j] = True
                    gone = gone[: len(spans)]
                    n_removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(b" ".join(t[a:b] for (a, b), g in zip(spans, gone, strict=True) if not g)).hexdigest())
                    stop = [a for a, _ in spans[1:]] + [len(t)]
                    kept.append(t[: spans[0][0]] + b"".join(t[a:b] for (a, _), b, g in zip(spans, stop, gone, strict=True) if not g))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "th", "n_removed", "kept_sha256", "kept_text"])

    return cut


def removals(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows read: doc_id, tk, th, n_words, sha; word sequences held by several rows: tk, rep;
    documents that lose spans: doc_id, th, n_removed, kept_sha256, kept_text). th is xxhash64 of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    read = stored(docs.mapInArrow(_reader(window), "doc_id long, tk binary, th long, n_words long, sha string, anchors array<long>"), "read")
    several = stored(read.where("n_words > 0 and doc_id is not null").groupBy("tk").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("tk", "rep"), "several")
    n_several = several.count()
    one = read.where("anchors is not null and doc_id is not null").join(sized_broadcast(several, n_several), "tk", "left").where("rep is null or rep = doc_id")
    held = one.select("doc_id", "th", F.explode("anchors").alias("anchor"))
    shared = held.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    cand = stored(held.join(stored(shared, "shared"), "anchor").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("anchors")), "cand")
    ids = cand.select("doc_id").distinct()
    some = docs.where("text is not null").join(sized_broadcast(ids, cand.count()), "doc_id", "left_semi")
    ctx = stored(some.join(cand.groupBy("doc_id").agg(F.flatten(F.collect_list("anchors")).alias("anchors")), "doc_id").mapInArrow(_surrounder(window), "anchor long, ck long, ctx binary, doc_id long, th long, start int"), "contexts")
    lone = stored(ctx.groupBy("anchor", "ck", "ctx").agg(F.min("doc_id").alias("low")), "lone")
    hot = stored(lone.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
    n_hot = hot.count()
    cold = lone.join(sized_broadcast(hot, n_hot), "anchor", "left_anti")
    shards = max(1, lone.count() // SHARD)
    least = cold.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(_matcher(window), "anchor long, ck long, least array<long>")
    hit = ctx.select("anchor", "ck", "doc_id", "th", "start").join(least, ["anchor", "ck"])
    starts = F.transform(F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), i)), lambda i: i.isNotNull()), lambda i: i + F.col("start"))
    hit = hit.select("doc_id", "th", starts.alias("at")).where(F.size("at") > 0)
    if n_hot:
        hit = hit.union(_of_hot_anchors(ctx.join(sized_broadcast(hot, n_hot), "anchor", "left_semi"), window))
    at = stored(hit.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("at")).alias("at")), "spans")
    return read, several, _cut(docs, at, at.count(), window)


def _of_hot_anchors(ctx: DataFrame, window: int) -> DataFrame:
    """doc_id, th and at, the starts of windows that smaller ids hold, among the contexts of anchors that too many share.

    Such contexts are split by content: each of their windows is a reference of its own, held
    by its smallest id, so what meets in a task is one row a distinct window.
    """
    w = F.split(F.col("ctx").cast("string"), " ", -1)
    wins = F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.struct((F.col("start") + i).alias("at"), F.md5(F.array_join(F.slice("w", i + 1, window), " ").cast("binary")).alias("win")))
    rows = ctx.withColumn("w", w).select("doc_id", "th", F.explode(wins).alias("x")).select("doc_id", "th", "x.*")
    first = rows.groupBy("win").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    return rows.join(first, "win").where("low < doc_id").groupBy("doc_id", "th").agg(F.collect_list("at").alias("at"))


def _cut(docs: DataFrame, at: DataFrame, n: int, window: int) -> DataFrame:
    some = docs.where("text is not null").join(sized_broadcast(at.select("doc_id").distinct(), n), "doc_id", "left_semi")
    return some.join(at, ["doc_id", "th"]).mapInArrow(_cutter(window), "doc_id long, th long, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(["doc_id", "th"])


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256."""
    read, several, cut = removals(docs, window)
    out = read.drop("anchors").join(sized_broadcast(several, several.count()), "tk", "left").join(cut.drop("kept_text"), ["doc_id", "th"], "left")
    copy = (F.col("rep") < F.col("doc_id")) & (F.col("n_words") >= window)
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def keep(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without their repeated spans; rows of which no word is left go.

    Columns stay as they are, but for text and, if there is one, n_chars.
    """
    read, several, cut = removals(docs, window)
    cut = stored(cut.select("doc_id", "th", "n_removed", "kept_text"), "cut")
    copies = read.where(F.col("n_words") >= window).join(sized_broadcast(several, several.count()), "tk").where("rep < doc_id")
    spent = cut.join(read.select("doc_id", "th", "n_words").distinct(), ["doc_id", "th"]).where("n_removed = n_words")
    other = stored(cut.select("doc_id", "th").union(copies.select("doc_id", "th")).union(spent.select("doc_id", "th")).distinct(), "changed")
    n = other.count()
    rows = whole_rows(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    same = rows.join(sized_broadcast(other, n), ["doc_id", "th"], "left_anti").select("_row.*")
    left = cut.join(spent.select("doc_id", "th"), ["doc_id", "th"], "left_anti")
    less = rows.join(sized_broadcast(left.select("doc_id", "th"), n), ["doc_id", "th"], "left_semi").join(left, ["doc_id", "th"])
    row = F.col("_row").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(less.select(row.alias("_row")).select("_row.*"))
