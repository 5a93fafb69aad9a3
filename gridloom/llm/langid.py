"""Language of whole texts by a linear-chain conditional random field over their words.

Words carry hashed features: prefixes, suffixes, character bigrams and trigrams, and the
lower-cased word itself (the lexicon). Emission weights and label transitions are learned
together by forward-backward on sequences in which spans of several languages follow one
another, as in code-switched text. A document's score for a language is the mean of its
words' posterior probabilities; the language with the highest mean is predicted. `label_spans`
gives the words' own labels as spans.

Training reads at most `TRAIN_SPANS` spans of `SPAN` words a language, drawn by hash from
whole texts of at most about `TRAIN_DOCS` labelled documents a language, themselves drawn by
hash. Everything else covers all words of all documents.

Defined cases: null text or text without a letter is `und` with score 0; with nothing to
learn from, every document is `und`; a row without doc_id is never trained on and not held
out; texts of any length are one sequence of all their words; repeated rows are labelled each;
an empty table gives an empty result; equal means go to the alphabetically first language. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import rows_of

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
SPAN = 24
TRAIN_DOCS = 240
TRAIN_SPANS = 900
EPOCHS = 6
SEED = 7
#: Words whose emissions a worker remembers.
REMEMBERED = 150_000
#: Bytes of texts that are labelled at once: a step of the chain is taken for all of them together, so that its cost is shared.
SLICE = 1 << 22


@functools.lru_cache(maxsize=1 << 16)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of one word's affixes, n-grams and lexicon entry."""
    w = word.lower()
    p = f"<{w}>"
    names = ["p" + w[:1], "p" + w[:2], "p" + w[:3], "s" + w[-1:], "s" + w[-2:], "s" + w[-3:]]
    names += ["g" + p[i : i + 2] for i in range(len(p) - 1)] + ["g" + p[i : i + 3] for i in range(len(p) - 2)]
    return [zlib.crc32(b"w" + w.encode("utf-8", "surrogatepass")) % BUCKETS, *map(_bucket, names)]


def _keys(*points: np.ndarray) -> np.ndarray:
    """One whole number for each tuple of up to three code points; 0 stands for none."""
    key = np.zeros(len(points[0]), np.int64)
    for x in points:
        key = key << 21 | x
    return key


def _buckets_of(kind: str, keys: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram of a kind: every different one is hashed once."""
    coded = pa.array(keys).dictionary_encode()
    name = lambda k: kind + "".join(chr(x) for x in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) if x)
    of = np.fromiter((_bucket(name(k)) for k in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return of[coded.indices.to_numpy()]


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features() of many words end to end, in its order, and their number for each word."""
    ws = [w.lower() for w in words]
    n = np.fromiter(map(len, ws), np.int64, len(ws))
    c = np.frombuffer(("<" + "><".join(ws) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    count = 2 * n + 8
    out, at = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
    first = np.cumsum(n + 2) - n - 1  # of a word's own letters in c
    out[at] = [zlib.crc32(b"w" + w.encode("utf-8", "surrogatepass")) % BUCKETS for w in ws]
    letter = lambda i, some: np.where(some, c[np.where(some, i, 0)], 0)
    for k in (1, 2, 3):
        out[at + k] = _buckets_of("p", _keys(*[letter(first + i, i < n) for i in range(k)]))
        out[at + 3 + k] = _buckets_of("s", _keys(*[letter(first + n - k + i, i >= k - n) for i in range(k)]))
        if k > 1:
            many = n + 3 - k
            i = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            start = np.repeat(first - 1, many) + i
            out[np.repeat(at + (7 if k == 2 else 8 + n), many) + i] = _buckets_of("g", _keys(*[c[start + j] for j in range(k)]))
    return out, count


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities, emission factors and backward values (n, labels) of sequences laid end to end.

    Sequences are taken longest first, so step t works on the leading block of those that
    still have a word t. Probabilities are rescaled at every step.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    e = np.exp(emit - emit.max(1, keepdims=True))
    m, b = np.exp(trans), np.exp(start)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    now = None
    for t, n in enumerate(alive):
        i = first[:n] + t
        now = e[i] * (b if t == 0 else now[:n] @ m)
        now /= now.sum(1, keepdims=True)
        alpha[i] = now
    for t in range(len(alive) - 1, 0, -1):
        i = first[: alive[t]] + t
        now = (e[i] * beta[i]) @ m.T
        beta[i - 1] = now / now.sum(1, keepdims=True)
    return alpha, e, beta


def posteriors(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Word posteriors (n, labels) of sequences laid end to end."""
    alpha, _, beta = forward_backward(emit, trans, start, lengths)
    alpha *= beta
    alpha /= alpha.sum(1, keepdims=True)
    return alpha


def expected(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors and the expected number of each pair of labels that follow one another."""
    alpha, e, beta = forward_backward(emit, trans, start, lengths)
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(lengths) - lengths] = False
    b = np.flatnonzero(inner)
    pair = alpha[b - 1][:, :, None] * np.exp(trans)[None] * (e[b] * beta[b])[:, None, :]
    pairs = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    post = alpha * beta
    return post / post.sum(1, keepdims=True), pairs


class Tagger:
    """The fitted field: emission weights by bucket, transitions and start weights."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray) -> None:
        self.labels, self.weights, self.trans, self.start = labels, weights, trans, start

    def posteriors(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return posteriors(emit, self.trans, self.start, lengths)


def fit(spans: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """Learn from (language, span of words). Sequences join one to three spans of any languages."""
    labels = sorted({lang for lang, _ in spans})
    at = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    known: dict[str, np.ndarray] = {}
    seqs = []
    for lang, text in sorted(spans):
        words = [w for w in WORD.findall(text) if any(map(str.isalpha, w))]
        for w in words:
            if w not in known:
                known[w] = np.array(features(w))
        if words:
            seqs.append((at[lang], words))
    k = len(labels)
    weights, trans, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-2) for x in (weights, trans, start)]
    for _ in range(epochs):
        mix, i, order = [], 0, rng.permutation(len(seqs))
        while i < len(order):
            n = int(rng.integers(1, 4))
            mix.append([seqs[j] for j in order[i : i + n]])
            i += n
        for at_ in range(0, len(mix), 32):
            batch = mix[at_ : at_ + 32]
            words = [w for seq in batch for _, ws in seq for w in ws]
            gold = np.array([y for seq in batch for y, ws in seq for _ in ws])
            lengths = np.array([sum(len(ws) for _, ws in seq) for seq in batch])
            ids = [known[w] for w in words]
            count = np.array([len(x) for x in ids])
            flat, row = np.concatenate(ids), np.repeat(np.arange(len(ids)), count)
            emit = np.add.reduceat(weights[flat], np.cumsum(count) - count)
            post, gt = expected(emit, trans, start, lengths)
            miss = post.copy()
            miss[np.arange(len(gold)), gold] -= 1
            used, inv = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inv, miss[row, y], len(used)) for y in range(k)], 1) + 1e-3 * weights[used]
            sums[0][used] += g * g
            weights[used] -= 0.3 * g / np.sqrt(sums[0][used])
            # transitions: expected less observed pairs
            head = np.zeros(len(gold), bool)
            head[np.cumsum(lengths) - lengths] = True
            b = np.flatnonzero(~head)
            np.add.at(gt, (gold[b - 1], gold[b]), -1)
            gs = miss[head].sum(0)
            for x, gx, s in ((trans, gt, sums[1]), (start, gs, sums[2])):
                s += gx * gx
                x -= 0.1 * gx / np.sqrt(s)
    return Tagger(labels, weights.astype(np.float32), trans, start)


class Emissions(dict):
    """word -> row of emission scores, remembered while there is room; -1 for words without a letter."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.rows, self.new = weights, np.zeros((0, weights.shape[1])), []

    def __missing__(self, word: str) -> int:
        if not (word.isalpha() or any(map(str.isalpha, word))):
            self[word] = -1
            return -1
        self[word] = i = len(self.rows) + len(self.new)
        self.new.append(word)
        return i

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.clear()
            self.rows = self.rows[:0]
        out = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.new:
            flat, count = features_of(self.new)
            self.rows = np.concatenate([self.rows, np.add.reduceat(self.weights[flat], np.cumsum(count) - count)])
            self.new = []
        return out


def _labeller(tagger: Tagger | None):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Emissions(tagger.weights) if tagger else None
        for whole in batches:
            for batch in rows_of(whole, SLICE):
                texts = batch.column("text").to_pylist()
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if tagger:
                    found = [WORD.findall(t) if t else [] for t in texts]
                    ids = seen.of([w for ws in found for w in ws])
                    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])[ids >= 0]
                    ids = ids[ids >= 0]
                    lengths = np.bincount(owner, minlength=len(texts))
                    some = np.flatnonzero(lengths)
                    if len(some):
                        post = tagger.posteriors(seen.rows[ids], lengths[some])
                        mean = np.add.reduceat(post, np.cumsum(lengths[some]) - lengths[some]) / lengths[some][:, None]
                        best = mean.argmax(1)
                        score[some] = np.clip(mean[np.arange(len(some)), best], 0.0, 1.0)
                        for i, y in zip(some, best, strict=True):
                            pred[i] = tagger.labels[y]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return label


def _span_labeller(tagger: Tagger | None):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Emissions(tagger.weights) if tagger else None
        for whole in batches:
            for batch in rows_of(whole, SLICE):
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = [m for m in WORD.finditer(text or "") if any(map(str.isalpha, m[0]))]
                    spans: list[dict] = []
                    if words and tagger:
                        ids = seen.of([m[0] for m in words])
                        post = tagger.posteriors(seen.rows[ids], np.array([len(words)]))
                        best = post.argmax(1)
                        edge = np.r_[0, np.flatnonzero(np.diff(best)) + 1, len(words)]
                        for a, b in itertools.pairwise(edge.tolist()):
                            spans.append({"start": words[a].start(), "stop": words[b - 1].end(), "n_words": b - a, "lang": tagger.labels[best[a]], "score": float(post[a:b, best[a]].mean())})
                    out.append({"doc_id": doc, "spans": spans})
                yield pa.RecordBatch.from_pylist(out, schema=SPANS)

    return label


SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("score", pa.float64())])))])


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def training_spans(docs: DataFrame) -> list[tuple[str, str]]:
    """Bounded labelled sample: documents by hash, then spans of their whole texts by hash."""
    train = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return []
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 40)) / float(1 << 40)
    part = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, TRAIN_DOCS / n))) for x, n in share.items()])
    some = train.where(unit("doc_id", F.lit(1)) < part).select("doc_id", "lang", "text")
    cut = F.regexp_extract_all("text", F.lit(r"(?s)(?:\S+\s*){1,%d}" % SPAN), F.lit(0))
    rows = some.select("doc_id", "lang", F.posexplode(cut).alias("i", "span")).withColumn("u", unit("doc_id", "i"))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.lit(0.0) if not size else F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, TRAIN_SPANS / n))) for x, n in size.items()])
    return [(r["lang"], r["span"]) for r in rows.where(F.col("u") < part).select("lang", "span").collect()]


def train(docs: DataFrame) -> Tagger | None:
    """A field fitted on the sample of docs (doc_id, text, lang); None if there is nothing to learn from."""
    spans = training_spans(docs.select("doc_id", "text", "lang"))
    return fit(spans) if spans else None


def predict(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by the given field or one fitted on the other folds."""
    tagger = tagger or train(docs)
    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_labeller(tagger), "doc_id long, held_out boolean, lang_pred string, score double")


def label_spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id and the spans of words of one language (start and stop in the text, n_words, lang, score) of every row's whole text.

    A word has the label of highest posterior probability; neighbours of equal label are one span.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_span_labeller(tagger), "doc_id long, spans array<struct<start:int,stop:int,n_words:int,lang:string,score:double>>")
