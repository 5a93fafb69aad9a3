"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic in a text of low quality. One weight
vector serves all of the thresholds: P(grade <= k) = sigmoid(threshold_k - weights . x). A
text's features are its lower-cased words and their first five and six characters, hashed,
of which those associated with toxicity in the sample get a weight; a word counts log(1 + occurrences), and the vector has unit length over the words.

Fitting reads at most about `TRAIN_ROWS` labelled documents, drawn by hash of their id.
Every document is scored over its whole text.

The labels know no severity but toxic and quality, so grade 2 stands for toxic documents of low
quality; grade 0 is given exactly where `toxic` is false.

Defined cases: null, empty or wordless text has no features and gets the grade that the
thresholds alone give; texts of any length count whole; equal scores get equal grades; labels without toxic are not learned from, a null quality counts as
good; repeated labels count each; with fewer than two grades among the labels there is
nothing to tell apart and that grade (0 without labels) is given throughout; repeated rows
are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import rows_of

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18
#: Most labelled rows, and bytes of their texts, that a fit reads; their features are what the driver gathers.
TRAIN_ROWS, TRAIN_BYTES = 4000, 24 << 20
#: Words that a worker remembers.
REMEMBERED = 150_000
GRADES = 3
EPOCHS = 12
#: Chi-square of a feature's presence against toxicity, below which it gets no weight.
ASSOCIATED = 16.0
#: P(grade > 0) from which a document counts as toxic: missing one is worse than a false alarm. Among toxic grades the likeliest is given.
TOXIC_AT = 0.2


def features(word: str) -> list[int]:
    w = word.lower()
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in ("w" + w, "p" + w[:5], "p" + w[:6])]


class Words(dict):
    """word -> number, remembered while there is room."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.n = 0

    def __missing__(self, word: str) -> int:
        self[word] = i = self.n
        self.n += 1
        self.new.append(word)
        return i


def counted(texts: list[str | None], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, weight in the row's unit vector) of the distinct words of each text."""
    found = [WORD.findall(t) if t else [] for t in texts]
    ids = np.fromiter((known[w] for ws in found for w in ws), dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
    key, n = np.unique(row * (known.n + 1) + ids, return_counts=True)
    row, ids, value = key // (known.n + 1), key % (known.n + 1), np.log1p(n)
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    return row, ids, value / norm[row]


class OrdinalModel:
    """Shared weights and increasing thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def grades(self, s: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score."""
        up = _sigmoid(self.thresholds[None] - s[:, None])
        return np.diff(np.c_[np.zeros(len(s)), up, np.ones(len(s))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def associated(grade: np.ndarray, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which features' presence goes with toxicity, or its absence, beyond chance."""
    key = np.unique(np.repeat(np.arange(len(grade)), np.diff(start)) * BUCKETS + ids)
    row, f = key // BUCKETS, key % BUCKETS
    bad = grade > 0
    a, b = np.bincount(f, bad[row], BUCKETS), np.bincount(f, ~bad[row], BUCKETS)
    p, n = bad.sum(), (~bad).sum()
    return (p + n) * (a * (n - b) - b * (p - a)) ** 2 / np.maximum(1.0, (a + b) * (p + n - a - b) * p * n) > ASSOCIATED


def fit(grade: np.ndarray, start: np.ndarray, ids: np.ndarray, values: np.ndarray, grades: int = GRADES, epochs: int = EPOCHS) -> OrdinalModel:
    """AdaGrad on the cumulative-link likelihood; row i has features ids[start[i]:start[i + 1]]."""
    seen = associated(grade, start, ids)
    weights, sums = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    base, gaps = 0.0, np.zeros(grades - 2)
    t_sums = np.full(grades - 1, 1e-3)
    rng = np.random.default_rng(3)
    prior = np.cumsum(np.bincount(grade, minlength=grades)[:-1]) / len(grade)
    cuts = np.log(np.clip(prior, 1e-3, 1 - 1e-3) / (1 - np.clip(prior, 1e-3, 1 - 1e-3)))
    base, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(grade)), max(1, len(grade) // 64)):
            size = start[rows + 1] - start[rows]
            at = np.repeat(start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row, f, v = np.repeat(np.arange(len(rows)), size), ids[at], values[at] * seen[ids[at]]
            s = np.bincount(row, weights[f] * v, len(rows))
            thr = np.r_[-np.inf, base, base + np.cumsum(np.exp(gaps)), np.inf]
            y = grade[rows]
            hi, lo = _sigmoid(thr[y + 1] - s), _sigmoid(thr[y] - s)
            hi[y == grades - 1], lo[y == 0] = 1.0, 0.0
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            gs = d_hi - d_lo  # of -log p by s
            used, inv = np.unique(f, return_inverse=True)
            g = np.bincount(inv, gs[row] * v, len(used)) + 1e-4 * weights[used]
            sums[used] += g * g
            weights[used] -= 0.5 * g / np.sqrt(sums[used])
            gt = np.array([d_lo[y == k + 1].sum() - d_hi[y == k].sum() for k in range(grades - 1)])
            steps = np.r_[gt.sum(), [gt[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades - 1)]]
            t_sums += steps * steps
            steps = 0.1 * steps / np.sqrt(t_sums)
            base -= steps[0]
            gaps -= steps[1:]
    return OrdinalModel((weights * seen).astype(np.float32), np.r_[base, base + np.cumsum(np.exp(gaps))])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in rows_of(whole, 1 << 19):
            known = Words()
            row, ids, value = counted(batch.column("text").to_pylist(), known)
            f = np.array([features(w) for w in known.new], np.int32).reshape(-1, 3)
            ends = pa.array(np.r_[0, np.cumsum(3 * np.bincount(row, minlength=len(batch)))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.ListArray.from_arrays(ends, pa.array(f[ids].ravel(), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(np.repeat(value, 3).astype(np.float32)))],
                names=["grade", "ids", "values"])


def train(docs: DataFrame, graded: DataFrame, rows: int = TRAIN_ROWS, grades: int = GRADES, size: int = TRAIN_BYTES) -> OrdinalModel | int:
    """Fit on graded (doc_id, grade) documents; a lone grade is returned as it is.

    Rows are drawn by hash of their id: the share of them of which about `rows` rows, and
    `size` bytes if their texts are as long as those of docs on average, are read.
    """
    graded = graded.where("doc_id is not null and grade is not null")
    n, mean = graded.count(), docs.agg(F.avg(F.octet_length("text"))).first()[0] or 0.0
    part = min(1.0, rows / n, size / max(1.0, n * mean)) if n else 1.0
    some = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < part * (1 << 40)).select("doc_id", F.col("grade").cast("int").alias("grade"))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(_featurise, "grade int, ids array<int>, values array<float>").toArrow().combine_chunks()
    grade = found["grade"].to_numpy()
    if len(np.unique(grade)) < 2:
        return int(grade[0]) if len(grade) else 0
    lists = found["ids"].combine_chunks()
    values = found["values"].combine_chunks()
    return fit(grade, np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values), np.asarray(values.values), grades)


def _scorer(model: OrdinalModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_word = Words(), np.zeros(0)
        for whole in batches:
            for batch in rows_of(whole, 1 << 19):
                if known.n > REMEMBERED:
                    known, of_word = Words(), np.zeros(0)
                row, ids, value = counted(batch.column("text").to_pylist(), known)
                if known.new:
                    f = np.fromiter((i for w in known.new for i in features(w)), dtype=np.int64).reshape(-1, 3)
                    of_word = np.concatenate([of_word, model.weights[f].sum(1)])
                    known.new = []
                p = model.grades(np.bincount(row, of_word[ids] * value, len(batch)))
                severity, toxic = p @ np.arange(p.shape[1]), 1 - p[:, 0] >= TOXIC_AT
                grade = np.where(toxic, 1 + p[:, 1:].argmax(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(severity), pa.array(grade), pa.array(1 - p[:, 0]), pa.array(toxic)],
                    names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return score


def score(docs: DataFrame, model: OrdinalModel | int) -> DataFrame:
    """doc_id, severity (expected grade), grade, p_toxic and toxic of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if isinstance(model, int):
        sure = F.lit(model > 0)
        return docs.select("doc_id", F.lit(float(model)).alias("severity"), F.lit(model).alias("grade"), sure.cast("double").alias("p_toxic"), sure.alias("toxic"))
    return docs.mapInArrow(_scorer(model), "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def grades(labels: DataFrame) -> DataFrame:
    """Severity grades of labels (doc_id, quality, toxic)."""
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic").isNotNull(), F.when(low, 2).otherwise(1)).alias("grade"))
