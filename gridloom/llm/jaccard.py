"""N-gram Jaccard join: MinHash bands propose pairs, full five-word shingle sets decide them.

Bands and rows are chosen from the similarity and a target recall. Equal texts are one
node. In a band's bucket every member is first held against the smallest one; the links
found are joined to components, and the members of buckets in which several components
still meet are held against each other, but for the pairs that prefix filtering on their
rarest shingles, the set sizes or parity bits prove dissimilar. So large groups of near copies cost a
comparison a member, and no pair that the bands propose stays undecided.

Links are counted after that: two linked texts are in one component, so the texts of each
component are held against each other in blocks, by products of 0/1 matrices that give the
sizes of all the intersections of two blocks. Only counts leave a block pair.

Defined cases: null or blank text has no shingles and links to nothing, its class is its
own id; a text under five words is one shingle, a text of any length counts whole; rows that
repeat a doc_id count as one document; a row without doc_id takes the class of its text if
another row has that text; pairs at exactly the similarity are linked; an empty table gives an
empty result. Other columns are carried only by `keep`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import sized_broadcast, stored
from gridloom.operators.components import components
from gridloom.llm.words import WordHashes, mixed, rows_of, shingles, texts

WORDS = 5
SIMILAR = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Words of 64 bits in which a shingle set's parities are kept.
PARITY = 16
#: Texts and shingles of a component that a block holds on average; columns of a block that are multiplied at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 500, 500_000, 2048
#: Shingles of small components that are counted in one task's group.
PACK_SHINGLES = 1_000_000
#: Pieces in which the partners of one text are verified at most; holders of one shingle that meet in one task.
PIECES, HOLDERS = 256, 2000


def bands_and_rows(similar: float = SIMILAR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The longest rows a band (fewest chance pairs) whose recall at `similar` needs at most `most` hashes."""
    found = (math.ceil(math.log(1 - recall) / math.log(1 - similar)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))
        if bands * rows <= most:
            found = (bands, rows)
    return found


def _signer(k: int, bands: int, rows: int):
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in rows_of(whole):
                raw = texts(batch)
                sets = [shingles(hashes.of(t.split()), k) if t else np.zeros(0, np.uint64) for t in raw]
                counts = np.array([len(s) for s in sets])
                full = np.flatnonzero(counts)
                key = [hashlib.md5(t).digest() if n else None for t, n in zip(raw, counts, strict=True)]
                lists: list = [None] * len(raw)
                sizes = [len(np.unique(s)) for s in sets]
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
                    starts = np.r_[0, np.cumsum(counts[full])[:-1]]
                    low = np.empty((bands * rows, len(full)), np.uint32)
                    for i in range(bands * rows):
                        low[i] = np.minimum.reduceat(x * a[i] + b[i], starts)
                    h = np.repeat(salt[:, None], len(full), 1)
                    for r in range(rows):
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + low[r::rows])
                    for j, i in enumerate(full):
                        lists[i] = h[:, j].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(key, pa.binary()), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "tk", "n", "bands"])

    return sign


def _verifier(k: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (a, piece), the text of a before those of its partners."""
        hashes, now, leads = WordHashes(), None, []
        for whole in batches:
            for batch in rows_of(whole):
                out: tuple[list, ...] = ([], [], [])
                for a, piece, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "piece", "b")), texts(batch), strict=True):
                    x = np.unique(shingles(hashes.of(t.split()), k))
                    if (a, piece) != now:
                        now, leads = (a, piece), []
                    if b is None:
                        leads.append(x)
                        continue
                    both = [len(np.intersect1d(x, y, assume_unique=True)) for y in leads]
                    out[0].append(a)
                    out[1].append(b)
                    out[2].append(max((n / max(1, len(x) + len(y) - n) for n, y in zip(both, leads, strict=True)), default=0.0))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "jaccard"])

    return verify


def _verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) with the Jaccard similarity of their full shingle sets.

    Texts travel only for documents in pairs. The partners of a are dealt in at most PIECES
    pieces, for each of which the text of a travels once; a piece is streamed, not gathered.
    """
    pairs = stored(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PIECES)).cast("int").alias("piece")), "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(sized_broadcast(ids, ids.count()), "doc_id", "left_semi")
    leads = pairs.select("a", "piece").distinct().join(some.withColumnRenamed("doc_id", "a"), "a").select("a", "piece", F.lit(None).cast("long").alias("b"), "text")
    rows = leads.union(pairs.join(some.withColumnRenamed("doc_id", "b"), "b").select("a", "piece", "b", "text"))
    rows = rows.repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())
    return stored(rows.mapInArrow(_verifier(k), "a long, b long, jaccard double"), "verified").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def _lister(k: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in rows_of(whole):
                raw = texts(batch)
                sets = [np.unique(shingles(hashes.of(t.split()), k)) for t in raw]
                parity = np.zeros((len(sets), PARITY), np.uint64)
                for i, x in enumerate(sets):
                    np.bitwise_xor.at(parity[i], (x >> np.uint64(6)) % np.uint64(PARITY), np.uint64(1) << (x & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), batch.column("comp"), pa.array([hashlib.md5(t).digest() for t in raw], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(list(parity.view(np.int64)), pa.list_(pa.int64()))],
                    names=["rep", "comp", "tk", "n", "grams", "parity"])

    return listed


def _prefix_pairs(nodes: DataFrame, docs: DataFrame, similar: float, k: int) -> DataFrame:
    """Pairs of nodes (rep, comp) of different components that may be similar; exact, it rules out only pairs that cannot be.

    Two sets of sizes n and m need o = similar / (1 + similar) x (n + m) shingles in common, so,
    in one order for all, they share one of the rarest n - o + 1 and m - o + 1 of each; and
    they differ in at most n + m - 2 o shingles, of which the bits in which their parities of
    shingles by hash differ are a lower bound. Both are conditions of the join.
    """
    some = docs.where("text is not null").select(F.col("doc_id").alias("rep"), "text").join(sized_broadcast(nodes, nodes.count()), "rep")
    sets = stored(some.mapInArrow(_lister(k), "rep long, comp long, tk binary, n int, grams array<long>, parity array<long>"), "sets")
    grams = sets.select("rep", "comp", "tk", "n", F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    ranked = grams.join(common, "gram").groupBy("rep", "comp", "tk", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram", (F.col("x") < F.col("y")).alias("met")))).alias("g"))
    length = F.size("g") - F.ceil(F.size("g") * F.lit(similar) - 1e-9).cast("int") + 1
    rare = ranked.select("rep", "comp", "tk", "n", F.posexplode(F.slice("g", F.lit(1), length)).alias("at", "g")).where("g.met")
    bits = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)]
    rare = stored(rare.select("rep", "comp", "tk", "n", "at", "g.gram").join(sets.select("rep", "tk", *bits), ["rep", "tk"]), "rare")
    # a gram with many holders is met in several tasks: its holders are dealt by hash on one side and repeated on the other
    hot = rare.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / HOLDERS).cast("int").alias("salts")).where("salts > 1")
    hot = stored(hot, "hot")
    rare = rare.join(sized_broadcast(hot, hot.count()), "gram", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    p = rare.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).alias("p")
    q = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("q")
    both = F.col("p.n") + F.col("q.n")
    need = both * (similar / (1 + similar)) - 1e-6
    apart = sum((F.bit_count(F.col(f"p.p{i}").bitwiseXOR(F.col(f"q.p{i}"))) for i in range(1, PARITY)), F.bit_count(F.col("p.p0").bitwiseXOR(F.col("q.p0"))))
    near = (F.col("p.gram") == F.col("q.gram")) & (F.col("p.salt") == F.col("q.salt")) & (F.col("p.comp") != F.col("q.comp")) & (F.col("p.rep") < F.col("q.rep"))
    near = near & (F.col("p.n") - F.col("p.at") >= need) & (F.col("q.n") - F.col("q.at") >= need) & (apart <= both - 2 * need)
    return p.join(q, near).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct()


def links(docs: DataFrame, similar: float = SIMILAR, k: int = WORDS, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, text representatives (tk, rep), decided pairs (a, b, jaccard >= similar) and their components)."""
    bands, rows = bands_and_rows(similar, recall)
    signed = stored(docs.select("doc_id", "text").mapInArrow(_signer(k, bands, rows), "doc_id long, tk binary, n int, bands array<long>"), "signed")
    reps = stored(signed.where("tk is not null and doc_id is not null").groupBy("tk").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "reps")
    rows_ = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    first = rows_.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(rows_.join(first, "bucket").select("bucket", "lead", "rep", "n"), "buckets")
    tried = _verified(met.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), docs, k)
    edges = tried.where(F.col("jaccard") >= similar)
    comp = stored(components(edges), "comp")
    # buckets in which several components meet: their other pairs
    held = met.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed_ = held.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y and size > 2").select("bucket")
    left = stored(held.join(mixed_, "bucket").select("rep", "comp").distinct(), "left")
    more = _prefix_pairs(left, docs, similar, k).join(tried, ["a", "b"], "left_anti")
    rest = _verified(more, docs, k).where(F.col("jaccard") >= similar)
    edges = stored(edges.union(rest), "links")
    return signed, reps, edges


def _similar(left: list[np.ndarray], right: list[np.ndarray], similar: float) -> np.ndarray:
    """Which sets of left and right (sorted hashes) have a Jaccard similarity of at least similar, as a matrix."""
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    at, row = [np.searchsorted(both, x) for x in (a, b)], [np.repeat(np.arange(len(k)), k) for k in (n, m)]
    hit = [np.isin(x, both) for x in (a, b)]
    common = np.zeros((len(n), len(m)), np.float64)
    for c in range(0, len(both), COLUMNS):
        part = []
        for x, r, h, k in zip(at, row, hit, (len(n), len(m)), strict=True):
            some = h & (x >= c) & (x < c + COLUMNS)
            dense = np.zeros((k, min(COLUMNS, len(both) - c)), np.float32)
            dense[r[some], x[some] - c] = 1
            part.append(dense)
        common += part[0] @ part[1].T
    return common / np.maximum(1, n[:, None] + m[None, :] - common) >= similar


def _counter(similar: float, k: int):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, out = WordHashes(), []
        for _, some in rows.groupby("comp"):
            reps, block = some["rep"].to_numpy(), some["block"].to_numpy()
            sets = [np.unique(shingles(hashes.of(bytes(t).split()), k)) for t in some["text"]]
            low, high = np.flatnonzero(block == some["x"].iloc[0]), np.flatnonzero(block == some["y"].iloc[0])
            if not len(low) or not len(high):
                continue
            near = _similar([sets[i] for i in low], [sets[i] for i in high], similar)
            out.append(pd.DataFrame({"rep": reps[low], "n_links": near.sum(1)}))
            if some["x"].iloc[0] == some["y"].iloc[0]:
                out[-1]["n_links"] -= 1  # itself
            else:
                out.append(pd.DataFrame({"rep": reps[high], "n_links": near.sum(0)}))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({"rep": [], "n_links": []}, dtype="int64")

    return count


def degrees(nodes: DataFrame, docs: DataFrame, similar: float = SIMILAR, k: int = WORDS) -> DataFrame:
    """rep and n_links, the number of similar texts in its component, of nodes (rep, comp, n).

    A component of more than a block is dealt in blocks by hash, each pair of which is a group
    of its own; smaller components share groups.
    """
    size = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_s"))
    blocks = F.ceil(F.greatest(F.col("_k") / BLOCK, F.col("_s") / BLOCK_SHINGLES)).cast("int")
    size = stored(size.select("comp", blocks.alias("blocks"), F.col("_s").alias("s")), "sizes")
    total = size.where("blocks = 1").agg(F.sum("s")).first()[0] or 0
    dealt = nodes.join(size, "comp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("pack", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(total // PACK_SHINGLES + 1))).otherwise(F.col("comp")))
    dealt = stored(dealt.select("rep", "comp", "block", "blocks", "pack"), "dealt")
    some = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    some = some.join(sized_broadcast(dealt, dealt.count()), "rep").dropDuplicates(["rep"])
    pairs = some.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("rep", "comp", "block", "pack", (F.col("blocks") > 1).alias("big"), F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "text")
    counted = pairs.groupBy("big", "pack", "x", "y").applyInPandas(_counter(similar, k), "rep long, n_links long")
    return counted.groupBy("rep").agg(F.sum("n_links").alias("n_links"))


def classes(docs: DataFrame, similar: float = SIMILAR, k: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row a document: doc_id, class_id (smallest id of its component) and n_links.

    n_links is the number of other texts to which its text is similar; copies of a text share it.
    """
    signed, reps, edges = links(docs, similar, k, recall)
    comp = stored(components(edges).withColumnRenamed("node", "rep"), "comp")
    degree = degrees(reps.select("rep", "n").join(comp, "rep"), docs, similar, k)
    named = reps.select("tk", "rep").join(comp.join(degree, "rep"), "rep", "left")
    key = F.coalesce("tk", F.unhex(F.hex(F.xxhash64("doc_id"))))  # texts without words have no class to meet: they are spread
    out = signed.select("doc_id", key.alias("tk")).join(named, "tk", "left")
    return out.select("doc_id", F.coalesce("comp", "rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs but those whose class has a smaller doc_id."""
    signed, reps, edges = links(docs)
    named = reps.select("tk", "rep").join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").select("tk", F.coalesce("comp", "rep").alias("class_id"))
    gone = stored(signed.select("doc_id", "tk").join(named, "tk").where("class_id < doc_id").select("doc_id").distinct(), "gone")
    return docs.join(sized_broadcast(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
