"""Phrase collocations by counting quotient filters.

1. Words are counted a task at a time and then by language; those that are frequent enough to be part
   of a candidate get ids, one number a (language, word), so that an n-gram of ids also tells its language.
2. Texts become runs of ids, with 0 where a piece ends or a word is rare. The dictionary
   is sent to the tasks up to `BROADCAST_BYTES`; beyond, that much of it, its most frequent words. Only the other words
   are joined with the rest of it by a shuffle, and their ids put into the runs. Runs have
   at most `RUN` starting words, and the words after them that their last n-grams reach.
3. For each order, tasks collect permuted n-grams up to `HELD` of them, count them, and give one counting
   quotient filter (`quotient`) a range. Filters of a range meet in one task and are merged by
   sorted keys. Ranges are so many that none should hold over HELD n-grams; where
   that needs more than `FAN` times the ranges that a task deals out, merging takes several turns, each
   splitting a range in FAN. However often an n-gram occurs, a task sends it once a filter.
4. An n-gram of order 3 is only counted where both of its pairs may be frequent: the occupied
   quotients of all frequent pairs, at most 2^`SIEVE` bits, are sent to the tasks. This sieve errs on the safe side only.
5. Candidates meet the counts of their parts by joins; scores are exact decimals; the first phrases of a
   language are taken in `SALTS` parts, and then among the parts' first.

Defined cases: null text has no words, null lang is `und`; a text of any length is counted whole; repeated
rows count each; ties in score go by count, then by the phrase's bytes; an empty table gives an empty
result; other columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_BYTES, stored
from gridloom.llm.quotient import Keys, Shape
from gridloom.llm.words import rows_of, texts

WORDS, LEAST, WITHIN, MOST = 3, 10, 50, 2000
#: Bytes that end a piece become this one, which no UTF-8 text holds.
BREAK = b"\xff"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" ")
#: Starting words of a run; words or n-grams that a task holds before it counts them out; the frequent words of an id bucket.
RUN, HELD, BUCKET = 1 << 9, 1 << 19, 50_000
#: Words of runs whose n-grams are made at once: Arrow's batches have many runs, and making n-grams takes some ten arrays of their words.
AT_ONCE = 1 << 17
#: Bits of the range of a task's filters, and those that each further turn of merging adds.
SPREAD, FAN = 9, 6
#: The most bits, as a power of two, of the sieve of frequent (n - 1)-grams.
SIEVE = 26
SALTS = 64


def words_of(text: bytes | None) -> list[bytes]:
    """Words and, between pieces, BREAK."""
    return (text or b"").translate(PLAIN).replace(BREAK, b" \xff ").split()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of what the task has read, in parts of about HELD distinct words."""
    held: dict[str, Counter] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(BREAK, None)
            found = list(counts.items())
            for i in range(0, len(found), 50_000):
                some = found[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([w.decode(errors="replace") for w, _ in some]), pa.array([n for _, n in some], pa.int64())], names=["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for part in rows_of(batch):
            for lang, text in zip(part.column("lang").to_pylist(), texts(part), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > HELD:
                yield from given()
    yield from given()


def counted_words(docs: DataFrame) -> DataFrame:
    """lang, word, n of docs (lang, text)."""
    return docs.mapInArrow(_counter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame, count: int) -> DataFrame:
    """words with w1, ids from 1, close together: buckets count on their own, each in steps of the number of buckets."""
    buckets = max(16, count // BUCKET)
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return words.withColumn("bucket", bucket).select("lang", "word", "n", ((at - 1) * buckets + F.col("bucket") + 1).cast("long").alias("w1"))


RUNS = pa.schema([("ids", pa.list_(pa.int64())), ("starts", pa.int32())])


def _runs(ids: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, int]]:
    for i in range(0, len(ids), RUN):
        yield ids[i : i + RUN + words - 1], min(RUN, len(ids) - i)


def _sent(sent) -> dict[str, dict[bytes, int]]:
    """The dictionary that a task holds, from Arrow's bytes of (lang, word, w1)."""
    known: dict[str, dict[bytes, int]] = {}
    for b in pa.ipc.open_stream(sent.value):
        for lang, w, i in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            known.setdefault(lang, {})[w] = i
    return known


def _sender(sent, words: int):
    """Runs by a dictionary that the task holds."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _sent(sent)
        for batch in batches:
            for part in rows_of(batch):
                out = []
                for lang, text in zip(part.column("lang").to_pylist(), texts(part), strict=True):
                    of, w = known.get(lang, {}).get, words_of(text)
                    out.extend(_runs(np.fromiter((of(x, 0) for x in w), np.int64, len(w)), words))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], RUNS.field(0).type), pa.array([n for _, n in out], pa.int32())], schema=RUNS)

    return found


OPEN_SQL = "rid long, run int, ids array<long>, starts int, lang string, places array<int>, unknown array<string>"


def _opener(sent, words: int):
    """Runs by the dictionary's most frequent words; the others with their places."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _sent(sent)
        for batch in batches:
            for part in rows_of(batch):
                out = []
                for rid, lang, text in zip(part.column("rid").to_pylist(), part.column("lang").to_pylist(), texts(part), strict=True):
                    of, w = known.get(lang, {}).get, words_of(text)
                    for run, (ids, starts) in enumerate(_runs(np.fromiter((of(x, 0) for x in w), np.int64, len(w)), words)):
                        places = [i for i in np.flatnonzero(ids == 0).tolist() if w[run * RUN + i] != BREAK]
                        out.append((rid, run, ids, starts, lang, places, [w[run * RUN + i].decode(errors="replace") for i in places]))
                if out:
                    kinds = (pa.int64(), pa.int32(), RUNS.field(0).type, pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["rid", "run", "ids", "starts", "lang", "places", "unknown"])

    return found


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with the ids of their other words put in."""
    for batch in batches:
        for part in portions(batch):
            lists, more = part.column("ids"), part.column("x")
            first = np.repeat(np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy(), pa.compute.fill_null(more.value_lengths(), 0).to_numpy(zero_copy_only=False))
            ids, x = lists.flatten().to_numpy().copy(), more.flatten()
            ids[first + x.field("place").to_numpy()] = x.field("w1").to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), part.column("starts")], schema=RUNS)


def _broadcast(spark, dictionary: DataFrame):
    known = dictionary.select("lang", "word", "w1").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _size() -> Column:
    return F.octet_length("word") + F.octet_length("lang") + 16


def runs(docs: DataFrame, dictionary: DataFrame, size: int, words: int) -> DataFrame:
    """ids and starts of the runs of docs (lang, text)."""
    spark = docs.sparkSession
    if size <= BROADCAST_BYTES:
        return docs.mapInArrow(_sender(_broadcast(spark, dictionary), words), "ids array<long>, starts int")
    level = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for r in dictionary.groupBy(level.alias("level")).agg(F.sum(_size()).alias("size")).orderBy(F.desc("level")).collect():  # at most 8 * 63 rows
        held += r.size
        if held > BROADCAST_BYTES:
            break
        least = r.level
    often = F.lit(False) if least is None else level >= least
    spelt = docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_opener(_broadcast(spark, dictionary.where(often)), words), OPEN_SQL)
    spelt = stored(spelt, "spelt")  # rows keep their numbers
    rest = spelt.select("rid", "run", "lang", F.explode(F.arrays_zip("places", F.col("unknown").alias("word"))).alias("x")).select("rid", "run", F.col("x.places").alias("place"), "lang", "x.word")
    met = rest.join(dictionary.where(~often).select("lang", "word", "w1"), ["lang", "word"])
    found = met.groupBy("rid", "run").agg(F.collect_list(F.struct("place", "w1")).alias("x"))
    return spelt.select("rid", "run", "ids", "starts").join(found, ["rid", "run"], "left").select("ids", "starts", "x").mapInArrow(_filled, "ids array<long>, starts int")


def ngrams(batch: pa.RecordBatch, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the ids of all n-grams that start in a batch of runs, and their places in the batch's ids."""
    lists = batch.column("ids")
    ids, size, starts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), batch.column("starts").to_numpy()
    first = np.cumsum(size) - size
    place = np.arange(len(ids)) - np.repeat(first, size)
    ok = (place < np.repeat(starts, size)) & (place + order <= np.repeat(size, size))
    at = np.flatnonzero(ok)
    columns = [ids[at + i] for i in range(order)]
    full = reduce(np.logical_and, [c > 0 for c in columns])
    return [c[full] for c in columns], at[full]


def portions(batch: pa.RecordBatch, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of runs that have about `most` words; a longer run stands alone."""
    ends = np.cumsum(batch.column("ids").value_lengths().to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


FILTER = pa.schema([("range", pa.int64()), ("filter", pa.binary())])
FILTER_SQL = "range long, filter binary"


def _filters(shape: Shape, parts: list[Keys], spread: int) -> Iterator[pa.RecordBatch]:
    found = list(shape.filters(shape.counted(parts), spread))
    for i in range(0, len(found), 256):
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found[i : i + 256]], FILTER.field(j).type) for j in (0, 1)], schema=FILTER)


def sieve_slots(shape: Shape, columns: list[np.ndarray], power: int) -> np.ndarray:
    """The quotients that stand for n-grams in a sieve of 2^power bits."""
    hi, lo = shape.permuted(columns)
    return ((hi * np.uint64(0x9E3779B97F4A7C15) ^ lo * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - power)).astype(np.int64)


def _collector(shape: Shape, spread: int, below: Shape | None, sieve, power: int):
    """Filters of the n-grams of runs."""

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)
        for portion in (x for batch in batches for x in portions(batch)):
            columns, _ = ngrams(portion, shape.order)
            if bits is not None:
                keep = np.ones(len(columns[0]), bool)
                for some in (columns[:-1], columns[1:]):
                    slot = sieve_slots(below, some, power)
                    keep &= (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
                columns = [c[keep] for c in columns]
            hi, lo = shape.permuted(columns)
            parts.append(Keys(hi, lo, np.ones(len(hi), np.int64)))
            held += len(hi)
            if held > 2 * HELD:
                parts = [shape.counted(parts)]
                held = len(parts[0].hi)
                if held > HELD:
                    yield from _filters(shape, parts, spread)
                    parts, held = [], 0
        if held:
            yield from _filters(shape, parts, spread)

    return collected


def _merger(shape: Shape, spread: int, to: int):
    """Filters of ranges of `to` bits from those of `spread` bits that come by range; parts over HELD are given as they are."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_range(batches, shape, spread, HELD):
            yield from _filters(shape, parts, to)

    return merged


def _by_range(batches: Iterator[pa.RecordBatch], shape: Shape, spread: int, most: float) -> Iterator[tuple[int, list[Keys]]]:
    """(range, sorted counts) of filters that come by range; a range comes in several parts if it has over `most` keys."""
    now, parts, held = None, [], 0
    for batch in batches:
        for number, filter_ in zip(batch.column("range").to_pylist(), batch.column("filter").to_pylist(), strict=True):
            if number != now and parts:
                yield now, [shape.counted(parts)]
                parts, held = [], 0
            now = number
            parts.append(shape.keys(spread, number, filter_))
            held += len(parts[-1].hi)
            if held > 2 * HELD:
                parts = [shape.counted(parts)]
                held = len(parts[0].hi)
                if held > most:
                    yield now, parts
                    parts, held = [], 0
    if parts:
        yield now, [shape.counted(parts)]


def _frequent(shape: Shape, spread: int, least: int):
    """The n-grams of at least `least` counts, from filters that come by range."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys,) in _by_range(batches, shape, spread, float("inf")):
            keep = keys.n >= least
            if keep.any():
                columns = shape.restored(keys.hi[keep], keys.lo[keep])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, keys.n[keep]]], names=[*(f"w{i + 1}" for i in range(shape.order)), "f"])

    return found


def frequent(found: DataFrame, shape: Shape, total: int, least: int, below: Shape | None = None, sieve=None, power: int = 0) -> DataFrame:
    """w1, w2, ... and f of the n-grams of runs that occur at least `least` times; total: no fewer than their occurrences."""
    need = min(shape.high, max(SPREAD, (total // HELD).bit_length()))
    spread = min(shape.high, SPREAD)
    filters = found.mapInArrow(_collector(shape, spread, below, sieve, power), FILTER_SQL)
    while spread < need:
        to = min(need, spread + FAN)
        filters = stored(_together(filters).mapInArrow(_merger(shape, spread, to), FILTER_SQL), "filters")
        spread = to
    columns = ", ".join(f"w{i + 1} long" for i in range(shape.order))
    return stored(_together(filters).mapInArrow(_frequent(shape, spread, least), f"{columns}, f long"), f"grams{shape.order}")


def _together(filters: DataFrame) -> DataFrame:
    return filters.repartition("range").sortWithinPartitions("range")


def sieve_of(grams: DataFrame, shape: Shape, power: int) -> bytes:
    """A bit for each quotient of 2^power that a gram has."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(sieve_slots(shape, [batch.column(i).to_numpy() for i in range(shape.order)], power))
            byte, first = np.unique(slot >> 5, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(np.bitwise_or.reduceat(np.int64(1) << (slot & 31), first) if len(slot) else slot)], names=["at", "bits"])

    words = grams.drop("f").mapInArrow(slots, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2^(SIEVE - 5) rows
    out = np.zeros(1 << max(power - 5, 0), "<u4")
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def _names(first: int, last: int) -> list[str]:
    return [f"w{i}" for i in range(first, last + 1)]


def part_counts(grams: DataFrame, first: int, last: int, name: str) -> DataFrame:
    """Counts of part w_first to w_last of longer phrases, to be joined on these columns."""
    return grams.select(*[F.col(f"w{i - first + 1}").alias(f"w{i}") for i in range(first, last + 1)], F.col("f").alias(name))


def dropped_in(longer: DataFrame, order: int, within: int) -> DataFrame:
    """w1, w2, ... and top, the highest count of a phrase one longer that holds them."""
    whole = F.col("f").alias("top")
    front, back = longer.select(*_names(1, order), whole), longer.select(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, order + 1)], whole)
    return front.unionByName(back).groupBy(*_names(1, order)).agg(F.max("top").alias("top"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)); decimals of 38 digits hold the products."""
    x, y, z = (f"cast({c} as decimal(15,0))" for c in (a, left, right))
    return F.expr(f"(1000000 * {x} * {x}) div ({y} * {z})")


def scored(grams: dict[int, DataFrame], order: int, within: int) -> DataFrame:
    """w1, w2, ..., a, l, r, score of the candidates of one order that no longer one drops."""
    out = grams[order].withColumnRenamed("f", "a")
    if order + 1 in grams:
        out = out.join(dropped_in(grams[order + 1], order, within), _names(1, order), "left").where(F.expr(f"top is null or 100 * top < {within} * a")).drop("top")
    for k in range(1, order):
        out = out.join(part_counts(grams[k], 1, k, f"l{k}"), _names(1, k)).join(part_counts(grams[order - k], k + 1, order, f"r{k}"), _names(k + 1, order))
    best = F.array_min(F.array(*[F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, order)]))
    return out.withColumn("best", best).select(*_names(1, order), "a", "best.l", "best.r", "best.score")


def phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, within: int = WITHIN, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of 2 to `words` words."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = stored(counted_words(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= least)
    size, count, total = often.agg(F.coalesce(F.sum(_size()), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    dictionary = stored(numbered(often, count), "dictionary")
    bits = max(1, int(dictionary.agg(F.coalesce(F.max("w1"), F.lit(0))).first()[0]).bit_length())
    found = stored(runs(docs, dictionary, size, words), "runs")
    grams, shape, sieve, power = {1: dictionary.select("w1", F.col("n").alias("f"))}, None, None, 0
    for order in range(2, words + 1):
        above = Shape(order, bits)
        grams[order] = frequent(found, above, total, least, shape, sieve, power)
        if order < words:
            shape, power = above, min(SIEVE, max(16, (16 * grams[order].count()).bit_length()))
            sieve = spark.sparkContext.broadcast(sieve_of(grams[order], shape, power))
    spelt = dictionary.select("lang", "word", "w1")
    parts = []
    for order in range(2, words + 1):
        out = scored(grams, order, within).join(spelt.withColumnRenamed("word", "x1"), "w1")
        for i in range(2, order + 1):
            out = out.join(spelt.select(F.col("w1").alias(f"w{i}"), F.col("word").alias(f"x{i}")), f"w{i}")
        parts.append(out.select("lang", F.concat_ws(" ", *[f"x{i}" for i in range(1, order + 1)]).alias("phrase"), "a", "l", "r", "score"))
    return ranked(reduce(DataFrame.unionByName, parts), most).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each language with their rank; parts of a language are cut first, so that no task gets all of one."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("salt")
