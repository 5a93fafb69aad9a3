"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is `WINDOW` consecutive words of a benchmark item (a shorter item is one window).
The smallest of a window's `GRAM`-word hashes is its fingerprint, for documents and items
alike, so a shared window always shares a fingerprint. Documents' distinct fingerprints meet
those of the benchmark; only in documents that share one are the windows at the shared
fingerprints spelled out and matched as text, which extends every hit and drops chance ones.

All texts are read, split and hashed once; only those that share a fingerprint are read again.
Items of fewer than WINDOW words have each their own length: a fingerprint for such a length
is the hash of the whole run. The benchmark side is broadcast while its counted rows and bytes
are few and is shuffled otherwise.

Defined cases: null text and text without words has no words, and is not contaminated; an empty
benchmark or documents table gives no hits or no rows; equal items are both listed; texts of any
length are read whole; null item ids take part in hits but are not listed; rows are told apart
by doc_id and the hash of their text, so repeated rows have equal results; other columns are
carried only by `keep`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import byte_sized_broadcast, sized_broadcast, stored, text_of, whole_rows

WINDOW = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(text_of(text), UPPER, LOWER), GAP, -1), "")


def _hashes(w: Column, k: int) -> Column:
    """Hash of every run of k words of the array column w."""
    run = lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), run)).otherwise(F.array().cast("array<bigint>"))


def _lowest(h: Column, n: int) -> Column:
    """Smallest of every n consecutive hashes."""
    low = lambda i: F.least(*[F.get(h, i + j) for j in range(n)])
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), low)).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with words `_w`) plus `_f<length>`: the fingerprint of each of its windows of that length."""
    for n in lengths:
        k = min(GRAM, n) if n == WINDOW else n
        df = df.withColumn(f"_h{n}", _hashes(F.col("_w"), k))
        df = df.withColumn(f"_f{n}", _lowest(F.col(f"_h{n}"), n - k + 1) if n > k else F.col(f"_h{n}"))
    return df


def _windows(n: int, where: Column | None = None) -> Column:
    """(length, start, text, fingerprint) of the windows of n words, of those that `where` lets through."""
    at = F.sequence(F.lit(0), F.size("_w") - n)
    if where is not None:
        at = F.filter(at, lambda i: F.array_contains(where, F.get(F.col(f"_f{n}"), i)))
    one = lambda i: F.struct(F.lit(n).alias("len"), i.alias("start"), F.concat_ws(" ", *[F.get(F.col("_w"), i + j) for j in range(n)]).alias("win"), F.get(F.col(f"_f{n}"), i).alias("fp"))
    none = F.array().cast("array<struct<len:int,start:int,win:string,fp:bigint>>")
    return F.when(F.size("_w") >= n, F.transform(at, one)).otherwise(none)


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, th (hash of text), n_words, n_hit, ids (sorted item ids)."""
    bench = items.select(F.col("item_id").cast("string").alias("item"), words().alias("_w")).where(F.size("_w") > 0)
    lengths = sorted({r[0] for r in bench.select(F.least(F.size("_w"), F.lit(WINDOW))).distinct().collect()})  # ten values at most
    bench = _fingerprints(bench, lengths)
    wins = F.flatten(F.array(*[F.when((F.size("_w") == n) | F.lit(n == WINDOW), _windows(n)).otherwise(F.array().cast("array<struct<len:int,start:int,win:string,fp:bigint>>")) for n in lengths])) if lengths else F.array().cast("array<struct<len:int,start:int,win:string,fp:bigint>>")
    spelled = stored(bench.select("item", F.explode(wins).alias("x")).groupBy("x.len", "x.win", "x.fp").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    prints = spelled.select("fp").distinct()
    n_wins, n_bytes = spelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("win") + F.octet_length(F.array_join("items", "    ")) + 32), F.lit(0))).first()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    every = F.array_distinct(F.concat(*[F.array_distinct(f"_f{n}") for n in lengths])) if lengths else F.array().cast("array<bigint>")
    read = stored(_fingerprints(rows.withColumn("_w", words()), lengths).select("doc_id", "th", F.size("_w").cast("long").alias("n_words"), every.alias("fps")), "prints")
    met = read.select("doc_id", "th", F.explode("fps").alias("fp")).join(sized_broadcast(prints, n_wins), "fp")
    met = stored(met.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set("fp").alias("_met")), "met")
    met_bytes = met.agg(F.coalesce(F.sum(8 * F.size("_met") + 48), F.lit(0))).first()[0]
    same = lambda a: F.col(f"{a}doc_id").eqNullSafe(F.col("_d")) & (F.col(f"{a}th") == F.col("_t"))
    some = rows.where("text is not null").join(byte_sized_broadcast(met, met_bytes), same("")).dropDuplicates(["doc_id", "th"])
    some = _fingerprints(some.select("doc_id", "th", "_met", words().alias("_w")), lengths)
    if lengths:
        own = some.select("doc_id", "th", F.explode(F.flatten(F.array(*[_windows(n, F.col("_met")) for n in lengths]))).alias("x")).select("doc_id", "th", "x.*")
    else:
        own = some.select("doc_id", "th", F.lit(0).alias("len"), F.lit(0).alias("start"), F.lit("").alias("win"), F.lit(0).cast("long").alias("fp"))
    found = own.join(byte_sized_broadcast(spelled.drop("fp"), n_bytes), ["len", "win"])
    found = found.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct("start", "len")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    found = found.select("_d", "_t", covered.cast("long").alias("n_hit"), "ids")
    out = read.select("doc_id", "th", "n_words").join(found, same(""), "left")
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return hits(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns."""
    gone = stored(hits(docs, items).where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct(), "leaks")
    rows = whole_rows(docs)
    return rows.join(sized_broadcast(gone, gone.count()), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_anti").select("_row.*")
