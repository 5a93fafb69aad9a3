"""Audit of how the sources of a language diverge in the terms that they use.

1. One CountVectorizer a language, with minDF and the largest vocabSize there is, so that no term
   is cut; its model turns documents into exact sparse vectors of counts. The vocabulary
   of one language at a time (its terms of at least `least` documents) passes through the driver, as that
   class works; documents never do. The terms are written once, by language.
2. Vectors are summed by (language, source): indices and values are exploded and added, by
   map-side aggregates first, so that no group's vector is ever dense or in one task.
3. A group gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), by exact decimals.
4. Pairs of sources are evaluated on sparse blocks: `BLOCK` terms of a language by two tiles of
   `TILE` sources. A term that neither source of a pair has is worth the same for all such terms: those that a block's
   tiles do not hold are only counted. Sums are of whole numbers under 2^63. A pair is evaluated once and read both ways.

Defined cases: null text, language and source are ''; a text of any length is counted whole; repeated rows
count each; equal values go by the item's bytes; groups without terms occur, with values 0 if their
language keeps no term; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.sources.tables import shared_dir

#: ASCII letters are lowered, all other ASCII characters part terms.
PLAIN = bytes(b | 32 if chr(b).isalpha() else 32 if b < 128 else b for b in range(128)) + bytes(range(128, 256))
LEAST, MOST_TERMS, FIRST = 10, 2**31 - 1, 10
#: Stands in every document, so that no vocabulary is empty; no term holds it.
EVERY = "\x00"
BLOCK, TILE = 2048, 64


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, terms and at: a batch's texts are lowered and parted in one pass over their bytes, which keeps their places."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        offsets, data = text.buffers()[1:]
        spaced = pa.LargeStringArray.from_buffers(len(text), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(PLAIN)), None, 0, text.offset)
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        yield pa.RecordBatch.from_arrays([batch.column("source"), split, batch.column("at")], names=["source", "terms", "at"])


def _by_language(rows: DataFrame, langs: list[str]) -> list[DataFrame]:
    """source and terms of each language, from tables written once."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/gridloom-terms-{uuid.uuid4().hex}"
    number = spark.createDataFrame(list(enumerate(langs)), "at int, lang string")
    split = rows.join(F.broadcast(number), "lang").select("text", "source", "at").mapInArrow(_terms, "source string, terms array<string>, at int")
    split.withColumn("terms", F.array_remove("terms", "")).write.partitionBy("at").parquet(path)
    return [spark.read.schema("source string, terms array<string>").parquet(f"{path}/at={i}") for i in range(len(langs))]


def group_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, source, i, n) of the kept terms that a group has, and (lang, i, term) of all kept terms. docs: lang, source, text."""
    spark = docs.sparkSession
    langs = [r.lang for r in docs.groupBy("lang").count().where(F.col("count") >= least).orderBy("lang").collect()]  # no other language can keep a term
    counts, kept = [spark.createDataFrame([], "lang string, source string, i int, n long")], [spark.createDataFrame([], "lang string, i int, term string")]
    for lang, rows in zip(langs, _by_language(docs, langs) if langs else [], strict=True):
        every = F.concat("terms", F.array(F.lit(EVERY)))
        model = CountVectorizer(inputCol="all", outputCol="vector", minDF=float(least), vocabSize=MOST_TERMS).fit(rows.select(every.alias("all")))
        vocabulary = model.vocabulary
        kept.append(spark.createDataFrame(pa.table({"lang": [lang] * len(vocabulary), "i": pa.array(range(len(vocabulary)), pa.int32()), "term": vocabulary})).where(F.col("term") != EVERY))
        model.setInputCol("terms")
        vector = F.unwrap_udt("vector")
        cells = model.transform(rows).select("source", F.explode(F.arrays_zip(vector["indices"].alias("i"), vector["values"].alias("n"))).alias("x"))
        counts.append(cells.select(F.lit(lang).alias("lang"), "source", "x.i", F.col("x.n").cast("long").alias("n")).groupBy("lang", "source", "i").agg(F.sum("n").alias("n")))
    return stored(reduce(DataFrame.unionByName, counts), "counts"), stored(reduce(DataFrame.unionByName, kept), "vocabulary")


def share(n: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)) of columns n, total and v; null where the language keeps no term."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(19,0))) div cast(nullif(total + 2 * v, 0) as decimal(19,0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)), of numbers up to 10^9 + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _evaluate(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block's terms of all pairs between two tiles, and the number of terms; rows without i are the tiles' sources."""
    lang, a, b = rows["lang"].iloc[0], int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    cells = rows[rows["i"] >= 0]
    if cells.empty:
        return pd.DataFrame({"lang": [], "s": [], "t": [], "part": [], "met": []})
    of, column = np.unique(cells["i"].to_numpy(), return_inverse=True)
    matrix = {}
    for tile in {a, b}:
        sources = rows[(rows["tile"] == tile) & (rows["i"] < 0)].sort_values("s")
        p = np.repeat(sources["p"].to_numpy(np.int64)[:, None], len(of), 1)
        mine = (cells["tile"] == tile).to_numpy()
        p[np.searchsorted(sources["s"].to_numpy(), cells["s"].to_numpy()[mine]), column[mine]] = cells["p"].to_numpy(np.int64)[mine]
        matrix[tile] = sources["s"].to_numpy(), p
    (names, p), (others, q) = matrix[a], matrix[b]
    out = []
    for k, s in enumerate(names):
        t = others > s if a == b else np.ones(len(others), bool)
        d = (p[k] - q[t]) ** 2 // (p[k] + q[t])
        out.append(pd.DataFrame({"s": s, "t": others[t], "part": d.sum(1)}))
    return pd.concat(out).assign(lang=lang, met=len(of))[["lang", "s", "t", "part", "met"]]


def pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, s, t, value of pairs of sources s < t (numbers). counts: lang, s, i, p; groups: lang, s, p0, v, with v over 0."""
    largest = groups.groupBy("lang").agg(F.max("s").alias("m")).agg(F.max("m")).first()[0]
    tiles = 1 if largest is None else largest // TILE + 1
    of_tile = lambda d: d.withColumn("tile", F.expr(f"cast(s div {TILE} as int)")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"a": F.least("tile", "x"), "b": F.greatest("tile", "x")})
    blocks = F.expr(f"cast((v - 1) div {BLOCK} as int)")
    cells = of_tile(counts.withColumn("block", F.pmod("i", blocks + 1)).select("lang", "s", "i", "p", "block"))
    sources = of_tile(groups.select("lang", "s", F.lit(-1).alias("i"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), blocks)).alias("block")))
    found = cells.unionByName(sources).select("lang", "a", "b", "block", "tile", "s", "i", "p").groupBy("lang", "a", "b", "block").applyInPandas(_evaluate, "lang string, s int, t int, part long, met long")
    sums = found.groupBy("lang", "s", "t").agg(F.sum("part").alias("part"), F.sum("met").alias("met"))
    # pairs of groups without any term of their own are those that no block has met
    one, two = groups.select("lang", "s", F.col("p0").alias("p"), "v"), groups.select("lang", F.col("s").alias("t"), F.col("p0").alias("q"))
    rest = F.coalesce("part", F.lit(0)) + (F.col("v") - F.coalesce("met", F.lit(0))) * distance("p", "q")
    return one.join(two, "lang").where("s < t").join(sums, ["lang", "s", "t"], "left").select("lang", "s", "t", rest.alias("value"))


def audit(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of a group's language, and the `first` terms that the group has above its language."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts, vocabulary = group_counts(docs, least)
    kept = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    names = docs.select("lang", "source").distinct().withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = names.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "v"])
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, share("0L"))), "groups")
    cells = counts.join(groups, ["lang", "source"]).withColumn("p", share("n"))
    whole = counts.groupBy("lang", "i").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    known = whole.join(F.broadcast(of_lang), "lang").select("lang", "i", share("n").alias("q"))
    above = cells.join(known, ["lang", "i"]).where("p > q").select("lang", "source", "i", distance("p", "q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    near = above.withColumn("r", F.rank().over(by_value)).where(F.col("r") <= first).drop("r")
    of_terms = near.join(vocabulary, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    found = pairs(cells.select("lang", "s", "i", "p", "v"), groups.where("v > 0"))
    both = found.select("lang", "s", "t", "value").unionByName(found.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "value"))
    a, b = groups.select("lang", "source", "s", "v"), groups.select("lang", F.col("source").alias("item"), F.col("s").alias("t"))
    of_pairs = a.join(b, "lang").where("s <> t").join(both, ["lang", "s", "t"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = of_pairs.unionByName(of_terms).withColumn("rank", rank)
    return out.where((F.col("part") == "pair") | (F.col("rank") <= first))
