"""Scoring of prediction logs: joins by id, ratio metrics, weighted scores, gates, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Share of rows with `whole` that have `part` too; 0.0 without such rows."""
    return F.coalesce(F.try_divide(F.sum((part & whole).cast("double")), F.sum(whole.cast("double"))), F.lit(0.0))


def matched(cases: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Every id with `state`: matched, missing (no prediction) or extra (no case)."""
    a, b = cases.withColumn("_a", F.lit(True)), predictions.withColumn("_b", F.lit(True))
    state = F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), "missing").otherwise("extra")
    return a.join(b, key, "full_outer").withColumn("state", state).drop("_a", "_b")


def weighted(parts: dict[str, float], mandatory: Column) -> Column:
    """Weighted sum of 0/1 columns; 0 where a mandatory check fails."""
    total = sum((F.col(c).cast("double") * w for c, w in parts.items()), F.lit(0.0))
    return F.when(mandatory, total).otherwise(0.0)


def gated(scored: DataFrame, suite: str, threshold: float) -> DataFrame:
    """Mean score a suite; passed if it reaches threshold without a mandatory failure."""
    out = scored.groupBy(suite).agg(F.avg("score").alias("mean"), F.sum((~F.col("mandatory")).cast("int")).alias("failures"), F.count(F.lit(1)).alias("cases"))
    return out.withColumn("passed", (F.col("mean") >= threshold) & (F.col("failures") == 0))


def case_metrics(cases: DataFrame) -> DataFrame:
    """One row of ratios over matched cases: mode, tool, arguments, schema, first try, blocked calls.

    cases: expected_mode, mode, expected_tool, allowed, disallowed, tool, required, given, valid, first_try, expects_block, blocked.
    All but the first and the last count cases whose expected mode is tool_call.
    """
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    call, every = yes(c("expected_mode") == "tool_call"), F.lit(True)
    named = c("expected_tool").isNull() | (c("expected_tool") == "") | yes(c("tool") == c("expected_tool")) | yes(F.array_contains("allowed", c("tool")))
    tool = named & ~yes(F.array_contains("disallowed", c("tool")))
    given = F.size(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.coalesce("given", F.array().cast("array<string>")))) == 0
    return cases.agg(
        ratio(c("mode").eqNullSafe(c("expected_mode")), every).alias("mode"), ratio(tool, call).alias("tool"), ratio(given, call).alias("arguments"), ratio(yes(c("valid")), call).alias("schema"),
        ratio(yes(c("first_try")), call).alias("first_try"), ratio(yes(c("blocked")), yes(c("expects_block"))).alias("blocked"),
    )


def prefilter(turns: DataFrame) -> DataFrame:
    """One row: shares of first turns that are eligible, eligible and right at once, and of failed ones that a second turn repairs.

    turns: base, order, eligible, first_try. First turns of unknown eligibility don't count.
    """
    of = lambda n, name: F.max(F.when(F.col("order") == n, F.coalesce(F.col(name), F.lit(False)) if n == 2 else F.col(name)))
    t = turns.where("order in (1, 2)").groupBy("base").agg(of(1, "eligible").alias("e1"), of(1, "first_try").alias("t1"), of(2, "eligible").alias("e2"), of(2, "first_try").alias("t2"))
    known, right = F.col("e1").isNotNull(), F.coalesce(F.col("e1") & F.coalesce("t1", F.lit(False)), F.lit(False))
    return t.agg(ratio(F.coalesce("e1", F.lit(False)), known).alias("eligible"), ratio(right, known).alias("right_at_once"), ratio(F.coalesce(F.col("e2") & F.col("t2"), F.lit(False)), known & ~right & F.col("e2").isNotNull()).alias("repaired"))
