"""Map algebra on columns: NULL is the canonical nodata, masks are never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0


def scanned(c: Column) -> Column:
    """A value as read: NaN becomes nodata."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Nodata where a computation left NaN or an infinity."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def power(a: Column, b: Column | float) -> Column:
    return finite(F.pow(a, b))


def truth(c: Column) -> Column:
    """Logical value of a number: anything but zero; nodata counts as false."""
    return F.coalesce(c != 0, F.lit(False))


def both(a: Column, b: Column) -> Column:
    return truth(a) & truth(b)


def either(a: Column, b: Column) -> Column:
    return truth(a) | truth(b)


def compare(a: Column, op: str, b: Column) -> Column:
    """One comparison as a mask: false at nodata, except `!=`, which holds there."""
    return F.coalesce({">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[op], F.lit(op == "!="))


def where(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def nodata() -> Column:
    return F.lit(None).cast("double")


def as_mask(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("smallint")


def as_byte(c: Column) -> Column:
    """Round half to even, clip to 0..255; kept in a smallint as Spark's bytes are signed."""
    return F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(255.0)).cast("smallint")


def as_continuous(c: Column, *used: Column) -> Column:
    """The value, or -9999 where it or any used input is nodata."""
    out = finite(c)
    for u in used:
        out = F.when(u.isNotNull(), out)
    return F.coalesce(out, F.lit(NODATA))


def over_threshold(c: Column, threshold: float, missing: float = NODATA) -> Column:
    return F.coalesce((c > threshold) & (c != missing), F.lit(False))


def digest(expression: Column, inputs: Column) -> Column:
    """Twelve hexadecimal digits for an expression and its inputs in any order."""
    return F.substring(F.sha2(F.concat_ws("|", F.trim(F.regexp_replace(expression, r"\s+", " ")), F.array_join(F.array_sort(inputs), ",")), 256), 1, 12)
