"""Colour maps on columns: normalising, tone, continuous, discrete and cyclic stops, contours."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Stop = tuple[float, tuple[float, float, float, float]]


def stops(given: Sequence[Stop]) -> list[Stop]:
    """Stops clamped to 0..1 and sorted, with the outer colours carried to 0 and 1."""
    s = sorted((min(1.0, max(0.0, v)), c) for v, c in given)
    return [(0.0, s[0][1])] * (s[0][0] > 0) + s + [(1.0, s[-1][1])] * (s[-1][0] < 1)


def normalised(v: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.when(v.isNotNull(), F.lit(0.0))
    return F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def cyclic(v: Column, low: float, period: float) -> Column:
    return F.pmod(v - low, F.lit(period)) / period


def toned(v: Column, contrast: float, brightness: float) -> Column:
    return F.least(F.greatest((v - 0.5) * contrast + 0.5 + brightness, F.lit(0.0)), F.lit(1.0))


def continuous(v: Column, given: Sequence[Stop], channel: int) -> Column:
    """A channel's value at v, linear between stops."""
    s = stops(given)
    out = F.lit(float(s[-1][1][channel]))
    for (a, ca), (b, cb) in reversed(list(zip(s, s[1:], strict=False))):
        if b > a:
            out = F.when(v <= b, ca[channel] + (v - a) / (b - a) * (cb[channel] - ca[channel])).otherwise(out)
    return F.when(v.isNotNull(), out)


def discrete(v: Column, given: Sequence[Stop], channel: int) -> Column:
    """A channel's value of the last stop at or below v, the first stop's below all."""
    s = sorted(given)
    out = F.lit(float(s[0][1][channel]))
    for a, c in s:
        out = F.when(v >= a, float(c[channel])).otherwise(out)
    return F.when(v.isNotNull(), out)


def contour(v: Column, interval: float, width: float) -> Column:
    """Is v within half a width of a multiple of interval?"""
    r = F.pmod(v, F.lit(interval))
    return F.coalesce(F.least(r, interval - r) <= max(1e-6, width / 2), F.lit(False))


def default_colormap(stem: Column, rules: Sequence[tuple[str, str]], known: Sequence[str], default: str = "gray") -> Column:
    """The colour map of the first rule whose pattern is found in the file's stem; rules of unknown maps or with broken patterns are left out."""
    valid = []
    for pattern, name in rules:
        with contextlib.suppress(re.error):
            re.compile(pattern)
            valid += [(pattern, name)] if name in known else []
    return F.coalesce(*[F.when(stem.rlike(p), n) for p, n in valid], F.lit(default if default in known else "gray"))
