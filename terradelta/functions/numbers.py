"""Distances, ramps, domains and number texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the places where the map's ramps change
CHANGE_STOPS = (0.1, 0.25, 0.45, 0.7)
OPACITY_STOPS = ((0.0, 0.2), (0.25, 0.52), (1.0, 0.82))
PADDING = 0.12


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def rounded_to(c: Column, digits: int) -> Column:
    """Rounded as a double, half away from zero: the scaled value decides, so a tie that the scaling makes or breaks falls as in SQL.

    round(c, digits) takes the decimal text of c instead, which differs for values beside a tie.
    """
    scale = F.lit(float(10**digits))
    return F.round(c * scale) / scale


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two float vectors, in double; NULL if either is NULL or their lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def ramp(c: Column, stops: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear, flat outside the stops."""
    out = F.when(c <= stops[0][0], F.lit(stops[0][1]))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:], strict=False):
        out = out.when(c <= x1, F.lit(y0) + (c - x0) / F.lit(x1 - x0) * F.lit(y1 - y0))
    return out.otherwise(F.when(c.isNotNull(), F.lit(stops[-1][1])))


def ramp_bucket(c: Column, stops: Sequence[float] = CHANGE_STOPS) -> Column:
    """How many stops the value has reached."""
    return sum((F.coalesce((c >= s).cast("int"), F.lit(0)) for s in stops), F.lit(0))


def padded_domain(low: Column, high: Column, padding: float = PADDING) -> tuple[Column, Column]:
    """A chart's domain around its values; the lower end not below 0 if the values are not."""
    span = F.when(high - low != 0, high - low).otherwise(F.greatest(F.abs(high), F.lit(0.1)))
    pad = span * padding
    return F.greatest(F.lit(0.0), low - pad), high + pad


def band(coverage: Column) -> Column:
    """Behaviour by the share of repeated change."""
    return F.when(coverage < 0.1, "mostly_single_period_change").when(coverage < 0.5, "mixed_change").when(coverage.isNotNull(), "repeated_change")


def resolution_text(c: Column) -> Column:
    """Metres with two decimals under one, else one decimal."""
    v = finite(c)
    return F.when(v < 1, F.concat(F.format_string("%.2f", v), F.lit(" m"))).when(v.isNotNull(), F.concat(F.format_string("%.1f", v), F.lit(" m")))


def number_text(c: Column, digits: int = 2) -> Column:
    """At most so many decimals, thousands with commas; a dash for missing and NaN."""
    text = F.format_number(F.round(c.cast("double"), digits), digits)
    text = F.regexp_replace(text, r"\.?0+$", "") if digits else text
    return F.when(F.coalesce(c.cast("double"), F.lit(float("nan"))) != F.lit(float("nan")), F.when(text == "-0", F.lit("0")).otherwise(text)).otherwise("—")


def percent_text(c: Column, digits: int = 0) -> Column:
    return F.when(F.coalesce(c, F.lit(float("nan"))) != F.lit(float("nan")), F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%"))).otherwise("—")
