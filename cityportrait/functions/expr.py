"""Scalar column expressions: coercion, codes, bins, draws, vectors. No Python runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Bin edges of age and income (fixed values).
AGE_EDGES = [0.0, 5.0, 18.0, 25.0, 35.0, 45.0, 55.0, 65.0, 75.0, 85.0, 1000.0]
INCOME_EDGES = [0.0, 10000.0, 25000.0, 50000.0, 75000.0, 100000.0, 150000.0, 250000.0, 10000000.0]
NO_BIN = "nan"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Numeric value; what can't be read is null."""
    return col(c).try_cast("double")


def non_negative(c: str | Column) -> Column:
    """Weights and values: unreadable, null and NaN count as 0, and 0 is the least."""
    return F.greatest(F.coalesce(F.nanvl(number(c), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def clipped(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to a domain; null stays null."""
    v = number(c)
    out = v
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(v.isNotNull(), out)


def area_code(c: str | Column) -> Column:
    """Trimmed integer text without leading zeros; empty or unreadable codes are null."""
    return F.trim(col(c).cast("string")).try_cast("double").cast("bigint").cast("string")


def zero_filled(c: str | Column, width: int) -> Column:
    """Pad with zeros on the left; longer values are kept whole."""
    s = col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def geoid(state: str, county: str, tract: str) -> Column:
    return F.concat(zero_filled(state, 2), zero_filled(county, 3), zero_filled(tract, 6))


def bin_labels(edges: Sequence[float]) -> list[str]:
    """Left-closed interval labels, written by Python so that large edges read the same everywhere."""
    if len(edges) < 2:
        raise ValueError("at least two edges are needed")
    return [f"[{a}, {b})" for a, b in zip(edges, edges[1:], strict=False)]


def binned(c: str | Column, edges: Sequence[float]) -> Column:
    """Label of the left-closed bin; values outside the edges and nulls have none."""
    labels = bin_labels(edges)
    v = number(c)
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= v))
    inside = (v >= edges[0]) & (v < edges[-1])
    return F.when(inside, F.element_at(F.array(*map(F.lit, labels)), at))


def employment_16p(age: str | Column, esr: str | Column) -> Column:
    """Employment class of persons of 16 and over; null below and without an age."""
    e = F.trim(col(esr).cast("string"))
    return F.when(
        number(age) >= 16,
        F.when(e.isin("1", "2"), "employed").when(e == "3", "unemployed").when(e.isin("4", "5"), "armed_forces").otherwise("not_in_labor_force"),
    )


def child_labour(age: str | Column, esr: str | Column) -> Column:
    """The hard rule: under 16 and in the labour force."""
    return F.coalesce((number(age) < 16) & F.trim(col(esr).cast("string")).isin("1", "2", "3"), F.lit(False))


def hash_uniform(seed: int, *keys: str | Column, digits: int = 13) -> Column:
    """A draw in [0, 1) from a seed and keys: the same on any partitioning and in any engine with md5.

    13 hex digits are 52 bits, as many as a double in [1, 2) has: enough for any number of items to be drawn from.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("double") / float(16**digits)


def floors(height: str | Column, per_floor: float = 3.0) -> Column:
    h = number(height)
    return F.when(h.isNotNull(), F.greatest(h / per_floor, F.lit(1.0)))


def price_per_sqft(value: str | Column, area_m2: str | Column) -> Column:
    """Value by area in square feet; null for an area of 0."""
    sqft = number(area_m2) * 10.763910416709722
    return F.try_divide(number(value), F.when(sqft != 0, sqft))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax_of(values: Column, names: Column) -> Column:
    """Name of the largest value; the first of equals."""
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def one_hot(c: Column, categories: Column) -> Column:
    """1 in the place of the category; a null is an error."""
    return F.when(c.isNull(), F.raise_error(F.lit("a category is null"))).otherwise(F.transform(categories, lambda x: F.when(x == c, 1.0).otherwise(0.0)))


def nearest_tier(tiers: Column, wanted: Column) -> Column:
    """The available tier closest to the wanted one; of two equally close ones the lower."""
    return F.array_min(F.transform(tiers, lambda t: F.struct(F.abs(t - wanted).alias("d"), t.alias("t"))))["t"]


def finite(c: str | Column) -> Column:
    v = number(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
