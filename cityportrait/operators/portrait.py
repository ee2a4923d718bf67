"""Building portraits and distribution summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityportrait.operators import ranks

#: Building tables up to this many rows are sent to all tasks.
MAX_BROADCAST_BUILDINGS = 500_000


def portrait(persons: DataFrame, building: str = "bldg_id", age: str = "AGEP", income: str = "PINCP") -> DataFrame:
    """Size, mean, median and 90th percentile of age and income of each building; persons without one are left out."""
    d = persons.filter(F.col(building).isNotNull())
    half = F.array(F.lit(0.5), F.lit(0.9))
    d = d.groupBy(building).agg(
        F.count("*").alias("pop_count"),
        F.avg(age).alias("age_mean"), F.percentile(age, half).alias("_a"),
        F.avg(income).alias("income_mean"), F.percentile(income, half).alias("_i"),
    )
    return d.select(building, "pop_count", "age_mean", F.col("_a")[0].alias("age_p50"), F.col("_a")[1].alias("age_p90"), "income_mean", F.col("_i")[0].alias("income_p50"), F.col("_i")[1].alias("income_p90"))


def with_attributes(portraits: DataFrame, buildings: DataFrame, building: str = "bldg_id") -> DataFrame:
    """Building columns behind the portrait's."""
    more = buildings.select(*[c for c in buildings.columns if c == building or c not in portraits.columns])
    # the portraits may be many more rows, pairs of an overlay for one: then they are not moved
    few = more.limit(MAX_BROADCAST_BUILDINGS + 1).count() <= MAX_BROADCAST_BUILDINGS
    return portraits.join(F.broadcast(more) if few else more, building, "left")


def distribution(df: DataFrame, value: str, key: str) -> DataFrame:
    """One row: n, mean, p10, p50, p90 of a column that may be of any size; nulls are left out."""
    d = df.select(F.lit("all").alias("_g"), F.col(value).cast("double").alias("_v"), key).filter(F.col("_v").isNotNull())
    q = ranks.quantiles(d, ["_g"], "_v", key, [0.1, 0.5, 0.9])
    m = d.groupBy("_g").agg(F.avg("_v").alias("mean"))
    return q.join(m, "_g").select("n", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def tier_summary(portraits: DataFrame, tier: str = "price_tier", value: str = "income_p50", key: str = "bldg_id") -> DataFrame:
    """(tier, n, median, mean) of tiers above 0; a tier may hold most of the rows."""
    d = portraits.filter(F.col(tier) > 0).select(tier, F.col(value).cast("double").alias("_v"), key)
    q = ranks.quantiles(d, [tier], "_v", key, [0.5]).select(F.col(tier).alias("_t"), F.col("q")[0].alias("median"))
    s = d.groupBy(tier).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    return s.join(q, F.col(tier) == F.col("_t"), "left").select(tier, "n", "median", "mean")


def plot_range(df: DataFrame, value: str, key: str) -> DataFrame:
    """lo, hi: 2nd and 98th percentile, the extremes where these coincide."""
    d = df.select(F.lit("all").alias("_g"), F.col(value).cast("double").alias("_v"), key).filter(F.col("_v").isNotNull())
    q = ranks.quantiles(d, ["_g"], "_v", key, [0.0, 0.02, 0.98, 1.0])
    ok = F.col("q")[1] < F.col("q")[2]
    return q.select(F.when(ok, F.col("q")[1]).otherwise(F.col("q")[0]).alias("lo"), F.when(ok, F.col("q")[2]).otherwise(F.col("q")[3]).alias("hi"))


def bounding_box(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """(bin, n): equal widths between the extremes, the last bin closed; empty bins are left out."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (float(hi) - float(lo)) / bins or 1.0
    b = F.least(F.floor((F.col(value) - float(lo)) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Quartiles, and whiskers at the outermost points within 1.5 interquartile ranges, per group."""
    q = ranks.quantiles(df, [group], value, key, [0.25, 0.5, 0.75]).select(F.col(group).alias("_g"), "q")
    d = df.join(F.broadcast(q) if q.limit(100_001).count() <= 100_000 else q, F.col(group) == F.col("_g"))
    q1, q3 = F.col("q")[0], F.col("q")[2]
    inside = (F.col(value) >= q1 - 1.5 * (q3 - q1)) & (F.col(value) <= q3 + 1.5 * (q3 - q1))
    return d.groupBy(group).agg(
        F.first(q1).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(q3).alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
    )


def top_by(df: DataFrame, n: int, value: str, key: str) -> DataFrame:
    """The n rows of largest value (0: all rows)."""
    return df.orderBy(F.desc(value), key).limit(n) if n > 0 else df
