"""Price tiers and income tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityportrait.functions import expr
from cityportrait.operators import ranks
from cityportrait.operators.lineage import settled


def income_tier(persons: DataFrame, group: str, income: str, key: str, n_tiers: int, out: str = "desired_tier") -> DataFrame:
    """Mid-rank tier within the group: q = (place + 0.5) / n, tier = ceil(q * n_tiers) within [1, n_tiers]. Null incomes count as 0."""
    d = persons.withColumn("_income", F.coalesce(expr.number(income), F.lit(0.0)))
    r = ranks.ranked(d, [group], "_income", key, "_rank", "_n")
    tier = F.ceil((F.col("_rank") + 0.5) / F.col("_n") * n_tiers)
    return r.select(*persons.columns, F.greatest(F.least(tier, F.lit(n_tiers)), F.lit(1)).cast("int").alias(out))


def quantile_tier(df: DataFrame, group: str | None, value: str, key: str, q: int, out: str = "price_tier") -> DataFrame:
    """Quantile tier within a group (or over all rows), equal edges collapsed; a constant group is ranked instead.

    Edges are rounded to 9 decimals. Rows without a group get tier 1.
    """
    name = group or "_all"
    d = df.withColumn("_v", expr.non_negative(value))
    if not group:
        d = d.withColumn("_all", F.lit("all"))
    known = d.filter(F.col(name).isNotNull())
    r = settled(ranks.placed(known, [name], "_v", key, "_rank", "_n"))
    edges = ranks.quantiles_of(r, [name], "_v", [i / q for i in range(q + 1)], "_rank", "_n")
    edges = edges.select(F.col(name).alias("_g"), F.array_distinct(F.transform("q", lambda x: F.round(x, 9))).alias("_edges"))
    r = ranks.average_places(r, [name], "_v", "_rank", "_avg").withColumn("_pr", (F.col("_avg") + 1) / F.col("_n"))
    r = r.join(edges, F.col(name) == F.col("_g"))
    k = F.size("_edges") - 1
    b = 1 + F.size(F.filter(F.slice("_edges", 2, F.greatest(k, F.lit(1))), lambda e: e < F.round(F.col("_v"), 9)))
    flat = F.rint(F.greatest(F.least(F.col("_pr") * q, F.lit(float(q))), F.lit(1.0)))
    tier = F.when(k <= 0, flat).when(k == q, b).otherwise(F.ceil(b / k * q))
    told = r.select(*df.columns, F.least(tier, F.lit(q)).cast("int").alias(out))
    rest = d.filter(F.col(name).isNull()).select(*df.columns, F.lit(1).alias(out))
    return told.unionByName(rest)
