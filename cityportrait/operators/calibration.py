"""Soft reweighting to a target marginal, and resampling by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityportrait.functions import expr
from cityportrait.functions.checks import require_columns
from cityportrait.operators import allocation


def reweighted(samples: DataFrame, targets: DataFrame, column: str, *, category: str | None = None, target: str = "target", eps: float = 1e-12, out: str = "weight") -> DataFrame:
    """Add each row's weight: the target share of its category by the sample's share; 0 for an unknown category.

    The targets' category column is `category`, else the one named like the samples' column.
    """
    require_columns(samples, [column], "samples")
    name = category or ("category" if "category" in targets.columns else column)
    require_columns(targets, [name, target], "targets")
    t = targets.groupBy(F.col(name).cast("string").alias("_c")).agg(F.sum(expr.non_negative(target)).alias("_t"))
    total = t.agg(F.sum("_t")).first()[0]
    if not total or total <= 0:
        raise ValueError("targets add up to nothing")
    n = samples.groupBy(F.col(column).cast("string").alias("_c")).agg(F.count("*").alias("_n"))
    rows = n.agg(F.sum("_n")).first()[0] or 1
    share = F.col("_n") / F.lit(rows)
    w = n.join(t, "_c", "left").select("_c", F.when(share > eps, F.coalesce(F.col("_t"), F.lit(0.0)) / total / share).otherwise(0.0).alias("_w"))
    return samples.join(w, F.col(column).cast("string").eqNullSafe(F.col("_c")), "left").select(*samples.columns, F.coalesce("_w", F.lit(0.0)).alias(out))


def resampled(weighted: DataFrame, key: str, weight: str = "weight", seed: int = 0) -> DataFrame:
    """As many rows as before, drawn with replacement by weight; without any weight the rows as they are, weight 1."""
    n, total = weighted.agg(F.count("*"), F.sum(expr.non_negative(weight))).first()
    if not total or total <= 0:
        return weighted.withColumn(weight, F.lit(1.0))
    spark = weighted.sparkSession
    keys = spark.range(n).select(F.col("id").alias("draw_id"), F.lit(1).alias("_all"))
    keys = keys.withColumn("_u", expr.hash_uniform(seed, "draw_id"))
    slices = allocation.weight_slices(weighted.withColumn("_all", F.lit(1)), ["_all"], key, F.col(weight))
    picked = allocation.draw(keys, slices, ["_all"], key, "_u").select("draw_id", F.col(key).alias("_k"))
    rows = weighted.select(F.col(key).alias("_key"), *[F.col(c).alias(c) for c in weighted.columns])
    return picked.join(rows, F.col("_k") == F.col("_key")).select("draw_id", *weighted.columns)
