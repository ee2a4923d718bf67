"""Condition vectors of regions and buildings, household consistency, portrait and hourly checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityportrait.operators import validation


def region_vectors(shares: DataFrame, categories: list[str]) -> DataFrame:
    """(group, vector): marginal shares of (group, variable, category, p) in the order of `categories` ("variable=category")."""
    name = F.concat_ws("=", "variable", "category")
    wide = shares.groupBy("group").pivot("_c", categories).agg(F.first("p")) if "_c" in shares.columns else shares.withColumn("_c", name).groupBy("group").pivot("_c", categories).agg(F.first("p"))
    return wide.select("group", F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in categories]).alias("vector"))


def building_vectors(buildings: DataFrame, numeric: list[str], key: str, x: str, y: str, cell: float) -> DataFrame:
    """(key, z..., neighbours): standardised features, and the other buildings in the 3 x 3 cells around.

    Neighbours are counted by an equi-join of cell counts, not of buildings.
    """
    stats = buildings.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    b = buildings.withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)})
    counts = b.groupBy("_cx", "_cy").agg(F.count("*").alias("_n"))
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = counts.withColumn("_s", F.explode(step)).groupBy((F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy")).agg(F.sum("_n").alias("_near"))
    z = [((F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] if stats[f"s_{c}"] and stats[f"s_{c}"] > 1e-6 else 1.0)).alias(f"z_{c}") for c in numeric]
    return b.join(around, ["_cx", "_cy"]).select(key, *z, (F.col("_near") - 1).alias("neighbours"))


def household_consistency(households: DataFrame, persons: DataFrame, household: str, size: str) -> DataFrame:
    """One row: households, those whose stated size differs from their persons, persons without a household."""
    n = persons.filter(F.col(household).isNotNull()).groupBy(household).agg(F.count("*").alias("_n"))
    j = households.select(household, F.col(size).alias("_size")).join(n, household, "full_outer")
    return j.agg(
        F.count("_size").alias("households"),
        F.count_if(F.col("_size").isNotNull() & (F.coalesce("_n", F.lit(0)) != F.col("_size"))).alias("wrong_size"),
        F.coalesce(F.sum(F.when(F.col("_size").isNull(), F.col("_n"))), F.lit(0)).alias("persons_without"),
    )


def portrait_checks(portraits: DataFrame, targets: DataFrame, group: str, population: str, capacity: str) -> DataFrame:
    """One row: correlation of population and capacity, and the distance of the groups' mass from target mass (group, target)."""
    c = validation.pearson(portraits, population, capacity).select(F.col("r").alias("capacity_r"))
    mass = portraits.groupBy(F.col(group).cast("string").alias("category")).agg(F.sum(population).cast("double").alias("w"))
    goal = targets.select(F.col(group).cast("string").alias("category"), F.col("target").cast("double").alias("w"))
    side = lambda d: validation.shares(d.select(F.lit("all").alias("group"), F.lit("mass").alias("variable"), "category", "w"))
    t = validation.distances(validation.aligned(side(mass), side(goal))).select(F.col("tvd").alias("mass_tvd"))
    return c.join(F.broadcast(t))


def hourly_distance(left: DataFrame, right: DataFrame, ts: str) -> DataFrame:
    """(tvd) of two event tables' shares by hour of day."""
    side = lambda d: validation.shares(d.select(F.lit("all").alias("group"), F.lit("hour").alias("variable"), F.hour(ts).cast("string").alias("category"), F.lit(1.0).alias("w")))
    return validation.distances(validation.aligned(side(left), side(right))).select("tvd")
