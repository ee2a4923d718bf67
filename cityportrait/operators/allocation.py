"""Allocation of persons to buildings, seeded draws and splits.

Every draw is hash_uniform(seed, key): the rows do not depend on partitioning. A weighted draw is an equi-join on
(group, slice of [0, 1)) with a range condition, so a group with most of the persons is spread over its slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cityportrait.functions import expr
from cityportrait.functions.checks import choose, require_columns
from cityportrait.operators import ranks, tiers
from cityportrait.operators.lineage import settled

ITEMS_PER_SLICE = 16


def weight_slices(items: DataFrame, group: list[str], item: str, weight: Column) -> DataFrame:
    """(group, item, lo, hi): each item's part of [0, 1) by weight, in the order of a hash of the item.

    Weights that add up to nothing count as equal. Items without weight have no part; a part ends where the next one
    begins, the last one at 1. A group's items are dealt to up to 65,536 buckets.
    """
    d = items.select(*group, item, expr.non_negative(weight).alias("_w"))
    totals = d.groupBy(*group).agg(F.sum("_w").alias("_tw"), F.count("*").alias("_n"))
    d = d.join(ranks.renamed(totals, group), ranks.same(group))
    d = d.select(*group, item, "_n", F.when(F.col("_tw") > 0, F.col("_w")).otherwise(1.0).alias("_one"), F.substring(F.md5(F.col(item).cast("string")), 1, 4).alias("_b"))
    r = ranks.running(d.filter("_one > 0"), group, "_b", [item], "_one", "_before", "_total", "_after")
    return r.select(
        *group, item, (F.col("_before") / F.col("_total")).alias("lo"), (F.col("_after") / F.col("_total")).alias("hi"),
        F.ceil(F.col("_n") / ITEMS_PER_SLICE).cast("long").alias("_slices"),
    )


def draw(keys: DataFrame, slices: DataFrame, group: list[str], item: str, u: str) -> DataFrame:
    """Left join of each row to the item whose part of [0, 1) holds its draw `u`; null where the group has no items."""
    per = slices.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.max("_slices").alias("_k"))
    on = F.lit(True)
    for g in group:
        on = on & (F.col(g) == F.col(f"_g_{g}"))
    d = keys.join(per, on, "left").withColumn("_at", F.floor(F.col(u) * F.col("_k")))
    parts = slices.select(
        *[F.col(g).alias(f"_s_{g}") for g in group], item, "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * F.col("_slices")), F.least(F.floor(F.col("hi") * F.col("_slices")), F.col("_slices") - 1))).alias("_slice"),
    )
    on = (F.col("_at") == F.col("_slice")) & (F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))
    for g in group:
        on = on & (F.col(g) == F.col(f"_s_{g}"))
    return d.join(parts, on, "left").select(*keys.columns, item)


def assign_within_area(persons: DataFrame, buildings: DataFrame, person: str, area: str, building: str, weights: Sequence[str] = ("res_capacity", "footprint_area_m2"), seed: int = 0) -> DataFrame:
    """(person, area, building): one building of the person's area, by the first weight column present, else uniformly."""
    require_columns(persons, [person, area], "persons")
    require_columns(buildings, [building, area], "buildings")
    weight = next((F.col(w) for w in weights if w in buildings.columns), F.lit(1.0))
    slices = weight_slices(buildings.filter(F.col(area).isNotNull()), [area], building, weight)
    keys = persons.select(person, area, expr.hash_uniform(seed, person).alias("_u"))
    return draw(keys, slices, [area], building, "_u").select(person, area, building)


#: Names of the methods (fixed values).
METHODS = ("random", "capacity_only", "income_price_match")


def allocate(
    persons: DataFrame, buildings: DataFrame, method: str, *, person: str = "person_id", group: str = "puma", income: str = "PINCP",
    building: str = "bldg_id", capacity: str = "cap_proxy", tier: str = "price_tier", n_tiers: int = 5, seed: int = 0,
) -> DataFrame:
    """Persons with their building, and for income_price_match desired_tier, used_tier and tier_fallback.

    Capacity is a weight, not a limit: draws are with replacement. Tiers of 0 or less, or null, are not offered; in a
    group without any tier the draw is over the whole group. Persons whose group has no buildings get null.
    """
    choose(method, METHODS, "method")
    require_columns(persons, [person, group, *([income] if method == "income_price_match" else [])], "persons")
    require_columns(buildings, [building, group, *([] if method == "random" else [capacity]), *([tier] if method == "income_price_match" else [])], "buildings")
    b = buildings.filter(F.col(group).isNotNull())
    p = persons.withColumn("_u", expr.hash_uniform(seed, person))
    if method != "income_price_match":
        weight = F.lit(1.0) if method == "random" else F.col(capacity)
        return draw(p, weight_slices(b, [group], building, weight), [group], building, "_u").drop("_u")
    p = tiers.income_tier(p, group, income, person, n_tiers)
    b = b.withColumn("_tier", F.coalesce(F.col(tier).try_cast("int"), F.lit(0))).select(group, building, capacity, "_tier")
    offered = b.filter("_tier > 0").groupBy(F.col(group).alias("_og")).agg(F.array_sort(F.collect_set("_tier")).alias("_tiers"))
    # tier 0 stands for a group without tiers, whose buildings are all offered
    offered = settled(offered)
    options = b.join(offered, F.col(group) == F.col("_og"), "left").filter(F.col("_og").isNull() | (F.col("_tier") > 0))
    options = settled(options.select(group, building, capacity, F.when(F.col("_og").isNull(), 0).otherwise(F.col("_tier")).alias("_tier")))
    p = p.join(offered, F.col(group) == F.col("_og"), "left").drop("_og")
    p = p.withColumn("_tier", F.coalesce(expr.nearest_tier(F.col("_tiers"), F.col("desired_tier")), F.lit(0)))
    out = draw(p, weight_slices(options, [group, "_tier"], building, F.col(capacity)), [group, "_tier"], building, "_u")
    used = F.when(F.col("_tier") > 0, F.col("_tier"))
    return out.select(*persons.columns, building, "desired_tier", used.alias("used_tier"), (used.isNotNull() & (used != F.col("desired_tier"))).alias("tier_fallback"))


def diagnostics(allocated: DataFrame, building: str = "bldg_id", group: str = "puma") -> DataFrame:
    """One row: assigned and unassigned persons, groups, tier fallbacks and their rate, persons placed without tiers."""
    has = F.col(building).isNotNull()
    aggs = [F.count("*").alias("n_persons"), F.count_if(has).alias("assigned"), F.count_if(~has).alias("unassigned"), F.count_distinct(F.coalesce(F.col(group).cast("string"), F.lit("\0"))).alias("groups")]
    if "tier_fallback" in allocated.columns:
        aggs += [
            F.count_if("tier_fallback").alias("fallbacks"),
            (F.count_if("tier_fallback") / F.greatest(F.count_if(has), F.lit(1))).alias("fallback_rate"),
            F.count_if(has & F.col("used_tier").isNull()).alias("no_tier_persons"),
        ]
    return allocated.agg(*aggs)


def candidates(persons: DataFrame, buildings: DataFrame, k: int, person: str, area: str, building: str, seed: int = 0) -> DataFrame:
    """k candidate buildings per person, uniform with replacement inside the area."""
    p = persons.select(person, area, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("candidate"))
    p = p.withColumn("_u", expr.hash_uniform(seed, person, "candidate"))
    slices = weight_slices(buildings.filter(F.col(area).isNotNull()), [area], building, F.lit(1.0))
    return draw(p, slices, [area], building, "_u").drop("_u")


def draw_groups(spark, n: int, prior: DataFrame, group: str, weight: str, seed: int = 0) -> DataFrame:
    """n rows (sample_id, group) drawn by a prior; uniformly if the prior adds up to 0."""
    keys = spark.range(n).select(F.col("id").alias("sample_id"), F.lit(1).alias("_all"))
    keys = keys.withColumn("_u", expr.hash_uniform(seed, "sample_id"))
    slices = weight_slices(prior.withColumn("_all", F.lit(1)), ["_all"], group, F.col(weight))
    return draw(keys, slices, ["_all"], group, "_u").select("sample_id", group)


def split(df: DataFrame, group: str, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Add `part`: train or holdout, floor(fraction * n) rows of each group for training.

    A group of two or more keeps one row on either side; a single row is for training. The same arguments give the
    same split again.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    d = df.withColumn("_u", expr.hash_uniform(seed, key))
    r = ranks.ranked(d, [group], "_u", key, "_rank", "_n")
    n = F.floor(F.col("_n") * fraction)
    n = F.when(F.col("_n") < 2, F.col("_n")).otherwise(F.greatest(F.lit(1), F.least(n, F.col("_n") - 1)))
    return r.select(*df.columns, F.when(F.col("_rank") < n, "train").otherwise("holdout").alias("part"))


def ensure_filled(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def train_and_holdout(df: DataFrame, group: str, key: str, fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The two sides of `split`; an error if either is empty."""
    parts = settled(split(df, group, key, fraction, seed))
    side = lambda name: ensure_filled(parts.filter(F.col("part") == name).drop("part"), name)
    return side("train"), side("holdout")


def subsample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same ones on any partitioning."""
    return df.orderBy(expr.hash_uniform(seed, key), key).limit(n)


#: Grids of the nearest-building search: so many, each cell STEP times as wide as the next one's, over so many features at most.
LEVELS, STEP, AXES = 10, 4, 3


def nearest_building(persons: DataFrame, buildings: DataFrame, person: str, building: str, area: str, features: dict[str, str], tier: str | None = None) -> DataFrame:
    """(person, building): the closest building of the area in standardised features {person column: building column}.

    With a tier, only buildings of the person's tier are compared. Ties go to the smaller building id. Persons that
    lack a feature or whose area has no buildings are left out.

    A person's own cell tells, from fine to coarse grids, how far the closest building can be; only the cells around
    the person on the next coarser grid are compared, so candidates follow the local density and not the area's size.
    Grids lie over the AXES features that vary most; with more features than that, the closest building of the own
    cell is found first, in all features, and its distance tells the grid. So a person looks at 27 cells at most,
    however many features there are. Buildings with equal features count once.
    """
    n = len(features)
    both = [F.min(b) for b in features.values()] + [F.max(b) for b in features.values()] + [F.stddev_pop(b) for b in features.values()]
    stats = buildings.agg(*both).first()
    mine = persons.agg(*[F.min(p) for p in features], *[F.max(p) for p in features]).first()
    scale = [float(s) if (s := stats[2 * n + i]) and s > 1e-6 else 1.0 for i in range(n)]
    ends = [[float(v) for v in (stats[i], stats[n + i], mine[i], mine[n + i]) if v is not None] or [0.0] for i in range(n)]
    # the coarsest cells are as wide as everything, so that the cells next to a person's hold all buildings
    width = max((max(e) - min(e)) / s for e, s in zip(ends, scale, strict=True)) or 1.0
    axes = sorted(sorted(range(n), key=lambda i: (-(max(ends[i][:2]) - min(ends[i][:2])) / scale[i], i))[:AXES])
    keys = [area, *([tier] if tier else [])]
    groups = [f"_k{i}" for i in range(len(keys))]
    cells = [f"_c{i}" for i in axes]

    def side(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
        d = df.select(F.col(name).alias(name), *[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], *[F.col(c).cast("double").alias(f"{value}{i}") for i, c in enumerate(columns)])
        return d.dropna(subset=[f"{value}{i}" for i in range(n)])

    def on_level(df: DataFrame, value: str) -> DataFrame:
        size = width / F.pow(F.lit(float(STEP)), F.col("_level"))
        return df.withColumns({c: F.floor(F.col(f"{value}{i}") / scale[i] / size) for i, c in zip(axes, cells, strict=True)})

    every = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level")
    b = side(buildings, list(features.values()), building, "_b").groupBy(*groups, *[f"_b{i}" for i in range(n)]).agg(F.min(building).alias(building))
    b = settled(on_level(b.select("*", every), "_b"))
    p = settled(side(persons, list(features), person, "_p"))
    occupied = b.select(*groups, "_level", *cells).distinct()
    hit = on_level(p.select("*", every), "_p").join(occupied, [*groups, "_level", *cells]).groupBy(person).agg(F.max("_level").alias("_hit"))
    d = F.lit(0.0)
    for i in range(n):
        d = d + F.pow((F.col(f"_p{i}") - F.col(f"_b{i}")) / scale[i], 2)
    if n <= AXES:
        q = p.join(hit, person, "left").withColumn("_level", F.greatest(F.coalesce("_hit", F.lit(0)) - 1, F.lit(0)))
    else:
        own = on_level(p.join(hit, person).withColumn("_level", F.col("_hit")), "_p").join(b, [*groups, "_level", *cells])
        bound = own.groupBy(person).agg(F.sqrt(F.min(d) + 2e-9).alias("_d"))
        # the finest grid whose cells are as wide as that distance, and as what rounding makes equal to it
        level = F.floor(F.log(F.lit(width) / F.col("_d")) / math.log(STEP)).cast("int")
        q = p.join(bound, person, "left").withColumn("_level", F.greatest(F.least(F.coalesce(level, F.lit(0)), F.lit(LEVELS - 1)), F.lit(0)))
    q = on_level(q, "_p")
    for c in cells:
        q = q.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    j = q.join(b, [*groups, "_level", *cells])
    return j.groupBy(person).agg(F.min_by(building, F.struct(F.round(d, 9), F.col(building))).alias(building))
