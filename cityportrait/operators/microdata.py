"""Microdata: cleaning, encoding, decoding, conditional synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cityportrait.functions import expr
from cityportrait.functions.checks import require_columns
from cityportrait.operators import allocation


def cleaned(df: DataFrame, area: str = "PUMA", drop_null_income: bool = True) -> DataFrame:
    """Numeric age and income (income at least 0, PINCP_log its log1p), text SEX and area code; complete rows only."""
    require_columns(df, ["AGEP", "SEX", "PINCP", area], "persons")
    d = df.withColumn("AGEP", expr.number("AGEP")).withColumn("PINCP", expr.clipped("PINCP", 0.0))
    d = d.withColumn("PINCP_log", F.log1p("PINCP")).withColumn("SEX", expr.area_code("SEX")).withColumn("puma", expr.area_code(area))
    return d.dropna(subset=["AGEP", "SEX", "puma", *(["PINCP"] if drop_null_income else [])])


def with_buildings_only(persons: DataFrame, buildings: DataFrame, group: str = "puma") -> DataFrame:
    """Persons of areas that have buildings."""
    return persons.join(buildings.select(group).distinct(), group, "left_semi")


def fitted(df: DataFrame, numeric: list[str], categorical: list[str], group: str) -> DataFrame:
    """One row: mean and population deviation (1 where there is none) per numeric column, sorted categories, group shares."""
    aggs = []
    for c in numeric:
        s = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(s <= 1e-6, 1.0).otherwise(s).alias(f"std_{c}")]
    aggs += [F.sort_array(F.collect_set(c)).alias(f"cats_{c}") for c in [*categorical, group]]
    n = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col(group).isNotNull())
    prior = n.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(group).cast("string"), F.col("_n").cast("double"))))).alias("_counts"), F.sum("_n").alias("_t"))
    prior = prior.select(F.transform_values("_counts", lambda k, v: v / F.col("_t")).alias("prior"))
    return df.agg(*aggs).join(F.broadcast(prior))


def encoded(df: DataFrame, encoder: DataFrame, numeric: list[str], categorical: list[str], group: str, key: str) -> DataFrame:
    """(key, features, condition): z-scores and one-hot blocks, and the group's one-hot block. Nulls are an error."""
    j = df.join(F.broadcast(encoder))
    z = [((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")) for c in numeric]
    hot = [expr.one_hot(F.col(c), F.col(f"cats_{c}")) for c in categorical]
    return j.select(key, F.concat(F.array(*z), *hot).alias("features"), expr.one_hot(F.col(group), F.col(f"cats_{group}")).alias("condition"))


def decoded(vectors: DataFrame, encoder: DataFrame, numeric: list[str], categorical: list[str], key: str) -> DataFrame:
    """Inverse z-scores (age within [0, 99], income from its log), and per block the likeliest category and its share."""
    j = vectors.join(F.broadcast(encoder))
    out: list[Column] = []
    for i, c in enumerate(numeric):
        v = F.col("features")[i] * F.col(f"std_{c}") + F.col(f"mean_{c}")
        if c == "AGEP":
            v = F.greatest(F.least(v, F.lit(99.0)), F.lit(0.0))
        if c == "PINCP_log":
            v, c = F.expm1(F.greatest(v, F.lit(0.0))), "PINCP"
        out.append(v.alias(c))
    at = F.lit(len(numeric) + 1)
    for c in categorical:
        p = expr.softmax(F.slice("features", at, F.size(f"cats_{c}")))
        out += [expr.argmax_of(p, F.col(f"cats_{c}")).alias(c), F.array_max(p).alias(f"{c}_confidence")]
        at = at + F.size(f"cats_{c}")
    return j.select(key, *out)


def synthesized(seeds: DataFrame, prior: DataFrame, n: int, *, group: str = "puma", key: str = "seed_id", fields: tuple[str, ...] = ("AGEP", "PINCP", "SEX"), weight: str | None = None, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """n persons: a group drawn by the prior (group, weight), then a seed record drawn within it.

    The joint distribution within a group is that of its records. With jitter, age and log income move by at most
    that share and stay in their domains. Groups without records give null attributes.
    """
    people = allocation.draw_groups(seeds.sparkSession, n, prior, group, "weight", seed).withColumnRenamed("sample_id", "person_id")
    people = people.withColumn("_u", expr.hash_uniform(seed + 1, "person_id"))
    slices = allocation.weight_slices(seeds.filter(F.col(group).isNotNull()), [group], key, F.col(weight) if weight else F.lit(1.0))
    drawn = allocation.draw(people, slices, [group], key, "_u")
    j = drawn.join(seeds.select(F.col(key).alias("_k"), *fields), F.col(key) == F.col("_k"), "left").select("person_id", group, key, *fields)
    if jitter:
        move = 1 + jitter * (2 * expr.hash_uniform(seed + 2, "person_id") - 1)
        if "AGEP" in fields:
            j = j.withColumn("AGEP", expr.clipped(F.col("AGEP") * move, 0.0, 99.0))
        if "PINCP" in fields:
            j = j.withColumn("PINCP", F.expm1(F.greatest(F.log1p(F.greatest(F.col("PINCP"), F.lit(0.0))) * move, F.lit(0.0))))
    return j
