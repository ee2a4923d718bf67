"""Households formed of persons by size targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityportrait.functions import expr
from cityportrait.functions.checks import require_columns
from cityportrait.operators import ranks

#: Persons of this age and over lead a household before others do.
ADULT = 18


def household_counts(sizes: DataFrame, targets: DataFrame, area: str) -> DataFrame:
    """(area, n, layers): whole numbers of households of each size that house an area's n persons exactly.

    sizes: (area, n); targets: (area, hh_size, target). Targets are scaled to n persons and rounded down; of the rest
    one household goes to each size that still fits, largest fraction first, then as many as fit from the largest size
    on. What no size fits is one household more. Targets that add up to n persons already are kept as they are.
    Layer k tells how many households have a k-th person (`count`), and how many persons stand in the layers before.
    """
    t = targets.filter((F.col("hh_size") > 0) & (F.col("target") > 0)).groupBy(F.col(area).alias("_a"), F.col("hh_size").cast("long").alias("s")).agg(F.sum("target").cast("double").alias("t"))
    t = t.groupBy("_a").agg(F.sort_array(F.collect_list(F.struct("s", "t"))).alias("t"), F.sum(F.col("s") * F.col("t")).alias("w"))
    d = sizes.join(t, F.col(area) == F.col("_a")).drop("_a")
    quota = lambda x: x["t"] * F.col("n") / F.col("w")
    whole = lambda x: F.floor(quota(x) + 1e-9)
    part = F.transform("t", lambda x: F.struct(F.round(whole(x) - quota(x), 9).alias("less"), x["s"].alias("s"), whole(x).alias("h")))
    d = d.withColumn("p", F.sort_array(part))
    rest = F.col("n") - F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["s"] * x["h"])
    nothing = F.array().cast("array<struct<s:bigint,h:bigint>>")

    def dealt(rest, listed, more):
        """Go through the sizes with what is left to house; `more` says how many households a size gets of it."""
        return F.aggregate(
            listed,
            F.struct(rest.alias("rest"), nothing.alias("out")),
            lambda a, x: F.struct((a["rest"] - x["s"] * more(a, x)).alias("rest"), F.concat(a["out"], F.array(F.struct(x["s"].alias("s"), (x["h"] + more(a, x)).alias("h")))).alias("out")),
        )

    d = d.withColumn("one", dealt(rest, F.col("p"), lambda a, x: F.when(x["s"] <= a["rest"], 1).otherwise(0).cast("long")))
    d = d.withColumn("all", dealt(F.col("one.rest"), F.sort_array("one.out", asc=False), lambda a, x: F.floor(a["rest"] / x["s"])))
    odd = F.when(F.col("all.rest") > 0, F.array(F.struct(F.col("all.rest").alias("s"), F.lit(1).cast("long").alias("h")))).otherwise(nothing)
    d = d.withColumn("h", F.filter(F.concat("all.out", odd), lambda x: x["h"] > 0)).filter(F.size("h") > 0)
    count = lambda k: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["s"] >= k, x["h"]).otherwise(0))
    top = F.array_max(F.transform("h", lambda x: x["s"]))
    d = d.withColumn("c", F.transform(F.sequence(F.lit(1).cast("long"), top), count))
    layers = F.transform("c", lambda x, i: F.struct((i + 1).alias("slot"), F.aggregate(F.slice("c", 1, i), F.lit(0).cast("long"), lambda a, y: a + y).alias("start"), x.alias("count")))
    return d.select(area, "n", layers.alias("layers"))


def form_households(persons: DataFrame, targets: DataFrame, person: str, area: str, age: str, seed: int = 0) -> DataFrame:
    """The persons with household_id, hh_size and slot (1 is the head); null in areas without targets.

    Each area's persons are put in one order: adults by a draw, then the others from the oldest on. Its households are
    taken from the largest to the smallest. The first persons head them, one each; the next ones are their second
    persons, and so on, so adults are spread over the households before children are. A person's place in the order
    tells the household by arithmetic: no household is listed, and no area is the work of one task.
    """
    require_columns(persons, [person, area, age], "persons")
    require_columns(targets, [area, "hh_size", "target"], "targets")
    n = persons.filter(F.col(area).isNotNull()).groupBy(area).agg(F.count("*").alias("n"))
    counts = household_counts(n, targets, area).select(F.col(area).alias("_ha"), "layers")
    years, u = F.coalesce(F.floor(expr.number(age)), F.lit(0)), expr.hash_uniform(seed, person)
    p = ranks.ranked(persons.withColumn("_v", F.when(years >= ADULT, u).otherwise(ADULT + 1 - years + u)), [area], "_v", person, "_r", "_n")
    d = p.join(counts, F.col(area) == F.col("_ha"), "left")
    own = F.element_at(F.filter("layers", lambda x: x["start"] <= F.col("_r")), -1)
    d = d.withColumn("_l", own).withColumn("_h", F.col("_r") - F.col("_l.start"))
    return d.select(
        *persons.columns,
        F.when(F.col("_l").isNotNull(), F.concat_ws("-", F.col(area).cast("string"), F.col("_h").cast("string"))).alias("household_id"),
        F.when(F.col("_l").isNotNull(), F.size(F.filter("layers", lambda x: x["count"] > F.col("_h")))).alias("hh_size"),
        F.col("_l.slot").cast("int").alias("slot"),
    )


def household_table(formed: DataFrame, area: str, income: str | None = None) -> DataFrame:
    """One row a household: area, hh_size, and with `income` its persons' sum."""
    more = [F.sum(expr.non_negative(income)).alias("hh_income")] if income else []
    return formed.filter(F.col("household_id").isNotNull()).groupBy("household_id").agg(F.first(area).alias(area), F.first("hh_size").alias("hh_size"), *more)
