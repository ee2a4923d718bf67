"""Building features, parcel values, and price tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityportrait.functions import expr, geo
from cityportrait.functions.checks import choose, require_columns
from cityportrait.operators import spatial, tiers

#: Columns that come first in a building table (fixed values).
FRONT = ["bldg_id", "puma", "tract_geoid", "footprint_area_m2", "height_m", "cap_proxy", "dist_cbd_km", "centroid_lon", "centroid_lat"]


def features(footprints: DataFrame) -> DataFrame:
    """floors, cap_proxy and dist_cbd_km from area, height and centroid; rows lacking any of them go."""
    require_columns(footprints, ["bldg_id", "footprint_area_m2", "height_m", "centroid_lon", "centroid_lat"], "footprints")
    d = footprints.withColumn("floors", expr.floors("height_m"))
    d = d.withColumn("cap_proxy", expr.number("footprint_area_m2") * F.col("floors"))
    d = d.withColumn("dist_cbd_km", geo.distance_km(F.col("centroid_lon"), F.col("centroid_lat")))
    return d.dropna(subset=["footprint_area_m2", "height_m", "cap_proxy", "dist_cbd_km"])


def feature_table(footprints: DataFrame, pumas: DataFrame, tracts: DataFrame | None = None, city: DataFrame | None = None) -> DataFrame:
    """Features of the footprints in the city with the PUMA (and tract) that holds their centroid; rows lacking one go.

    Areas are ring tables; area_id is the PUMA's code or the tract's id. Of several areas the largest id counts.
    """
    d = features(footprints)
    x, y = "centroid_lon", "centroid_lat"
    if city is not None:
        d = spatial.inside_area(d, city, "bldg_id", x, y)
    for areas, name in ((pumas, "puma"), (tracts, "tract_geoid")):
        if areas is not None:
            hit = spatial.points_in_areas(d, areas, "bldg_id", x=x, y=y, how="largest").withColumnRenamed("area_id", name)
            d = d.drop(name).join(hit, "bldg_id")
    return front_columns(d.withColumn("puma", expr.area_code("puma")).dropna(subset=["puma"]))


def front_columns(df: DataFrame, front: list[str] = FRONT) -> DataFrame:
    """The front columns that are there first, then the rest in their order."""
    first = [c for c in front if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def value_share(df: DataFrame, parcel: str, value: str, mode: str = "cap_proxy", key: str = "bldg_id", out: str = "assessed_value_alloc") -> DataFrame:
    """Split a parcel's value over its buildings: not at all, by area, or by capacity; without weights nobody loses.

    Shares are sums per parcel joined back, so a parcel with many buildings is no single task. Buildings without a
    parcel are a group of their own.
    """
    choose(mode, ("none", "area", "cap_proxy"), "mode")
    if mode == "none":
        return df.withColumn(out, expr.non_negative(value))
    w = expr.non_negative("footprint_area_m2" if mode == "area" else "cap_proxy")
    d = df.withColumn("_w", w)
    total = d.groupBy(F.col(parcel).alias("_p")).agg(F.sum("_w").alias("_t"))
    j = d.join(total, F.col(parcel).eqNullSafe(F.col("_p")))
    share = F.when(F.col("_t") > 0, F.least(F.greatest(F.col("_w") / F.col("_t"), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return j.select(*df.columns, (expr.non_negative(value) * share).alias(out))


def priced(df: DataFrame, group: str | None, q: int = 5) -> DataFrame:
    """price_per_sqft and price_tier from the allocated value; null prices count as 0 for the tier."""
    d = df.withColumn("price_per_sqft", expr.price_per_sqft("assessed_value_alloc", "footprint_area_m2"))
    return tiers.quantile_tier(d, group, "price_per_sqft", "bldg_id", q)
