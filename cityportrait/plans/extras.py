"""Queries of condition vectors, households, portrait and hourly checks, and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityportrait.functions import expr
from cityportrait.operators import buildings, conditions, spatial, tiers, validation
from cityportrait.plans.common import PARTS, VISITS, parts, table, tier_sql, visits
from cityportrait.plans.places import _PIP, areas
from cityportrait.plans.validation import micro

Q, S = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query("""WITH n AS (SELECT o_orderpriority AS g, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT g, c, n / sum(n) OVER (PARTITION BY g) AS p FROM n)
  SELECT g AS "group", round(coalesce(max(p) FILTER (c = 'F'), 0), 9) AS f, round(coalesce(max(p) FILTER (c = 'O'), 0), 9) AS o, round(coalesce(max(p) FILTER (c = 'P'), 0), 9) AS p FROM p GROUP BY g""")
def ext3_region_vectors(spark, d):
    a = micro(spark, d)
    v = conditions.region_vectors(validation.shares(validation.long_form(a, "puma", {"SEX": F.col("SEX")})), ["SEX=F", "SEX=O", "SEX=P"])
    return v.select("group", *[F.round(F.col("vector")[i], 9).alias(c) for i, c in enumerate("fop")])


@query(f"""WITH {PARTS}, c AS (SELECT *, floor(x / 0.5::DOUBLE) AS cx, floor(y / 0.5::DOUBLE) AS cy FROM prt), n AS (SELECT cx, cy, count(*) AS n FROM c GROUP BY ALL), st AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM prt)
  SELECT bldg_id, round((any_value(value) - any_value(m)) / any_value(s), 6) AS z_value, sum(n.n)::BIGINT - 1 AS neighbours FROM c JOIN n ON abs(c.cx - n.cx) <= 1 AND abs(c.cy - n.cy) <= 1, st GROUP BY bldg_id""")
def ext3_building_vectors(spark, d):
    v = conditions.building_vectors(parts(spark, d), ["value"], "bldg_id", "x", "y", 0.5)
    return v.select("bldg_id", F.round("z_value", 6).alias("z_value"), "neighbours")


@query(f"""WITH {VISITS}, h AS (SELECT hour(ts) AS h, count(*) FILTER (caid % 2 = 0) AS a, count(*) FILTER (caid % 2 = 1) AS b FROM vis GROUP BY 1)
  SELECT round(sum(abs(a / (SELECT sum(a) FROM h)::DOUBLE - b / (SELECT sum(b) FROM h)::DOUBLE)) / 2, 9) AS tvd FROM h""")
def ext9_hourly_distance(spark, d):
    v = visits(spark, d)
    return conditions.hourly_distance(v.filter("caid % 2 = 0"), v.filter("caid % 2 = 1"), "ts").withColumn("tvd", F.round("tvd", 9))


@query(f"""WITH {PARTS}, p AS (SELECT puma, sum(footprint_area_m2) AS a, count(*) AS b FROM prt GROUP BY 1)
  SELECT round((SELECT corr(footprint_area_m2, value) FROM prt), 6) AS capacity_r, round(sum(abs(a / (SELECT sum(a) FROM p) - b / (SELECT sum(b) FROM p)::DOUBLE)) / 2, 9) AS mass_tvd FROM p""")
def ext11_portrait_checks(spark, d):
    p = parts(spark, d)
    c = conditions.portrait_checks(p, p.groupBy("puma").agg(F.count("*").alias("target")), "puma", "footprint_area_m2", "value")
    return c.select(F.round("capacity_r", 6).alias("capacity_r"), F.round("mass_tvd", 9).alias("mass_tvd"))


@query("""WITH h AS (SELECT o_orderkey, o_orderkey % 9 AS size FROM orders), n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT count(size) AS households, count_if(size IS NOT NULL AND coalesce(n, 0) <> size) AS wrong_size, coalesce(sum(n) FILTER (size IS NULL), 0)::BIGINT AS persons_without FROM h FULL JOIN n ON o_orderkey = l_partkey""")
def ext13_household_consistency(spark, d):
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("hh"), (F.col("o_orderkey") % 9).alias("size"))
    return conditions.household_consistency(h, table(spark, d, "lineitem").select(F.col("l_partkey").alias("hh")), "hh", "size")


@query(_PIP + " SELECT bldg_id AS from_id, max(area_id) AS to_id FROM hit GROUP BY 1")
def joi2_centroid_crosswalk(spark, d):
    corner = lambda i, j: F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"))
    squares = parts(spark, d).select("bldg_id", F.lit(False).alias("is_hole"), F.array(corner(-0.25, -0.25), corner(0.25, -0.25), corner(0.25, 0.25), corner(-0.25, 0.25)).alias("ring"))
    return spatial.crosswalk(squares, areas(spark), "bldg_id", "area_id")


@query("""WITH p AS (SELECT c_custkey, c_nationkey FROM customer), s AS (SELECT s_nationkey, min(s_suppkey) AS first_bldg, count(*) AS n FROM supplier GROUP BY 1)
  SELECT c_custkey AS person_id, first_bldg, coalesce(n, 0) AS n FROM p LEFT JOIN s ON c_nationkey = s_nationkey""")
def joi9_buildings_of_group(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("puma")).agg(F.min("s_suppkey").alias("first_bldg"), F.count("*").alias("n"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("puma"))
    return p.join(s, "puma", "left").select("person_id", "first_bldg", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {PARTS}, {tier_sql('tp', 'prt', None, 'value', 'bldg_id', 9)}, av AS (SELECT parcel_id, list_sort(list_distinct(list(price_tier))) AS ts FROM tp GROUP BY parcel_id),
  w AS (SELECT bldg_id, parcel_id, (bldg_id % 9 + 1)::INTEGER AS desired FROM prt)
  SELECT bldg_id, (list_sort(list_transform(ts, lambda t: abs(t - desired) * 1000 + t))[1] % 1000)::INTEGER AS tier FROM w JOIN av USING (parcel_id)""")
def joi11_nearest_tier(spark, d):
    t = tiers.quantile_tier(parts(spark, d), None, "value", "bldg_id", 9)
    offered = t.groupBy("parcel_id").agg(F.collect_set("price_tier").alias("tiers"))
    w = parts(spark, d).select("bldg_id", "parcel_id", (F.col("bldg_id") % 9 + 1).cast("int").alias("desired")).join(offered, "parcel_id")
    return w.select("bldg_id", expr.nearest_tier(F.col("tiers"), F.col("desired")).alias("tier"))


@query(f"""WITH {PARTS}, a AS (SELECT bldg_id, footprint_area_m2 * greatest(height_m / 3, 1) AS cap_proxy, value, parcel_id, puma, footprint_area_m2 FROM prt),
  v AS (SELECT *, value * least(greatest(cap_proxy / sum(cap_proxy) OVER (PARTITION BY parcel_id), 0), 1) / (footprint_area_m2 * 10.763910416709722::DOUBLE) AS ppsf FROM a), {tier_sql('tp', 'v', 'puma', 'ppsf', 'bldg_id', 5)}
  SELECT bldg_id, puma, round(ppsf, 9) AS price_per_sqft, price_tier FROM tp""")
def building_price_pipeline(spark, d):
    b = parts(spark, d).withColumn("cap_proxy", F.col("footprint_area_m2") * expr.floors("height_m"))
    p = buildings.priced(buildings.value_share(b, "parcel_id", "value", "cap_proxy"), "puma")
    return p.select("bldg_id", "puma", F.round("price_per_sqft", 9).alias("price_per_sqft"), "price_tier")
