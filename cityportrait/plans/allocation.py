"""Queries of tiers, allocation, portraits, calibration and synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cityportrait.functions import expr
from cityportrait.operators import allocation, buildings, calibration, microdata, portrait, tiers
from cityportrait.operators.lineage import settled
from cityportrait.plans.common import PARTS, PERSONS, SUPPLIERS, parts, persons, slices_sql, suppliers, tier_sql, uniform

Q, S = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


def _tiered(spark: SparkSession, d: str) -> DataFrame:
    return settled(tiers.quantile_tier(suppliers(spark, d), "puma", "price", "bldg_id", 5))


_DRAW = "SELECT p.person_id, p.puma, s.item AS bldg_id FROM persons p LEFT JOIN sl s ON p.puma = s.g AND {u} >= s.lo AND {u} < s.hi"


@query(f"WITH {PERSONS}, {SUPPLIERS}, {slices_sql('sl', 'bld', 'puma', 'bldg_id', 'cap_proxy')} " + _DRAW.format(u=uniform(1, "p.person_id")))
def alc1_assign_within_area(spark, d):
    b = suppliers(spark, d).withColumnRenamed("cap_proxy", "footprint_area_m2")
    return allocation.assign_within_area(persons(spark, d), b, "person_id", "puma", "bldg_id", seed=1)


@query(f"WITH {PERSONS}, {SUPPLIERS}, {slices_sql('sl', 'bld', 'puma', 'bldg_id', '1')} " + _DRAW.format(u=uniform(2, "p.person_id")))
def alc2_random(spark, d):
    return allocation.allocate(persons(spark, d), suppliers(spark, d), "random", seed=2).select("person_id", "puma", "bldg_id")


@query(f"WITH {PERSONS}, {SUPPLIERS}, {slices_sql('sl', 'bld', 'puma', 'bldg_id', 'cap_proxy')} " + _DRAW.format(u=uniform(3, "p.person_id")))
def alc3_capacity_only(spark, d):
    return allocation.allocate(persons(spark, d), suppliers(spark, d), "capacity_only", seed=3).select("person_id", "puma", "bldg_id")


_MATCH = f"""WITH {PERSONS}, {SUPPLIERS}, {tier_sql('tb', 'bld', 'puma', 'price', 'bldg_id', 5)},
  inc AS (SELECT *, row_number() OVER (PARTITION BY puma ORDER BY coalesce("PINCP", 0), person_id) - 1 AS i, count(*) OVER (PARTITION BY puma) AS n FROM persons),
  want AS (SELECT *, greatest(least(ceil((i + 0.5::DOUBLE) / n * 5), 5), 1)::INTEGER AS desired_tier FROM inc),
  av AS (SELECT puma, list_sort(list_distinct(list(price_tier))) AS ts FROM tb WHERE price_tier > 0 GROUP BY puma),
  used AS (SELECT w.*, coalesce(list_sort(list_transform(ts, lambda t: abs(t - desired_tier) * 1000 + t))[1] % 1000, 0) AS tier FROM want w LEFT JOIN av USING (puma)),
  opt AS (SELECT puma * 100 + price_tier AS gt, bldg_id, cap_proxy FROM tb),
  {slices_sql('sl', 'opt', 'gt', 'bldg_id', 'cap_proxy')},
  matched AS (SELECT u.person_id, u.puma, u."PINCP", u."AGEP", u."SEX", s.item AS bldg_id, u.desired_tier, CASE WHEN tier > 0 THEN tier END::INTEGER AS used_tier, coalesce(tier > 0 AND tier <> desired_tier, false) AS tier_fallback
    FROM used u LEFT JOIN sl s ON u.puma * 100 + u.tier = s.g AND {uniform(4, 'u.person_id')} >= s.lo AND {uniform(4, 'u.person_id')} < s.hi)"""


def _matched(spark, d):
    return allocation.allocate(persons(spark, d), _tiered(spark, d), "income_price_match", seed=4)


@query(_MATCH + " SELECT person_id, puma, bldg_id, desired_tier, used_tier, tier_fallback FROM matched")
def alc4_income_price_match(spark, d):
    m = _matched(spark, d)
    return m.select("person_id", "puma", "bldg_id", "desired_tier", "used_tier", F.coalesce("tier_fallback", F.lit(False)).alias("tier_fallback"))


@query(_MATCH + """ SELECT count(*) AS n_persons, count(bldg_id) AS assigned, count(*) - count(bldg_id) AS unassigned, count(DISTINCT puma) AS groups,
  count_if(tier_fallback) AS fallbacks, round(count_if(tier_fallback) / greatest(count(bldg_id), 1)::DOUBLE, 9) AS fallback_rate, count_if(bldg_id IS NOT NULL AND used_tier IS NULL) AS no_tier_persons FROM matched""")
def agg23_allocation_diagnostics(spark, d):
    return allocation.diagnostics(_matched(spark, d)).withColumn("fallback_rate", F.round("fallback_rate", 9))


_PORTRAIT = """SELECT m.bldg_id, count(*) AS pop_count, round(avg("AGEP"), 6) AS age_mean, round(quantile_cont("AGEP"::DOUBLE, 0.5), 6) AS age_p50, round(quantile_cont("AGEP"::DOUBLE, 0.9), 6) AS age_p90,
  round(avg("PINCP"), 6) AS income_mean, round(quantile_cont("PINCP", 0.5), 6) AS income_p50, round(quantile_cont("PINCP", 0.9), 6) AS income_p90"""


@query(_MATCH + _PORTRAIT + ", any_value(tb.price_tier) AS price_tier, any_value(tb.puma) AS puma FROM matched m JOIN tb ON m.bldg_id = tb.bldg_id GROUP BY m.bldg_id")
def agg15_building_portrait(spark, d):
    b = _tiered(spark, d)
    p = portrait.with_attributes(portrait.portrait(allocation.allocate(persons(spark, d), b, "income_price_match", seed=4)), b.select("bldg_id", "price_tier", "puma"))
    return p.withColumns({c: F.round(c, 6) for c in ("age_mean", "age_p50", "age_p90", "income_mean", "income_p50", "income_p90")})


@query(f"WITH {PARTS}, {tier_sql('tp', 'prt', 'puma', 'value', 'bldg_id', 5)} SELECT bldg_id, puma, price_tier FROM tp")
def win5_tier_in_group(spark, d):
    return tiers.quantile_tier(parts(spark, d), "puma", "value", "bldg_id", 5).select("bldg_id", "puma", "price_tier")


@query(f"WITH {PARTS}, {tier_sql('tp', 'prt', None, 'footprint_area_m2', 'bldg_id', 4)} SELECT bldg_id, price_tier FROM tp")
def win5_tier_global(spark, d):
    return tiers.quantile_tier(parts(spark, d), None, "footprint_area_m2", "bldg_id", 4).select("bldg_id", "price_tier")


@query("""WITH i AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
  SELECT o_orderkey, o_orderpriority, greatest(least(ceil((i + 0.5::DOUBLE) / n * 7), 7), 1)::INTEGER AS desired_tier FROM i""")
def win1_income_tier(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return tiers.income_tier(o, "o_orderpriority", "o_totalprice", "o_orderkey", 7).select("o_orderkey", "o_orderpriority", "desired_tier")


@query(f"""WITH {PARTS}, f AS (SELECT *, footprint_area_m2 * greatest(height_m / 3, 1) AS cap_proxy FROM prt)
  SELECT bldg_id, parcel_id, round(value * least(greatest(cap_proxy / sum(cap_proxy) OVER (PARTITION BY parcel_id), 0), 1), 6) AS by_capacity,
    round(value * least(greatest(footprint_area_m2 / sum(footprint_area_m2) OVER (PARTITION BY parcel_id), 0), 1), 6) AS by_area, value AS whole FROM f""")
def win2_parcel_value_share(spark, d):
    b = parts(spark, d).withColumn("cap_proxy", F.col("footprint_area_m2") * expr.floors("height_m"))
    a = buildings.value_share(b, "parcel_id", "value", "cap_proxy", out="by_capacity")
    a = buildings.value_share(a, "parcel_id", "value", "area", out="by_area")
    a = buildings.value_share(a, "parcel_id", "value", "none", out="whole")
    return a.select("bldg_id", "parcel_id", F.round("by_capacity", 6).alias("by_capacity"), F.round("by_area", 6).alias("by_area"), "whole")


@query(f"WITH {PARTS} SELECT bldg_id, round((rank() OVER (PARTITION BY puma ORDER BY footprint_area_m2) + (count(*) OVER (PARTITION BY puma, footprint_area_m2) - 1) / 2.0) / count(*) OVER (PARTITION BY puma), 9)::DOUBLE AS percent_rank FROM prt")
def win3_percent_rank(spark, d):
    from cityportrait.operators import ranks

    r = ranks.percent_rank_average(parts(spark, d), ["puma"], "footprint_area_m2", "bldg_id")
    return r.select("bldg_id", F.round("percent_rank", 9).alias("percent_rank"))


@query(f"WITH {SUPPLIERS}, {slices_sql('sl', 'bld', 'puma', 'bldg_id', 'cap_proxy')} SELECT g AS puma, item AS bldg_id, round(lo, 9) AS lo, round(hi, 9) AS hi FROM sl")
def win6_weight_slices(spark, d):
    s = allocation.weight_slices(suppliers(spark, d), ["puma"], "bldg_id", F.col("cap_proxy"))
    return s.select("puma", "bldg_id", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query(f"""WITH {PERSONS}, r AS (SELECT person_id, puma, row_number() OVER (PARTITION BY puma ORDER BY {uniform(9, 'person_id')}, person_id) - 1 AS i, count(*) OVER (PARTITION BY puma) AS n FROM persons)
  SELECT person_id, puma, CASE WHEN i < CASE WHEN n < 2 THEN n ELSE greatest(1, least(floor(n * 0.8::DOUBLE), n - 1)) END THEN 'train' ELSE 'holdout' END AS part FROM r""")
def alc9_split(spark, d):
    sides = zip(("train", "holdout"), allocation.train_and_holdout(persons(spark, d), "puma", "person_id", 0.8, seed=9), strict=True)
    train, holdout = [p.select("person_id", "puma", F.lit(name).alias("part")) for name, p in sides]
    return train.unionByName(holdout)


@query(f"""WITH {PERSONS}, t AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT "SEX", count(*) AS n FROM persons GROUP BY 1),
  tg(cat, target) AS (VALUES ('AUTOMOBILE', 10.0::DOUBLE), ('BUILDING', 30.0::DOUBLE), ('FURNITURE', 0.0::DOUBLE), ('MACHINERY', 60.0::DOUBLE))
  SELECT person_id, round(coalesce(target / 100.0::DOUBLE / (c.n / (SELECT count(*) FROM persons)::DOUBLE), 0), 9) AS weight FROM persons p JOIN c ON p."SEX" = c."SEX" LEFT JOIN tg ON p."SEX" = cat""")
def alc5_reweight(spark, d):
    t = spark.createDataFrame([("AUTOMOBILE", 10.0), ("BUILDING", 30.0), ("FURNITURE", 0.0), ("MACHINERY", 60.0)], "category string, target double")
    return calibration.reweighted(persons(spark, d), t, "SEX").select("person_id", F.round("weight", 9).alias("weight"))


@query(f"""WITH {PERSONS}, pw AS (SELECT person_id, greatest("PINCP", 0) AS w FROM persons), {slices_sql('sl', 'pw', '', 'person_id', 'w')},
  k AS (SELECT range AS draw_id FROM range((SELECT count(*) FROM persons)))
  SELECT draw_id, item AS person_id FROM k JOIN sl ON {uniform(6, 'draw_id')} >= lo AND {uniform(6, 'draw_id')} < hi""")
def alc6_resample(spark, d):
    return calibration.resampled(persons(spark, d).withColumn("weight", F.greatest("PINCP", F.lit(0.0))), "person_id", seed=6).select("draw_id", "person_id")


@query(f"""WITH {PERSONS}, pr AS (SELECT puma, count(*)::DOUBLE AS weight FROM persons GROUP BY 1), {slices_sql('sl', 'pr', '', 'puma', 'weight')},
  k AS (SELECT range AS sample_id FROM range((SELECT count(*) FROM persons))) SELECT sample_id, item AS puma FROM k JOIN sl ON {uniform(7, 'sample_id')} >= lo AND {uniform(7, 'sample_id')} < hi""")
def alc7_group_draw(spark, d):
    p = persons(spark, d)
    prior = p.groupBy("puma").agg(F.count("*").cast("double").alias("weight"))
    return allocation.draw_groups(spark, p.count(), prior, "puma", "weight", seed=7)


@query(f"""WITH {PERSONS}, pr AS (SELECT puma, count(*)::DOUBLE AS weight FROM persons GROUP BY 1), {slices_sql('gs', 'pr', '', 'puma', 'weight')}, {slices_sql('ss', 'persons', 'puma', 'person_id', '1')},
  k AS (SELECT range AS sample_id FROM range((SELECT count(*) FROM persons))), g AS (SELECT sample_id, item AS puma FROM k JOIN gs ON {uniform(8, 'sample_id')} >= lo AND {uniform(8, 'sample_id')} < hi)
  SELECT sample_id AS person_id, g.puma, ss.item AS seed_id, p."AGEP", p."PINCP", p."SEX" FROM g JOIN ss ON g.puma = ss.g AND {uniform(9, 'sample_id')} >= ss.lo AND {uniform(9, 'sample_id')} < ss.hi JOIN persons p ON p.person_id = ss.item""")
def alc8_synthesize(spark, d):
    p = persons(spark, d).withColumnRenamed("person_id", "seed_id")
    prior = p.groupBy("puma").agg(F.count("*").cast("double").alias("weight"))
    return microdata.synthesized(p, prior, p.count(), seed=8)


@query(f"""WITH {PERSONS}, {SUPPLIERS}, {slices_sql('sl', 'bld', 'puma', 'bldg_id', '1')}, k AS (SELECT person_id, puma, unnest([1, 2, 3]) AS candidate FROM persons)
  SELECT k.person_id, k.puma, k.candidate, s.item AS bldg_id FROM k LEFT JOIN sl s ON k.puma = s.g AND {uniform(5, 'k.person_id', 'k.candidate')} >= s.lo AND {uniform(5, 'k.person_id', 'k.candidate')} < s.hi""")
def ext19_candidate_buildings(spark, d):
    return allocation.candidates(persons(spark, d), suppliers(spark, d), 3, "person_id", "puma", "bldg_id", seed=5)


@query(f"""WITH {PERSONS}, {SUPPLIERS}, st AS (SELECT stddev_pop(price) AS s FROM bld)
  SELECT person_id, arg_min(bldg_id, lpad((round((("PINCP" - price) / s) ** 2, 9) * 1000000000)::BIGINT::VARCHAR, 20, '0') || lpad(bldg_id::VARCHAR, 12, '0')) AS bldg_id FROM persons p JOIN bld b ON p.puma = b.puma, st GROUP BY person_id""")
def ext20_nearest_building(spark, d):
    return allocation.nearest_building(persons(spark, d), suppliers(spark, d), "person_id", "bldg_id", "puma", {"PINCP": "price"})


@query(f"WITH {PERSONS} SELECT person_id FROM persons ORDER BY {uniform(11, 'person_id')}, person_id LIMIT 100")
def srt3_subsample(spark, d):
    return allocation.subsample(persons(spark, d), 100, "person_id", seed=11).select("person_id")


@query(f"WITH {PARTS} SELECT bldg_id, footprint_area_m2 FROM prt ORDER BY footprint_area_m2 DESC, bldg_id LIMIT 50")
def srt1_top_capacity(spark, d):
    return portrait.top_by(parts(spark, d), 50, "footprint_area_m2", "bldg_id").select("bldg_id", "footprint_area_m2")


flagship = agg15_building_portrait
