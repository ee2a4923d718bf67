"""Queries of geometry, buildings, microdata, visits and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cityportrait.functions import expr, geo
from cityportrait.operators import buildings, microdata, mobility, portrait, spatial
from cityportrait.plans.common import PARTS, PERSONS, VISITS, parts, persons, suppliers, table, visits
from cityportrait.sources import sinks

Q, S = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


#: Areas of the stand-in plane: a concave one with a hole, and two others.
AREAS = [
    ("A", 0, False, [(1, 1), (6, 1), (6, 6), (3.5, 3), (1, 6)]),
    ("A", 0, True, [(2, 1.5), (3, 1.5), (3, 2.5), (2, 2.5)]),
    ("B", 0, False, [(7, 2), (9.5, 4), (8, 9), (6.5, 7)]),
    ("C", 0, False, [(0.2, 7), (5, 7.5), (4, 9.8)]),
]


def areas(spark: SparkSession) -> DataFrame:
    rows = [(a, a, p, h, [(float(x), float(y)) for x, y in ring]) for a, p, h, ring in AREAS]
    return spark.createDataFrame(rows, "area_id string, name string, part int, is_hole boolean, ring array<struct<x:double,y:double>>")


def _edges_sql() -> str:
    rows = []
    for a, _, hole, ring in AREAS:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            rows.append(f"('{a}', {str(hole).lower()}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return f"edges(area_id, hole, x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


_PIP = f"""WITH {PARTS}, {_edges_sql()}, hit AS (SELECT bldg_id, area_id FROM prt JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(_PIP + " SELECT prt.bldg_id, hit.area_id FROM prt LEFT JOIN hit ON prt.bldg_id = hit.bldg_id")
def joi1_point_in_polygon(spark, d):
    return spatial.points_in_areas(parts(spark, d), areas(spark), "bldg_id", how="left")


@query(_PIP + " SELECT area_id, arg_max(prt.bldg_id, lpad((value * 100)::BIGINT::VARCHAR, 15, '0') || lpad((100000000 - prt.bldg_id)::VARCHAR, 12, '0')) AS bldg_id FROM prt JOIN hit ON prt.bldg_id = hit.bldg_id GROUP BY area_id")
def joi3_best_match(spark, d):
    hit = spatial.points_in_areas(parts(spark, d), areas(spark), "bldg_id").join(parts(spark, d).select("bldg_id", "value"), "bldg_id")
    return spatial.best_per_key(hit, "area_id", "value", "bldg_id").select("area_id", "bldg_id")


@query(_PIP + " SELECT DISTINCT prt.bldg_id, value FROM prt JOIN hit ON prt.bldg_id = hit.bldg_id WHERE area_id = 'B'")
def joi5_inside_city(spark, d):
    city = spatial.select_area(areas(spark), " b ")
    return spatial.inside_area(parts(spark, d), city, "bldg_id").select("bldg_id", "value")


@query(_PIP + " SELECT bldg_id, area_id FROM hit WHERE area_id IN ('A', 'C')")
def prj10_area_by_part_of_its_name(spark, d):
    """No area has this name, so those whose name contains it count."""
    named = areas(spark).withColumn("name", F.concat(F.when(F.col("area_id") == "B", "Town of ").otherwise("City of "), "area_id"))
    return spatial.points_in_areas(parts(spark, d), spatial.select_area(named, " CITY of"), "bldg_id")


def blocks(p: DataFrame) -> DataFrame:
    """The parts as rectangles around their places, areas of several parts by brand; flat ones are holes."""
    w, h = F.col("footprint_area_m2") / 20, (F.col("height_m") + 1) / 2
    corner = lambda i, j: F.struct((F.col("x") + w * i).alias("x"), (F.col("y") + h * j).alias("y"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    return p.select(F.col("puma").alias("area_id"), F.col("puma").alias("name"), F.col("bldg_id").cast("int").alias("part"), (F.col("height_m") == 0).alias("is_hole"), ring.alias("ring"))


@query(f"""WITH {PARTS}, s AS (SELECT puma AS area_id, x, y, CASE WHEN height_m = 0 THEN -1 ELSE 1 END * footprint_area_m2 / 10 * (height_m + 1) AS a FROM prt)
  SELECT area_id, round(sum(a), 6) AS area, round(sum(a * x) / sum(a), 6) AS x, round(sum(a * y) / sum(a), 6) AS y FROM s GROUP BY 1""")
def prj18_area_centroid(spark, d):
    c = spatial.area_centroids(blocks(parts(spark, d)))
    return c.select("area_id", F.round("area", 6).alias("area"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_K = "6378137.0::DOUBLE * pi() / 180"


@query(f"""WITH {PARTS}, p AS (SELECT bldg_id, -88 + x AS lon, 37 + y AS lat FROM prt), m AS (SELECT bldg_id, lon, lat, lon * {_K} AS mx, ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137.0::DOUBLE AS my FROM p)
  SELECT bldg_id, round(mx, 2) AS mx, round(my, 2) AS my, round(lon, 6) AS lon, round(lat, 6) AS lat, round(sqrt((mx - (-83.0458::DOUBLE) * {_K}) ** 2 + (my - ln(tan(pi() / 4 + 42.3314::DOUBLE * pi() / 360)) * 6378137.0::DOUBLE) ** 2) / 1000, 4) AS dist_km FROM m""")
def prj16_project_distance(spark, d):
    p = parts(spark, d).select("bldg_id", (F.col("x") - 88).alias("lon0"), (F.col("y") + 37).alias("lat0"))
    p = p.withColumns({"mx": geo.mercator_x(F.col("lon0")), "my": geo.mercator_y(F.col("lat0"))})
    return p.select(
        "bldg_id", F.round("mx", 2).alias("mx"), F.round("my", 2).alias("my"), F.round(geo.longitude(F.col("mx")), 6).alias("lon"), F.round(geo.latitude(F.col("my")), 6).alias("lat"),
        F.round(geo.distance_km(F.col("lon0"), F.col("lat0")), 4).alias("dist_km"),
    )


@query(f"""WITH {PARTS}, f AS (SELECT *, greatest(height_m / 3, 1) AS floors FROM prt)
  SELECT bldg_id, floors, footprint_area_m2 * floors AS cap_proxy, round(value / (footprint_area_m2 * 10.763910416709722::DOUBLE), 9) AS price_per_sqft FROM f""")
def prj14_building_features(spark, d):
    p = parts(spark, d).select("*", F.col("x").alias("centroid_lon"), F.col("y").alias("centroid_lat"), F.col("value").alias("assessed_value_alloc"))
    b = buildings.front_columns(buildings.features(p))
    return b.select("bldg_id", "floors", "cap_proxy", F.round(expr.price_per_sqft("assessed_value_alloc", "footprint_area_m2"), 9).alias("price_per_sqft"))


@query(f"WITH {PERSONS} SELECT person_id FROM persons WHERE puma IN (SELECT s_nationkey FROM supplier)")
def prj9_areas_with_buildings(spark, d):
    return microdata.with_buildings_only(persons(spark, d), suppliers(spark, d)).select("person_id")


_ENC = f"""WITH {PERSONS}, cl AS (SELECT person_id, puma::VARCHAR AS puma, "AGEP"::DOUBLE AS age, ln(1 + greatest("PINCP", 0)) AS lg, "SEX" FROM persons),
  st AS (SELECT avg(age) AS ma, stddev_pop(age) AS sa, avg(lg) AS ml, stddev_pop(lg) AS sl FROM cl)"""


def _encoder(spark, d):
    p = persons(spark, d).select("person_id", F.col("puma").cast("string").alias("puma"), F.col("AGEP").cast("double").alias("AGEP"), F.log1p(F.greatest("PINCP", F.lit(0.0))).alias("PINCP_log"), "SEX")
    return p, microdata.fitted(p, ["AGEP", "PINCP_log"], ["SEX"], "puma")


@query(_ENC + """ SELECT person_id, round((age - ma) / sa, 6) AS z_age, round((lg - ml) / sl, 6) AS z_income, (SELECT list_position(list_sort(list(DISTINCT "SEX")), cl."SEX") FROM cl c2) AS sex_at,
  (SELECT list_position(list_sort(list(DISTINCT puma)), cl.puma) FROM cl c3) AS group_at FROM cl, st""")
def enc_features(spark, d):
    p, e = _encoder(spark, d)
    v = microdata.encoded(p, e, ["AGEP", "PINCP_log"], ["SEX"], "puma", "person_id")
    return v.select(
        "person_id", F.round(F.col("features")[0], 6).alias("z_age"), F.round(F.col("features")[1], 6).alias("z_income"),
        F.array_position(F.slice("features", 3, 100), F.lit(1.0)).cast("int").alias("sex_at"), F.array_position("condition", F.lit(1.0)).cast("int").alias("group_at"),
    )


@query(f"""WITH {PERSONS} SELECT person_id, round("AGEP"::DOUBLE, 6) AS "AGEP", round(greatest("PINCP", 0), 4) AS "PINCP", "SEX", round(exp(1) / (exp(1) + (SELECT count(DISTINCT "SEX") FROM persons) - 1), 6) AS "SEX_confidence" FROM persons""")
def dec_records(spark, d):
    p, e = _encoder(spark, d)
    v = microdata.encoded(p, e, ["AGEP", "PINCP_log"], ["SEX"], "puma", "person_id")
    r = microdata.decoded(v, e, ["AGEP", "PINCP_log"], ["SEX"], "person_id")
    return r.select("person_id", F.round("AGEP", 6).alias("AGEP"), F.round("PINCP", 4).alias("PINCP"), "SEX", F.round("SEX_confidence", 6).alias("SEX_confidence"))


@query(f"""WITH {PERSONS} SELECT person_id, "AGEP"::DOUBLE AS "AGEP", greatest("PINCP", 0) AS "PINCP", round(ln(1 + greatest("PINCP", 0)), 9) AS "PINCP_log", (person_id % 2 + 1)::VARCHAR AS "SEX", puma::VARCHAR AS puma FROM persons WHERE person_id % 11 <> 0""")
def enc1_clean_microdata(spark, d):
    p = persons(spark, d).select("person_id", "AGEP", F.when(F.col("person_id") % 11 != 0, F.col("PINCP").cast("string")).otherwise("n/a").alias("PINCP"), (F.col("person_id") % 2 + 1).alias("SEX"), F.concat(F.lit("0"), F.col("puma").cast("string")).alias("PUMA"))
    c = microdata.cleaned(p.withColumnRenamed("PUMA", "area"), area="area")
    return c.select("person_id", "AGEP", "PINCP", F.round("PINCP_log", 9).alias("PINCP_log"), "SEX", "puma")


@query(f"WITH {VISITS} SELECT date_trunc('hour', ts) AS hour, area, ts < TIMESTAMP '2024-06-01' AS before_break, count(*) AS n FROM vis WHERE dwell >= 20 GROUP BY ALL")
def ext4_hourly_visits(spark, d):
    h = mobility.hourly_visits(visits(spark, d), "area", min_dwell=20.0)
    return h.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f"WITH {VISITS} SELECT strftime(ts, '%Y-%m') AS month, area, count(DISTINCT caid) AS devices FROM vis GROUP BY ALL")
def ext5_monthly_population(spark, d):
    return mobility.monthly_population(visits(spark, d), "area")


_HW = f"""{VISITS}, hm AS (SELECT caid, arg_min(area, event_id) AS home FROM vis GROUP BY 1), wk AS (SELECT caid, arg_max(area, event_id) AS work FROM vis GROUP BY 1),
  fl AS (SELECT home, work, count(DISTINCT caid) AS devices, count_if(home = work) AS at_home FROM hm JOIN wk USING (caid) GROUP BY ALL)"""


def _flow(spark, d):
    v = visits(spark, d)
    home = v.groupBy("caid").agg(F.min_by("area", "event_id").alias("h"))
    work = v.groupBy("caid").agg(F.max_by("area", "event_id").alias("w"))
    return mobility.flows(home, work, "caid", "h", "w")


@query(f"WITH {_HW} SELECT * FROM fl")
def ext6_home_work_flows(spark, d):
    return _flow(spark, d)


@query(f"""WITH {_HW}, j AS (SELECT devices / (sum(devices) OVER ())::DOUBLE AS p, (at_home + 3) / (sum(at_home + 3) OVER ())::DOUBLE AS q FROM fl)
  SELECT count(*) AS cells, round(sqrt(avg(((p - q) / (q + 1e-9)) ** 2)), 6) AS srmse, round(sum(abs(p - q)), 6) AS total_abs_error FROM j""")
def ext23_flow_errors(spark, d):
    f = _flow(spark, d)
    e = mobility.flow_errors(f, f.select("home", "work", (F.col("at_home") + 3).alias("target")))
    return e.select("cells", F.round("srmse", 6).alias("srmse"), F.round("total_abs_error", 6).alias("total_abs_error"))


@query(f"""WITH {VISITS} SELECT caid, count(*) AS visits, round(avg((area = 'click')::INTEGER), 6) AS share_click, round(avg((area = 'view')::INTEGER), 6) AS share_view,
  round(avg((dayofweek(ts) NOT IN (0, 6) AND hour(ts) BETWEEN 9 AND 16)::INTEGER), 6) AS weekday_daytime, round(avg((dayofweek(ts) IN (0, 6))::INTEGER), 6) AS weekend, count(DISTINCT area) AS areas FROM vis GROUP BY 1""")
def ext7_device_features(spark, d):
    f = mobility.device_features(visits(spark, d), "caid", "area", "area", ["click", "view"])
    return f.select("caid", "visits", "areas", *[F.round(c, 6).alias(c) for c in ("share_click", "share_view", "weekday_daytime", "weekend")])


_LL = f"""{VISITS}, ll AS (SELECT *, (event_id * 7919 % 1009) / 1009.0::DOUBLE - 83 AS lon, (event_id * 104729 % 997) / 997.0::DOUBLE + 42 AS lat FROM vis),
  ce AS (SELECT caid, avg(lon) AS clon, avg(lat) AS clat FROM ll WHERE dayofweek(ts) IN (0, 6) OR hour(ts) >= 18 OR hour(ts) < 6 GROUP BY 1)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(asin(sqrt(sin(radians({d} - {b}) / 2) ** 2 + cos(radians({b})) * cos(radians({d})) * sin(radians({c} - {a}) / 2) ** 2)) * 2 * 6371.0088::DOUBLE)"


def _placed(spark, d):
    v = visits(spark, d)
    return v.withColumns({"lon": F.col("event_id") * 7919 % 1009 / 1009.0 - 83, "lat": F.col("event_id") * 104729 % 997 / 997.0 + 42})


@query(f"WITH {_LL} SELECT ce.caid, round(any_value(clon), 6) AS centre_lon, round(any_value(clat), 6) AS centre_lat, round(sqrt(avg({_hav('lon', 'lat', 'clon', 'clat')} ** 2)), 5) AS radius_km FROM ll JOIN ce USING (caid) GROUP BY 1")
def ext8_activity_centres(spark, d):
    c = mobility.activity_centres(_placed(spark, d), "caid", "lon", "lat")
    return c.select("caid", F.round("centre_lon", 6).alias("centre_lon"), F.round("centre_lat", 6).alias("centre_lat"), F.round("radius_km", 5).alias("radius_km"))


@query(f"""WITH {_LL}, b AS (SELECT s_suppkey AS bldg_id, s_nationkey % 5 AS z, (s_suppkey % 10) / 10.0::DOUBLE - 83 AS blon, (s_suppkey % 7) / 7.0::DOUBLE + 42 AS blat FROM supplier),
  e AS (SELECT caid, bldg_id, exp(1 / (1 + {_hav('clon', 'clat', 'blon', 'blat')})) AS e FROM ce JOIN b ON caid % 5 = z) SELECT caid, bldg_id, round(e / sum(e) OVER (PARTITION BY caid), 8) AS score FROM e""")
def ext8_building_scores(spark, d):
    c = mobility.activity_centres(_placed(spark, d), "caid", "lon", "lat").withColumn("z", F.col("caid") % 5)
    b = suppliers(spark, d).select("bldg_id", (F.col("puma") % 5).cast("long").alias("z"), (F.col("bldg_id") % 10 / 10.0 - 83).alias("lon"), (F.col("bldg_id") % 7 / 7.0 + 42).alias("lat"))
    return mobility.building_scores(c, b, "caid", "z", digits=8)


@query(f"""WITH {VISITS}, s AS (SELECT caid * 100 + dayofmonth(ts) AS trip, caid % 3 AS od, event_id AS o, area AS w FROM vis), n AS (SELECT *, lead(w) OVER (PARTITION BY trip ORDER BY o) AS x FROM s),
  f AS (SELECT * FROM n WHERE x IS NOT NULL), c AS (SELECT od, w, x FROM f GROUP BY ALL HAVING count(*) >= 40), p AS (SELECT od, w FROM c GROUP BY ALL HAVING count(*) >= 2),
  g AS (SELECT f.od, trip, string_agg(f.w || ':' || x, '>' ORDER BY o) AS sig FROM f JOIN p ON f.od = p.od AND f.w = p.w GROUP BY ALL) SELECT od, count(DISTINCT sig) AS corridors, count(*) AS trips FROM g GROUP BY od""")
def ext12_corridors(spark, d):
    s = visits(spark, d).select((F.col("caid") * 100 + F.dayofmonth("ts")).alias("trip"), (F.col("caid") % 3).alias("od"), F.col("event_id").alias("o"), F.col("area").alias("w"))
    return mobility.corridors(s, "trip", "o", "w", "od", min_choice_count=40)


@query(f"""WITH {PARTS}, c AS (SELECT floor(x / 1.0::DOUBLE)::BIGINT AS cx, floor(y / 1.0::DOUBLE)::BIGINT AS cy, avg(value) AS v FROM prt GROUP BY ALL), m AS (SELECT avg(v) AS a, var_pop(v) AS s, count(*) AS n FROM c)
  SELECT any_value(n) AS cells, count(*) AS pairs, round(sum((p.v - a) * (q.v - a)) / (count(*) * any_value(s)), 6) AS moran FROM c p JOIN c q ON (p.cx = q.cx AND abs(p.cy - q.cy) = 1) OR (p.cy = q.cy AND abs(p.cx - q.cx) = 1), m""")
def ext10_morans_i(spark, d):
    return mobility.morans_i(parts(spark, d), "x", "y", "value", 1.0).withColumn("moran", F.round("moran", 6))


@query(f"WITH {PARTS} SELECT count(*) AS buildings, round(count_if(footprint_area_m2 <= height_m * 6) / count(*)::DOUBLE, 9) AS satisfied FROM prt")
def ext10_capacity_satisfaction(spark, d):
    p = parts(spark, d).select(F.col("footprint_area_m2").alias("pop_count"), (F.col("height_m") * 6).alias("cap_proxy"))
    return mobility.capacity_satisfaction(p).withColumn("satisfied", F.round("satisfied", 9))


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (s_suppkey % 10)::DOUBLE::VARCHAR || ',' || (s_suppkey % 7)::DOUBLE::VARCHAR || ']},"properties":{"bldg_id":' || s_suppkey::VARCHAR || CASE WHEN s_suppkey % 2 = 0 THEN ',"puma":' || s_nationkey::VARCHAR ELSE '' END || '}}' AS value FROM supplier WHERE s_suppkey % 5 <> 0""")
def snk5_geojson_features(spark, d):
    s = suppliers(spark, d).select("bldg_id", F.when(F.col("bldg_id") % 2 == 0, F.col("puma")).alias("puma"), F.when(F.col("bldg_id") % 5 != 0, F.col("bldg_id") % 10).alias("lon"), (F.col("bldg_id") % 7).alias("lat"))
    return sinks.feature(s, "lon", "lat", ["bldg_id", "puma"])


@query(f"WITH {PERSONS} SELECT person_id, puma, s_suppkey AS bldg_id, s_name FROM persons LEFT JOIN supplier ON s_suppkey = person_id")
def joi6_left_attributes(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_suppkey").alias("bldg_id"), "s_name")
    return portrait.with_attributes(persons(spark, d).select("person_id", "puma"), s, "person_id")


@query(_PIP + f""", tr AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 97) / 10.0::DOUBLE AS cx, (s_suppkey * 53 % 89) / 10.0::DOUBLE AS cy FROM supplier),
  t AS (SELECT bldg_id, max(lpad(id::VARCHAR, 6, '0')) AS tract_geoid FROM prt JOIN tr ON x >= cx - 0.5 AND x < cx + 0.5 AND y >= cy - 0.5 AND y < cy + 0.5 GROUP BY 1),
  h AS (SELECT bldg_id, max(ascii(area_id) - 64) AS puma FROM hit GROUP BY 1)
  SELECT prt.bldg_id, h.puma::VARCHAR AS puma, tract_geoid, footprint_area_m2, height_m, footprint_area_m2 * greatest(height_m / 3, 1) AS cap_proxy FROM prt JOIN h ON prt.bldg_id = h.bldg_id JOIN t ON prt.bldg_id = t.bldg_id""")
def building_feature_table(spark, d):
    p = parts(spark, d).select("bldg_id", "footprint_area_m2", "height_m", F.col("x").alias("centroid_lon"), F.col("y").alias("centroid_lat"))
    pumas = areas(spark).withColumn("area_id", (F.ascii("area_id") - 64).cast("string"))
    f = buildings.feature_table(p, pumas, _tracts(spark, d).withColumn("area_id", F.lpad(F.col("area_id").cast("string"), 6, "0")), areas(spark))
    return f.select("bldg_id", "puma", "tract_geoid", "footprint_area_m2", "height_m", "cap_proxy")


def _tracts(spark, d):
    """Overlapping unit squares, one a supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("area_id"), "s_acctbal", (F.col("s_suppkey") * 37 % 97 / 10.0).alias("cx"), (F.col("s_suppkey") * 53 % 89 / 10.0).alias("cy"))
    corner = lambda i, j: F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y"))
    return s.select("area_id", "s_acctbal", F.lit(False).alias("is_hole"), F.array(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5)).alias("ring"))


@query(f"""WITH {PARTS}, tr AS (SELECT s_suppkey AS parcel, s_acctbal, (s_suppkey * 37 % 97) / 10.0::DOUBLE AS cx, (s_suppkey * 53 % 89) / 10.0::DOUBLE AS cy FROM supplier)
  SELECT bldg_id, parcel, greatest(coalesce(s_acctbal, 0), 0)::DOUBLE AS parcel_assessed_value FROM prt LEFT JOIN tr ON x >= cx - 0.5 AND x < cx + 0.5 AND y >= cy - 0.5 AND y < cy + 0.5""")
def joi4_parcels_without_dedup(spark, d):
    """Overlapping parcels multiply a building's rows; buildings without a parcel stay."""
    parcels = _tracts(spark, d).withColumnsRenamed({"area_id": "parcel"}).withColumn("parcel_assessed_value", expr.non_negative("s_acctbal"))
    hit = spatial.points_in_areas(parts(spark, d), parcels, "bldg_id", "parcel", how="left", more=["parcel_assessed_value"])
    return hit.fillna(0.0, ["parcel_assessed_value"])


@query(f"""WITH {VISITS}, hm AS (SELECT caid, arg_min(area, event_id) AS home FROM vis GROUP BY 1), wk AS (SELECT caid, arg_max(area, event_id) AS work FROM vis GROUP BY 1)
  SELECT caid, home, work, home = work AS works_from_home FROM hm JOIN wk USING (caid)""")
def ext6_work_from_home(spark, d):
    v = visits(spark, d)
    home = v.groupBy("caid").agg(F.min_by("area", "event_id").alias("GEOHASH_5"))
    work = v.groupBy("caid").agg(F.max_by("area", "event_id").alias("GEO_HASH5"))
    return mobility.home_and_work(home, work, "caid")


@query(f"""WITH {PERSONS}, c AS (SELECT round(exp(1) / (exp(1) + (SELECT count(DISTINCT "SEX") FROM persons) - 1), 6) AS c FROM persons) SELECT count(*) AS n, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.1), 6) AS p10, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.9), 6) AS p90 FROM c""")
def dec4_confidence_summary(spark, d):
    p, e = _encoder(spark, d)
    r = microdata.decoded(microdata.encoded(p, e, ["AGEP", "PINCP_log"], ["SEX"], "puma", "person_id"), e, ["AGEP", "PINCP_log"], ["SEX"], "person_id")
    s = portrait.distribution(r, "SEX_confidence", "person_id")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "p10", "p50", "p90")])
