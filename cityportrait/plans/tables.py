"""Queries that write a table with a sink and read it back with a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityportrait.functions import checks, expr
from cityportrait.operators.lineage import new_path
from cityportrait.plans.common import PARTS, PERSONS, SUPPLIERS, parts, persons, suppliers, table
from cityportrait.plans.places import blocks
from cityportrait.plans.validation import S as _VALIDATION, census_marginals
from cityportrait.sources import scans, sinks

Q, S = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


@query(f'WITH {PERSONS} SELECT person_id, "AGEP", "PINCP", "SEX", puma FROM persons')
def src1_persons_csv(spark, d):
    path = new_path(spark)
    sinks.rows(persons(spark, d), path, "csv", order=["person_id"])
    p = scans.persons(spark, path, ["person_id", "AGEP", "PINCP", "SEX", "puma"])
    return p.select(F.col("person_id").cast("long").alias("person_id"), F.col("AGEP").cast("long").alias("AGEP"), expr.number("PINCP").alias("PINCP"), "SEX", F.col("puma").cast("int").alias("puma"))


@query("""SELECT lpad(n_regionkey::VARCHAR, 2, '0') || lpad((n_nationkey % 7)::VARCHAR, 3, '0') || lpad(n_nationkey::VARCHAR, 6, '0') AS tract_geoid, count(c_custkey)::DOUBLE AS "B01001_002E"
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey""")
def src2_census_gzip(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    wide = n.groupBy(F.col("n_regionkey").alias("state"), (F.col("n_nationkey") % 7).alias("county"), F.col("n_nationkey").alias("tract")).agg(
        F.count("c_custkey").alias("B01001_002E"), F.lit("x").alias("B01001_002M"), F.count("*").alias("B19001_002E")
    )
    path = new_path(spark)
    sinks.rows(wide, path, "csv", compression="gzip")
    return scans.census(spark, path, "B01001").select("tract_geoid", expr.number("B01001_002E").alias("B01001_002E"))


@query(f"WITH {SUPPLIERS} SELECT bldg_id, puma::VARCHAR AS puma, price FROM bld")
def src3_buildings_parquet(spark, d):
    path = new_path(spark, ".parquet")
    sinks.rows(suppliers(spark, d).withColumn("puma", F.concat(F.lit(" 0"), F.col("puma").cast("string"))), path)
    return scans.buildings(spark, path, ["bldg_id", "puma", "price"]).select("bldg_id", "puma", "price")


@query(f"WITH {PARTS} SELECT bldg_id::VARCHAR AS parcel_id, value AS assessed_value, round(x, 6) AS x, round(y, 6) AS y, 4 AS corners FROM prt")
def src4_parcel_chunks(spark, d):
    """One chunk of features a parcel type; every chunk is a GeoJSON file of its own."""
    p = parts(spark, d)
    ring = F.array(*[F.array(F.col("x") + i, F.col("y") + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    f = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("bldg_id").cast("string").alias("PARCELNUM"), F.col("value").cast("string").alias("Assessed_Value")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    chunks = p.groupBy((F.col("bldg_id") % 64).alias("chunk")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(f).alias("features"))).alias("value"))
    path = new_path(spark)
    chunks.write.partitionBy("chunk").text(path)
    r = scans.parcels(spark, path, "part-*")
    return r.select("parcel_id", "assessed_value", F.round(F.col("ring")[0]["x"], 6).alias("x"), F.round(F.col("ring")[0]["y"], 6).alias("y"), F.size("ring").alias("corners"))


@query(f"WITH {PARTS} SELECT puma AS area_id, bldg_id::INTEGER AS part, height_m = 0 AS is_hole, round(x - footprint_area_m2 / 20, 6) AS x0, round(y + (height_m + 1) / 2, 6) AS y1 FROM prt")
def src5_area_rings(spark, d):
    path = new_path(spark, ".parquet")
    sinks.rows(blocks(parts(spark, d)), path)
    a = scans.areas(spark, path)
    return a.select("area_id", "part", "is_hole", F.round(F.col("ring")[0]["x"], 6).alias("x0"), F.round(F.col("ring")[2]["y"], 6).alias("y1"))


@query(f"SELECT puma, variable, category, target, table_id, acs_year FROM ({_VALIDATION['set2_marginals_union']})")
def src6_marginals_csv(spark, d):
    path = new_path(spark)
    sinks.rows(census_marginals(spark, d), path, "csv", order=["table_id", "puma", "variable", "category"])
    # an output that exists is left as it is
    sinks.rows(census_marginals(spark, d).limit(0), path, "csv")
    m = scans.marginals(spark, path, "puma")
    return m.select("puma", "variable", "category", "target", "table_id", F.col("acs_year").cast("int").alias("acs_year"))


@query(f"WITH {PARTS} SELECT bldg_id, footprint_area_m2 AS pop_count, value AS price_per_sqft, x AS centroid_lon, y AS centroid_lat FROM prt WHERE height_m > 0")
def src7_portraits_csv(spark, d):
    """Rows without coordinates go, here those of flat buildings."""
    p = parts(spark, d).select("bldg_id", F.col("footprint_area_m2").alias("pop_count"), F.col("value").alias("price_per_sqft"), F.when(F.col("height_m") > 0, F.col("x")).alias("centroid_lon"), F.col("y").alias("centroid_lat"))
    path = new_path(spark)
    sinks.rows(p, path, "csv")
    return scans.portraits(spark, path).select(F.col("bldg_id").cast("long").alias("bldg_id"), "pop_count", "price_per_sqft", "centroid_lon", "centroid_lat")


@query(f'WITH {PERSONS} SELECT round(avg("PINCP"), 6) AS mean, round(stddev_pop("PINCP"), 6) AS std, len(list(DISTINCT "SEX"))::INTEGER AS categories, min("SEX") AS first_category FROM persons')
def src8_encoder_json(spark, d):
    from cityportrait.operators import microdata

    e = microdata.fitted(persons(spark, d), ["PINCP"], ["SEX"], "puma").select("mean_PINCP", "std_PINCP", "cats_SEX")
    path = new_path(spark)
    sinks.metrics(e, path)
    r = scans.encoder(spark, path, "mean_PINCP double, std_PINCP double, cats_SEX array<string>")
    return r.select(F.round("mean_PINCP", 6).alias("mean"), F.round("std_PINCP", 6).alias("std"), F.size("cats_SEX").alias("categories"), F.col("cats_SEX")[0].alias("first_category"))


@query(f"WITH {PARTS} SELECT bldg_id, x AS lon, y AS lat, height_m FROM prt")
def snk5_geojson_file(spark, d):
    path = new_path(spark)
    sinks.geojson(parts(spark, d), path, "x", "y", ["bldg_id", "height_m"])
    f = spark.read.schema("type string, geometry struct<type: string, coordinates: array<double>>, properties struct<bldg_id: long, height_m: double>").json(path)
    return f.select("properties.bldg_id", F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"), "properties.height_m")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 2500")
def srt2_first_rows(spark, d):
    """The first rows of a table in six files, whose order is that of the keys."""
    path = new_path(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    o.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    p = scans.persons(spark, path, ["o_orderkey", "o_totalprice"], 2500)
    return p.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), expr.number("o_totalprice").alias("o_totalprice"))


@query(f"""WITH {PERSONS} SELECT puma, max("AGEP") AS oldest, 'persons lacks the columns [''ESR'', ''WAGP'']' AS refusal FROM persons GROUP BY puma""")
def prj1_required_columns(spark, d):
    p = checks.require_columns(persons(spark, d), ["puma", "AGEP"], "persons")
    try:
        checks.require_columns(p, ["AGEP", "ESR", "WAGP"], "persons")
        refusal = "none"
    except ValueError as e:
        refusal = str(e)
    return p.groupBy("puma").agg(F.max("AGEP").alias("oldest"), F.lit(refusal).alias("refusal"))


@query("SELECT p_partkey, p_retailprice AS value, p_size AS size FROM part")
def prj8_first_present_column(spark, d):
    p = table(spark, d, "part")
    value, size = checks.first_present(p, ["assessed_value", "P_RetailPrice", "p_size"]), checks.first_present(p, ["P_SIZE", "p_retailprice"])
    return p.select("p_partkey", F.col(value).alias("value"), F.col(size).alias("size"))


def _by_flag(spark, d, requested):
    l = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("variable")).agg(F.count("*").alias("n"))
    available = [r.variable for r in l.select("variable").distinct().collect()]
    scored, skipped = checks.split_requested(requested, available)
    asked = spark.createDataFrame([(v, i + 1, False) for i, v in enumerate(scored)] + [(v, i + 1, True) for i, v in enumerate(skipped)], "variable string, place int, skipped boolean")
    return asked.join(F.broadcast(l), "variable", "left").select("variable", "place", "skipped", "n")


@query("SELECT l_returnflag AS variable, row_number() OVER (ORDER BY l_returnflag)::INT AS place, false AS skipped, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def prj19_all_variables(spark, d):
    return _by_flag(spark, d, None)


@query("""WITH q(variable, i) AS (VALUES ('R', 1), ('X', 2), ('A', 3), ('Z', 4)), l AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT variable, (row_number() OVER (PARTITION BY n IS NULL ORDER BY i))::INT AS place, n IS NULL AS skipped, n FROM q LEFT JOIN l ON variable = l_returnflag""")
def set4_requested_minus_available(spark, d):
    return _by_flag(spark, d, ["R", "X", "A", "R", "Z"])
