"""Scans with explicit schemas. Only the columns an operator names are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cityportrait.functions import expr, geo
from cityportrait.functions.checks import first_present, require_columns
from cityportrait.sources import features

PARCEL = "type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>"
PARCEL_IDS = ["parcel_id", "parcelnum", "parcel_num", "parcelno", "pin", "objectid"]
PARCEL_VALUES = ["assessed_value", "assessedvalue", "amt_assessed_value", "total_assessed_value", "sev"]


def _csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows of CSV files in file order: by file name, and within a file by place.

    Rows are counted by split, for one file first and then for twice as many at a time, until there are n; later
    files are not read. Whole splits before the last one are taken as they are, of the last one its first rows.
    """
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    taken: list[str] = []
    counts: list = []
    step = 1
    while len(taken) < len(names) and sum(r["n"] for r in counts) < n:
        more = names[len(taken) : len(taken) + step]
        taken, step = taken + more, 2 * step
        counts += _csv(spark, more).select(*split).groupBy("_file", "_block").agg(F.count("*").alias("n")).collect()
    d = _csv(spark, taken or names)
    before = 0
    for r in sorted(counts, key=lambda r: (r["_file"], r["_block"])):
        if before + r["n"] > n:
            own = d.filter((split[0] == r["_file"]) & (split[1] == r["_block"]))
            whole = d.filter((split[0] < r["_file"]) | ((split[0] == r["_file"]) & (split[1] < r["_block"])))
            return whole.unionByName(own.orderBy(F.monotonically_increasing_id()).limit(n - before))
        before += r["n"]
    return d


def persons(spark: SparkSession, path: str, columns: list[str], n_rows: int | None = None) -> DataFrame:
    """Person microdata as text columns; with n_rows the first rows in file order."""
    d = first_rows(spark, path, n_rows) if n_rows else _csv(spark, path)
    return require_columns(d, columns, "persons").select(*columns)


def census(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A wide census table (also gzip), with tract_geoid where state, county and tract are there.

    With `table` only its estimate cells and the area codes are read.
    """
    d = _csv(spark, path)
    if table:
        d = d.select(*[c for c in d.columns if c in ("state", "county", "tract") or (c.startswith(f"{table}_") and c.endswith("E"))])
    return d.withColumn("tract_geoid", expr.geoid("state", "county", "tract")) if {"state", "county", "tract"} <= set(d.columns) else d


def buildings(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    d = spark.read.parquet(path) if path.endswith(".parquet") else _csv(spark, path)
    d = require_columns(d, needed, "buildings")
    return d.withColumn("puma", expr.area_code("puma")) if "puma" in d.columns else d


def parcels(spark: SparkSession, folder: str, pattern: str = "parcels_offset*.geojson", one_task_bytes: int = features.ONE_TASK_BYTES) -> DataFrame:
    """(parcel_id, assessed_value, part, ring) of GeoJSON files, in degrees; empty chunks give no rows.

    Files beyond one_task_bytes are read by many tasks.
    """
    f = features.features(spark, folder, pattern, PARCEL, one_task_bytes).select(F.col("properties").alias("p"), F.col("geometry").alias("g"))
    low = F.transform_keys("p", lambda k, v: F.lower(k))
    f = f.withColumn("p", low)
    pick = lambda names: F.coalesce(*[F.try_element_at("p", F.lit(n)) for n in names])
    polygon = F.from_json("g.coordinates", "array<array<array<double>>>")
    multi = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("g.type") == "Polygon", polygon).when(F.col("g.type") == "MultiPolygon", F.flatten(multi))
    d = f.select(pick(PARCEL_IDS).alias("parcel_id"), expr.non_negative(pick(PARCEL_VALUES)).alias("assessed_value"), F.posexplode(rings).alias("part", "_r"))
    def corner(p):
        lon, lat = geo.degrees(p[0], p[1])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return d.select("parcel_id", "assessed_value", "part", F.transform("_r", corner).alias("ring"))


def areas(spark: SparkSession, path: str) -> DataFrame:
    """A ring table (area_id, name, part, is_hole, ring) in Parquet or newline-delimited JSON."""
    schema = "area_id string, name string, part int, is_hole boolean, ring array<struct<x:double,y:double>>"
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(schema).json(path)


def marginals(spark: SparkSession, path: str, group: str) -> DataFrame:
    d = spark.read.parquet(path) if path.endswith(".parquet") else _csv(spark, path)
    return require_columns(d, [group, "variable", "category", "target"], "marginals").withColumn("target", expr.non_negative("target"))


def portraits(spark: SparkSession, path: str) -> DataFrame:
    """Portraits with numbers read as numbers; rows without coordinates go."""
    d = spark.read.parquet(path) if path.endswith(".parquet") else _csv(spark, path)
    lon, lat = first_present(d, ["centroid_lon", "lon"]), first_present(d, ["centroid_lat", "lat"])
    numeric = [c for c in ("pop_count", "age_p50", "income_p50", "price_tier", "price_per_sqft", lon, lat) if c in d.columns]
    return d.withColumns({c: expr.number(c) for c in numeric}).dropna(subset=[lon, lat])


def encoder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
