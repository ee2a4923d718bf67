"""Stand-in tables of the registered queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("puma"), F.col("c_acctbal").alias("PINCP"),
        F.col("c_mktsegment").alias("SEX"), (F.col("c_custkey") * 37 % 100).alias("AGEP"),
    )


PERSONS = 'persons AS (SELECT c_custkey AS person_id, c_nationkey AS puma, c_acctbal AS "PINCP", c_mktsegment AS "SEX", (c_custkey * 37) % 100 AS "AGEP" FROM customer)'


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("bldg_id"), F.col("s_nationkey").alias("puma"), F.col("s_acctbal").alias("cap_proxy"), F.col("s_acctbal").alias("price"))


SUPPLIERS = "bld AS (SELECT s_suppkey AS bldg_id, s_nationkey AS puma, s_acctbal AS cap_proxy, s_acctbal AS price FROM supplier)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("bldg_id"), F.col("p_brand").alias("puma"), F.col("p_type").alias("parcel_id"), F.col("p_size").cast("double").alias("footprint_area_m2"),
        F.col("p_retailprice").alias("value"), (F.col("p_partkey") % 7).cast("double").alias("height_m"),
        (F.col("p_partkey") * 7919 % 10007 / 1000.0).cast("double").alias("x"), (F.col("p_partkey") * 104729 % 10009 / 1000.0).cast("double").alias("y"),
    )


PARTS = (
    "prt AS (SELECT p_partkey AS bldg_id, p_brand AS puma, p_type AS parcel_id, p_size::DOUBLE AS footprint_area_m2, p_retailprice AS value, "
    "(p_partkey % 7)::DOUBLE AS height_m, (p_partkey * 7919 % 10007)::DOUBLE / 1000.0::DOUBLE AS x, (p_partkey * 104729 % 10009)::DOUBLE / 1000.0::DOUBLE AS y FROM part)"
)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("caid"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("area"), F.col("value").alias("dwell"), "event_id")


VISITS = "vis AS (SELECT user_id AS caid, ts, event_type AS area, value AS dwell, event_id FROM events)"


def uniform(seed: int, *keys: str) -> str:
    text = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def slices_sql(name: str, source: str, group: str, item: str, weight: str) -> str:
    """CTEs that end in `name`(group, item, lo, hi)."""
    g = group or "1"
    return f"""
      {name}_a AS (SELECT {g} AS g, {item} AS item, greatest(coalesce(({weight})::DOUBLE, 0), 0) AS w, substr(md5(({item})::VARCHAR), 1, 4) AS b FROM {source}),
      {name}_b AS (SELECT g, item, b, CASE WHEN sum(w) OVER (PARTITION BY g) > 0 THEN w ELSE 1.0 END AS w FROM {name}_a),
      {name}_c AS (SELECT g, item, w, sum(w) OVER (PARTITION BY g ORDER BY b, item ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY g) AS total,
                          row_number() OVER (PARTITION BY g ORDER BY b DESC, item DESC) AS back FROM {name}_b WHERE w > 0),
      {name} AS (SELECT g, item, (run - w) / total AS lo, CASE WHEN back = 1 THEN 1.0 ELSE run / total END AS hi FROM {name}_c)"""


def tier_sql(name: str, source: str, group: str | None, value: str, key: str, q: int) -> str:
    """CTE `name`: source.*, price_tier."""
    g = group or "'all'"
    probs = "[" + ", ".join(f"{i / q}" for i in range(q + 1)) + "]"
    return f"""
      {name}_v AS (SELECT *, {g} AS tg, greatest(coalesce(({value})::DOUBLE, 0), 0) AS tv FROM {source}),
      {name}_e AS (SELECT tg, list_distinct(list_transform(quantile_cont(tv, {probs}), lambda x: round(x, 9))) AS e0 FROM {name}_v WHERE tg IS NOT NULL GROUP BY tg),
      {name}_r AS (SELECT {name}_v.*, list_sort(e0) AS e, (rank() OVER (PARTITION BY {name}_v.tg ORDER BY tv) + (count(*) OVER (PARTITION BY {name}_v.tg, tv) - 1) / 2.0) / count(*) OVER (PARTITION BY {name}_v.tg) AS pr
                    FROM {name}_v LEFT JOIN {name}_e ON {name}_v.tg = {name}_e.tg),
      {name} AS (SELECT * EXCLUDE (tg, tv, e, pr), CASE WHEN tg IS NULL THEN 1
                   WHEN len(e) <= 1 THEN round_even(least(greatest(pr * {q}, 1), {q}), 0)::INTEGER
                   WHEN len(e) - 1 = {q} THEN least(1 + len(list_filter(e[2:], lambda x: x < round(tv, 9))), {q})::INTEGER
                   ELSE least(ceil((1 + len(list_filter(e[2:], lambda x: x < round(tv, 9)))) / (len(e) - 1)::DOUBLE * {q}), {q})::INTEGER END AS price_tier FROM {name}_r)"""
