"""Visits, monthly populations and home-work pairs of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly_counts(events: DataFrame, area: str, ts: str = "ts", dwell: str = "dwell", min_dwell: float = 0.0, late: str = "2 hours") -> DataFrame:
    """(hour, area, n): windows of an hour; rows later than the watermark are dropped in append mode."""
    d = events.withColumn("_ts", F.col(ts).cast("timestamp")).filter(F.col(dwell) >= min_dwell).withWatermark("_ts", late)
    return d.groupBy(F.window("_ts", "1 hour"), F.col(area).alias("area")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "area", "n")


def write_hours(counts: DataFrame, path: str, checkpoint: str):
    """Append finished hours to Parquet, each once."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_population(homes: DataFrame, area: str, device: str = "caid", ts: str = "ts", late: str = "40 days") -> DataFrame:
    """(month, area, devices): distinct devices, as `mobility.monthly_population` counts them in a batch.

    A month is finished, and emitted once, when a row has come whose month ends more than `late` after it; rows of a
    finished month are dropped. State holds one entry for each device and area of the months that are open.
    """
    end = F.add_months(F.date_trunc("month", F.col(ts).cast("timestamp")), 1).cast("timestamp")
    d = homes.select(end.alias("_end"), F.col(area).alias("area"), F.col(device).alias("_device")).withWatermark("_end", late)
    # a missing device makes the area known without adding to it, as a distinct count does
    n = d.dropDuplicates(["_end", "area", "_device"]).groupBy("_end", "area").agg(F.count("_device").alias("devices"))
    return n.select(F.date_format(F.add_months("_end", -1), "yyyy-MM").alias("month"), "area", "devices")


def home_work_pairs(home: DataFrame, work: DataFrame, device: str, home_area: str, work_area: str, ts: str = "ts", within: str = "31 days", late: str = "2 days") -> DataFrame:
    """(device, month, home, work): every home of a month with the device's workplaces of that month, and either alone.

    Works on batches and on streams. On streams both sides have a watermark and times at most `within` apart, so a
    row that finds no partner is emitted with a null when none can come any more, and its state goes. Rows without a
    device are left out.
    """
    month = F.date_trunc("month", F.col(ts).cast("timestamp"))
    home, work = (d.filter(F.col(device).isNotNull()) for d in (home, work))
    h = home.select(F.col(device).alias("h_device"), F.col(home_area).alias("home"), month.alias("h_month"), F.col(ts).cast("timestamp").alias("h_ts")).withWatermark("h_ts", late)
    w = work.select(F.col(device).alias("w_device"), F.col(work_area).alias("work"), month.alias("w_month"), F.col(ts).cast("timestamp").alias("w_ts")).withWatermark("w_ts", late)
    on = F.expr(f"h_device = w_device AND h_month = w_month AND w_ts >= h_ts - INTERVAL {within} AND w_ts <= h_ts + INTERVAL {within}")
    j = h.join(w, on, "full_outer")
    return j.select(F.coalesce("h_device", "w_device").alias("device"), F.date_format(F.coalesce("h_month", "w_month"), "yyyy-MM").alias("month"), "home", "work")


def flows_of(pairs: DataFrame) -> DataFrame:
    """(month, home, work, devices, at_home) of finished pairs, as `mobility.flows` counts them."""
    d = pairs.filter(F.col("home").isNotNull() & F.col("work").isNotNull())
    return d.groupBy("month", "home", "work").agg(F.count_distinct("device").alias("devices"), F.count_distinct(F.when(F.col("home") == F.col("work"), F.col("device"))).alias("at_home"))


def write_rows(rows: DataFrame, path: str, checkpoint: str):
    """Append what is finished to Parquet, each row once."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
