"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rows(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = False, order: list[str] | None = None, compression: str | None = None) -> None:
    """Parquet or CSV; an existing output is left as it is unless overwrite. With `order` the files follow these columns."""
    d = df.orderBy(*order) if order else df
    w = (d.write.option("compression", compression) if compression else d.write).mode("overwrite" if overwrite else "ignore")
    w.option("header", True).csv(path) if form == "csv" else w.parquet(path)


def feature(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One GeoJSON point feature a row, as text; rows without coordinates go, null properties are left out."""
    d = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    shape: Column = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return d.select(F.to_json(shape).alias("value"))


def geojson(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    feature(df, lon, lat, properties).write.mode("overwrite").text(path)


def metrics(tidy: DataFrame, path: str) -> None:
    """A tidy metrics table as newline-delimited JSON."""
    tidy.write.mode("overwrite").json(path)
