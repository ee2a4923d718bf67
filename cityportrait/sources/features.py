"""Large GeoJSON feature collections, read by many tasks.

Spark's text reader splits a file by bytes and ends its records at any separator. With } as the separator a record
holds a few opening braces and one closing one. Running sums along the file tell for each record whether it begins
inside a string (quotes before it) and how deep it lies (braces before it), and so where each feature ends: at the
brace that brings the depth back to that of the collection. Sums are two-level, by split and within it, so no task
reads more than its split. Any valid collection is read exactly: braces and quotes in strings, members before and
after the features, features in any layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cityportrait.operators import ranks
from cityportrait.operators.lineage import settled

#: Files up to this size are one task each.
ONE_TASK_BYTES = 64 << 20
#: Patterns on texts without escapes: strings, closed or cut off; the rest of a string that began before.
_STRING, _BEGUN = r'"[^"]*(?:"|$)', r'^[^"]*(?:"|$)'
#: What stands before an object's brace.
_BEFORE = r'^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+'


def _braces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def feature_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): the JSON of every object on the second level of the files, so of every feature of a collection.

    Other members with an object for a value (a crs) are objects on that level too; their type is not Feature.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    raw = settled(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"))
    bare = F.regexp_replace("value", r"\\.", "")
    d = raw.select("file", "block", "id", bare.alias("v"))
    outside = lambda v: _braces(F.regexp_replace(v, _STRING, ""))
    quotes = (F.length("v") - F.length(F.replace(F.col("v"), F.lit('"'), F.lit("")))).cast("long")
    d = settled(d.select("file", "block", "id", quotes.alias("q"), outside(F.col("v")).alias("b0"), outside(F.regexp_replace("v", _BEGUN, "")).alias("b1")))
    place = lambda d, value, out: ranks.running(d, ["file"], "block", ["id"], value, out, "_all").drop("_all")
    d = place(d, "q", "before")
    closed = (F.col("before") + F.col("q")) % 2 == 0
    d = d.withColumn("closed", closed).withColumn("delta", (F.when(F.col("before") % 2 == 0, F.col("b0")).otherwise(F.col("b1")) - F.col("closed").cast("int")).cast("long"))
    d = place(settled(d.select("file", "block", "id", "closed", "delta")), "delta", "depth")
    d = d.withColumn("end", (F.col("closed") & (F.col("depth") + F.col("delta") == 1)).cast("long"))
    d = place(settled(d.select("file", "block", "id", "end")), "end", "n").select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("id").alias("_i"), "n")
    parts = raw.join(d, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")) & (F.col("id") == F.col("_i")))
    whole = parts.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "id", "value"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    # the first one has the collection's own brace before it
    text = F.when(F.col("n") == 0, F.regexp_replace(text, _BEFORE + r"\{", "")).otherwise(text)
    return whole.select("file", F.regexp_replace(text, _BEFORE, "").alias("text")).filter(F.col("text").startswith("{"))


def features(spark: SparkSession, folder: str, pattern: str, schema: str, one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    """One row a feature, of the given schema, of all collections in a folder.

    Small files are a task each; larger ones are split. Only file lengths are asked for to tell them apart.
    """
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    large = [r.path for r in sizes.filter(F.col("length") > one_task_bytes).select("path").collect()]
    collection = f"type string, features array<struct<{schema}>>"
    # the JSON reader goes back into the file for every object that is read as a text, so texts are read first
    small = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    if large:
        # a file's length is in its metadata, so larger ones are not opened
        small = small.filter(F.col("_metadata.file_size") <= one_task_bytes)
    parsed = F.from_json(F.regexp_replace("value", "^\ufeff", ""), collection)
    out = small.select(F.explode(parsed["features"]).alias("f")).select("f.*")
    if not large:
        return out
    f = feature_texts(spark, large).select(F.from_json("text", f"struct<{schema}>").alias("f")).select("f.*")
    return out.unionByName(f.filter("type = 'Feature'"))
