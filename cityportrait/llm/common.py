"""Shared pieces: folders for written tables, running sums and joins over skewed groups, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import reduce
from operator import and_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cityportrait.operators.lineage import settled

#: White space of every word rule in this package (fixed values).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow, after sending this package to the executors."""
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)


def written(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    batch: rows of an Arrow batch meanwhile, where rows are large.
    """
    if batch is None:
        return settled(df)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(batch))
    try:
        return settled(df)
    finally:
        conf.set(key, before)


def small_or(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """A broadcast hint when a written table has at most max_rows rows; the flag tells whether it was given."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


#: A key with more rows than this, and than this part of all rows, is hot.
HOT_ROWS, HOT_PARTS = 1_000, 10_000


def hot_keys(counts: DataFrame, total: int) -> DataFrame:
    """(keys, _parts) of the hot keys of a table of `total` rows, from (keys, count); a part has as many rows as a key may.

    Each has more than total / HOT_PARTS rows, so there are fewer than HOT_PARTS, whatever the table.
    """
    most = max(HOT_ROWS, total // HOT_PARTS)
    return written(counts.filter(F.col("count") > most).withColumn("_parts", F.ceil(F.col("count") / most).cast("int")).drop("count"))


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join `many` to `few`, which has one row a key at most; null keys are equal.

    Rows with a hot key are dealt to the key's parts by a hash of `by`, and the key's row of `few` stands in each of
    them, so that no key is the work of one task.
    """
    keys = F.broadcast(hot.withColumnsRenamed({c: f"_hot_{c}" for c in on}))
    equal = lambda prefix: reduce(and_, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in on])
    dealt = many.join(keys, equal("_hot_"), "left").select(*many.columns, F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int").alias("_part"))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)).alias("_few_part")
    copied = few.join(keys, equal("_hot_"), "left").select(*[F.col(c).alias(f"_few_{c}") if c in on else F.col(c) for c in few.columns], parts)
    joined = dealt.join(copied, equal("_few_") & (F.col("_part") == F.col("_few_part")), how)
    return joined.select(*many.columns, *[c for c in few.columns if c not in on])


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one in its group, ordered by bucket, then order.

    Two levels, so that a group holding most rows is never one task: sums per bucket are added up per group
    (one row a bucket), then rows are added up inside their bucket.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sums.select(*group, bucket, (F.sum("_sum").over(over) - F.col("_sum")).alias("_start"))
    within = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = df.withColumn("_run", F.sum(value).over(within) - F.col(value))
    on = inner[bucket] == starts[bucket]
    for c in group:
        on = on & inner[c].eqNullSafe(starts[c])
    return inner.join(starts, on).select(*[inner[c] for c in df.columns], (F.col("_start") + F.col("_run")).alias(out))
