"""Exact ranks, running sums and quantiles of groups that may hold most of all rows.

A plain window puts a group into one task. Here rows are first dealt to buckets that follow the order, sums per
(group, bucket) give each bucket's start, and only a bucket is windowed. A value that many rows share has buckets of
its own, which follow the tie key, so a constant column is spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Quantiles taken of a column, and the least number of buckets; the number grows with the rows up to CUTS.
CUTS, BUCKETS = 1024, 64
ROWS_PER_BUCKET = 1_000_000
WIDTH = 32


def renamed(df: DataFrame, names: list[str], prefix: str = "_k_") -> DataFrame:
    """Key columns under other names, so that a table can be joined to one it comes from."""
    return df.select(*[F.col(c).alias(prefix + c) if c in names else F.col(c) for c in df.columns])


def same(names: list[str], prefix: str = "_k_") -> Column:
    """Equal keys, nulls included."""
    on = F.col(names[0]).eqNullSafe(F.col(prefix + names[0]))
    for c in names[1:]:
        on = on & F.col(c).eqNullSafe(F.col(prefix + c))
    return on


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: str, before: str, total: str, after: str | None = None) -> DataFrame:
    """Add the sum of `value` over the group's rows before this one, and over all of them.

    `bucket` must not fall along `order`. With `after`, also the next row's `before` (the total for the last row), so
    that one row's end is exactly the next one's start.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_s"))
    w = W.partitionBy(*group)
    upto = w.orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sums.select(*group, bucket, (F.sum("_s").over(upto) - F.col("_s")).alias("_start"), F.sum("_s").over(w).alias("_total"))
    inside = W.partitionBy(*group, bucket).orderBy(*order)
    inner = df.withColumn("_run", F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value))
    told = [(F.col("_start") + F.col("_run")).alias(before), F.col("_total").alias(total)]
    if after:
        starts = starts.withColumn("_next", F.lead("_start").over(w.orderBy(bucket)))
        inner = inner.withColumn("_following", F.lead("_run").over(inside))
        told.append(F.coalesce(F.col("_start") + F.col("_following"), F.col("_next"), F.col("_total")).alias(after))
    joined = inner.join(renamed(starts, [*group, bucket]), same([*group, bucket]))
    return joined.select(*df.columns, *told)


def _number(df: DataFrame, column: str) -> Column:
    """A number that never falls as the column grows: the value itself, or a text's first six bytes."""
    if dict(df.dtypes)[column] in ("string", "date", "timestamp", "timestamp_ntz", "boolean", "binary"):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(column).cast("string"), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(column).cast("double")


def _place(cuts: list[float], v: str) -> str:
    """SQL of the number of cuts at or below v: first among every WIDTH-th cut, then among the WIDTH behind it."""
    if not cuts:
        return "0"
    array = lambda x: f"array({', '.join(f'{c!r}D' for c in x)})"
    if len(cuts) <= 2 * WIDTH:
        return f"size(filter({array(cuts)}, c -> c <= {v}))"
    coarse = f"size(filter({array(cuts[WIDTH - 1 :: WIDTH])}, c -> c <= {v}))"
    return f"{WIDTH} * {coarse} + size(filter(slice({array(cuts)}, {WIDTH} * {coarse} + 1, {WIDTH}), c -> c <= {v}))"


def _cuts(d: DataFrame, column: str, n: int) -> tuple[list[float], list[float]]:
    """The finite approximate quantiles of a column that deal n rows to buckets, and those that come more than once."""
    many = min(CUTS, max(BUCKETS, n // ROWS_PER_BUCKET + 1))
    found = d.agg(F.percentile_approx(column, [i / many for i in range(1, many)], 10 * many)).first()[0] or []
    found = [float(c) for c in found if c == c and abs(c) != float("inf")]
    return sorted(set(found)), sorted({x for x, y in zip(found, found[1:], strict=False) if x == y})


def with_bucket(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Add `_bucket`, which never falls along (value, tie); nulls come first.

    Cuts are approximate quantiles of the whole column. A row whose value is a cut shares its bucket with equal values
    only. A value that is a cut more than once has more rows than a bucket should, so these are dealt again by
    quantiles of the tie key; so are null values if there are as many. Only then is the tie key looked at.
    """
    d = df.select(_number(df, value).alias("v"), _number(df, tie).alias("t"))
    few = [i / BUCKETS for i in range(1, BUCKETS)]
    n, nulls, found = d.agg(F.count("*"), F.count_if(F.col("v").isNull()), F.percentile_approx("v", few, 10 * BUCKETS)).first()
    if n > BUCKETS * ROWS_PER_BUCKET:
        vs, heavy = _cuts(d, "v", n)
    else:
        found = [float(c) for c in (found or []) if c == c and abs(c) != float("inf")]
        vs, heavy = sorted(set(found)), sorted({x for x, y in zip(found, found[1:], strict=False) if x == y})
    again = F.col("v").isin(heavy) if heavy else F.lit(False)
    if nulls > n / BUCKETS:
        again = again | F.col("v").isNull()
    ts = _cuts(d.filter(again), "t", n)[0] if heavy or nulls > n / BUCKETS else []
    d = df.withColumns({"_bv": _number(df, value), "_bt": _number(df, tie)})
    at = F.expr(f"CASE WHEN _bv IS NULL THEN -1 ELSE 2 * ({_place(vs, '_bv')}) END")
    if vs:
        # odd where the value is a cut itself
        cut = F.array_contains(F.array(*[F.lit(c) for c in vs]), F.col("_bv"))
        at = at - F.when(F.col("_bv").isNotNull() & cut, 1).otherwise(0)
    bucket = at * CUTS
    if ts:
        bucket = bucket + F.when((F.col("_bv").isNull() | (F.col("_bv").isin(heavy) if heavy else F.lit(False))) & F.col("_bt").isNotNull(), F.expr(_place(ts, "_bt"))).otherwise(0)
    return d.withColumn("_bucket", bucket.cast("int")).drop("_bv", "_bt")


def placed(df: DataFrame, group: list[str], value: str, tie: str, rank: str = "rank", n: str = "n") -> DataFrame:
    """As `ranked`, with the bucket."""
    d = with_bucket(df, value, tie).withColumn("_one", F.lit(1).cast("long"))
    return running(d, group, "_bucket", [value, tie], "_one", rank, n).drop("_one")


def ranked(df: DataFrame, group: list[str], value: str, tie: str, rank: str = "rank", n: str = "n") -> DataFrame:
    """Add the 0-based place of each row in its group, by value and then by tie, and the group's size."""
    return placed(df, group, value, tie, rank, n).drop("_bucket")


def quantiles_of(r: DataFrame, group: list[str], value: str, probabilities: list[float], rank: str = "rank", n: str = "n") -> DataFrame:
    """(group, n, q) of a ranked table without null values."""
    picked = []
    for i, p in enumerate(probabilities):
        at = F.lit(p) * (F.col(n) - 1)
        picked += [
            F.max(F.when(F.col(rank) == F.floor(at), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when(F.col(rank) == F.ceil(at), F.col(value))).alias(f"_hi{i}"),
        ]
    d = r.groupBy(*group).agg(F.first(n).alias("n"), *picked)
    values = []
    for i, p in enumerate(probabilities):
        at = F.lit(p) * (F.col("n") - 1)
        values.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at)))
    return d.select(*group, "n", F.array(*values).alias("q"))


def quantiles(df: DataFrame, group: list[str], value: str, tie: str, probabilities: list[float]) -> DataFrame:
    """(group, n, q): exact quantiles with linear interpolation, an array per group. Nulls are left out."""
    r = ranked(df.filter(F.col(value).isNotNull()).select(*group, value, tie), group, value, tie)
    return quantiles_of(r, group, value, probabilities)


def average_places(r: DataFrame, group: list[str], value: str, rank: str, out: str) -> DataFrame:
    """Add the average place of the equal values of a placed table.

    Sums per bucket are added up and joined back per bucket, so a value that most rows share is no single join key.
    """
    per = r.groupBy(*group, value, "_bucket").agg(F.sum(rank).alias("_sum"), F.count("*").alias("_c"))
    whole = per.groupBy(*group, value).agg((F.sum("_sum") / F.sum("_c")).alias(out))
    mean = per.select(*group, value, "_bucket").join(renamed(whole, [*group, value]), same([*group, value])).select(*group, value, "_bucket", out)
    return r.join(renamed(mean, [*group, value, "_bucket"]), same([*group, value, "_bucket"])).select(*r.columns, out)


def percent_rank_average(df: DataFrame, group: list[str], value: str, tie: str, out: str = "percent_rank") -> DataFrame:
    """Add the average rank of equal values by the group's size."""
    r = average_places(placed(df, group, value, tie, "_rank", "_n"), group, value, "_rank", "_avg")
    return r.select(*df.columns, ((F.col("_avg") + 1) / F.col("_n")).alias(out))
