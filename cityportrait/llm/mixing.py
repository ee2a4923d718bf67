"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources in code point order (null last) weigh WEIGHTS, repeating, and share the total size; a target stops
at MAX_EPOCHS times its source's size and the excess is shared again by weight.

Schedule: slot s has the golden-ratio point frac(s * phi). The point, mapped through the sources' cumulative slot
shares, names the slot's source; the slot's rank within its source names the block it takes. A source's documents,
in hashed order, form one stream of words cut into blocks of equal length; the stream starts again when it is used up.
The words a document gives are its overlaps with the blocks that slots took.

Cases: null and empty texts have size 0, a target share of none of their own, and give 0 words; a null source is a
source of its own; repeated rows are placed one after the other; an empty table gives an empty table; other columns
are ignored (or kept by mixed_documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cityportrait.llm.common import WORD, hot_keys, running_start, small_or, spread_join, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK_WORDS = 4096
#: Slots a source gets at least, where it has the words: bounds the error of a source's share.
MIN_SLOTS = 512
GOLDEN = 0.6180339887498949
SEED = 17
#: Slots meet the sources' intervals on cells: at least CELLS, and one for CELL_SLOTS slots.
CELLS, CELL_SLOTS = 1024, 4096
SLOT_CHUNK = 256
ROWS_PER_BUCKET = 20_000
MAX_BROADCAST_SOURCES = 50_000


def sizes(docs: DataFrame) -> DataFrame:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", n.cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight, target): one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    d = per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(MAX_EPOCHS)).alias("cap"))
    d = d.withColumn("_total", F.sum("source_size").over(W.partitionBy(F.lit(1))).cast("double")).withColumn("_w", F.sum("weight").over(W.partitionBy(F.lit(1))))
    before = W.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weigh = F.col("_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # in the order of cap by weight the capped sources come first
    d = d.withColumn("_capped", F.col("cap") * weigh <= F.col("weight") * left)
    every = W.partitionBy(F.lit(1))
    rest = (F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0.0)).over(every)) / F.nullif(
        F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).over(every), F.lit(0.0)
    )
    target = F.when(F.col("_capped"), F.col("cap")).otherwise(F.coalesce(F.col("weight") * rest, F.lit(0.0)))
    return d.select("source", "source_size", "weight", target.alias("target"))


def planned(goals: DataFrame) -> DataFrame:
    """Add each source's block length, number of blocks, and its interval [lo, hi) of slots."""
    length = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("target") / MIN_SLOTS))).cast("long")
    d = goals.withColumn("block_words", length)
    d = d.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    d = d.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    run = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("hi", F.sum("slots").over(run))
    return d.withColumn("lo", F.col("hi") - F.col("slots"))


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, source, rank, block): which block each slot takes. `plan` is a written table."""
    spark = plan.sparkSession
    # the last interval's end, not a new sum: sums taken in another order may differ in their last digit
    total = plan.agg(F.max("hi")).first()[0] or 0.0
    n = int(-(-total // 1))
    step = 1 << 20
    point = (F.floor(F.col("id") / step) * ((step * GOLDEN) % 1.0) + (F.col("id") % step) * GOLDEN) % 1.0
    slots = spark.range(n).select(F.col("id").alias("slot"), (point * total).alias("x"))
    width = max(total, 1.0) / max(CELLS, n // CELL_SLOTS)
    slots = slots.withColumn("cell", F.floor(F.col("x") / width))
    cells = plan.filter("slots > 0").select(
        "source", "n_blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("cell")
    )
    named = slots.join(cells, "cell").filter("x >= lo AND x < hi").select("slot", "source", "n_blocks", F.lit(1).cast("long").alias("one"))
    named = named.withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    ranked = running_start(named, ["source"], "chunk", ["slot"], "one", "rank")
    ranked = ranked.filter(F.col("rank") < MAX_EPOCHS * F.col("n_blocks"))
    return ranked.select("slot", "source", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    sized = written(sizes(docs))
    plan = written(planned(targets(sized)))
    rows = sized.count()
    bits = max(6, (max(rows, 1) // ROWS_PER_BUCKET).bit_length())
    h = F.xxhash64(F.lit(SEED), "doc_id")
    placed = sized.filter("size > 0").withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    # nothing has order within the hash but the id, then the size
    placed = running_start(placed, ["source"], "bucket", ["h", "doc_id", "size"], "size", "at").select("doc_id", "source", "size", "at")
    goals = plan.select("source", "source_size", "target", "block_words")
    known, small = small_or(goals.withColumnRenamed("source", "_s"), MAX_BROADCAST_SOURCES)
    hot = None if small else hot_keys(sized.groupBy("source").count(), rows)

    def with_goals(d: DataFrame) -> DataFrame:
        if small:
            return d.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return spread_join(d, goals, ["source"], ["doc_id", "size"], hot)

    placed = written(with_goals(placed))
    length = F.col("block_words")
    parts = placed.select(
        "*", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("size") - 1) / length))).alias("block")
    )
    overlap = F.least((F.col("block") + 1) * length, F.col("at") + F.col("size")) - F.greatest(F.col("block") * length, F.col("at"))
    parts = parts.withColumn("overlap", overlap)
    used = schedule(plan).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("times"))
    hit = parts.join(used, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    out = hit.groupBy("doc_id", "source", "size", "at", "source_size", "target").agg(
        F.sum(F.col("overlap") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")
    )
    none = with_goals(sized.filter("size = 0")).withColumn("taken", F.lit(0).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return out.select(*names).union(none.select(*names))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mixture takes them, with all columns.

    A document taken t of its n words stands floor(t / n) times, and once more if its hashed draw is below the rest.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "doc_id"), 11) / float(1 << 53)
    times = mix(docs).filter("taken > 0").select(F.col("doc_id").alias("__id"), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias("__times"))
    times = times.groupBy("__id").agg(F.max("__times").alias("__times")).filter("__times > 0")
    return docs.join(times, F.col("doc_id").eqNullSafe(F.col("__id"))).select(*docs.columns, F.explode(F.sequence(F.lit(1), "__times")).alias("__i")).drop("__i")
