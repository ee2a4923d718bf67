"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document gets rule counts from its whole text. Rule failures are aggregated per host (the `source`
column), each host's rate is shrunk with a beta prior whose two parameters are fitted to all hosts by the
method of moments, hosts counting by their documents, and the verdict is joined back. A host is rejected if its shrunk rate lies above `max_rate`, or
above the prior's mean by more than `deviations` of its standard deviations. A document that fails a base rule is
rejected. On a rejected host a document is rejected as well if it fails a soft rule; a clean document stays wherever
it stands.

Cases: null and empty texts have no words and fail the base rule; a null source is one host of its own; repeated
rows each get a row; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cityportrait.llm.common import SPACE, hot_keys, small_or, spread_join, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SOFT = {"max_symbols_per_word": 0.5, "max_dup_line_share": 0.3, "min_mean_word": 2.0, "max_mean_word": 15.0}
MAX_RATE = 0.5
#: How far above the prior's mean a host's rate may lie, in standard deviations of the prior.
DEVIATIONS = 2.0
#: The prior counts at least as so many documents, so no host goes by a single one as long as a quarter fails at most.
LEAST_WEIGHT = 2.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(w: str, n: str) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Equal windows have equal hashes, so a text whose window hashes all differ has none. Otherwise the windows are
    sorted by their words: a window is repeated when it equals a neighbour.
    """
    return F.expr(f"""
      CASE WHEN {n} < 4 THEN 0L
           WHEN size(array_distinct(transform(sequence(0, {n} - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))))) = {n} - 2 THEN 0L
           ELSE cast(size(array_distinct(flatten(aggregate(
             array(sort_array(transform(sequence(0, {n} - 3), i -> struct(get({w}, i) AS a, get({w}, i + 1) AS b, get({w}, i + 2) AS c, i AS i)))),
             cast(array() AS array<array<int>>),
             (acc, s) -> transform(
               filter(transform(s, (x, j) -> struct(x.i AS i,
                   (j > 0 AND x.a = get(s, j - 1).a AND x.b = get(s, j - 1).b AND x.c = get(s, j - 1).c)
                   OR (j < size(s) - 1 AND x.a = get(s, j + 1).a AND x.b = get(s, j + 1).b AND x.c = get(s, j + 1).c) AS twice)),
                 y -> y.twice),
               y -> array(y.i, y.i + 1, y.i + 2)))))) AS bigint) END""")


def rule_counts(docs: DataFrame) -> DataFrame:
    """Add the five counts of COUNTS, base_failed and soft_failed to every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_w", words(F.col("text"))).withColumn("_n", F.size("_w"))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
        "n_repeat_words": _repeated_words("_w", "_n"),
    })
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (
        (F.col("n_symbols") > SOFT["max_symbols_per_word"] * F.col("n_words"))
        | (F.col("n_dup_lines") > SOFT["max_dup_line_share"] * F.col("_n_lines"))
        | (mean < SOFT["min_mean_word"])
        | (mean > SOFT["max_mean_word"])
    )
    return d.withColumns({"base_failed": base, "soft_failed": soft}).drop("_w", "_n", "_lines", "_n_lines")


def host_verdicts(counted: DataFrame, max_rate: float = MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """(source, host_rate, host_rejected), one row per host of a written table of counts.

    The beta prior's mean is the share of all documents that fail. Its weight follows from the correlation within
    hosts, the part of the hosts' spread that drawing so many documents from one rate would not give by itself, every
    host counting by its documents. Without any such correlation, or where it can't be told (one host, or hosts of one
    document each), rates are shrunk fully to the mean, so no host stands out.
    """
    hosts = written(
        counted.groupBy("source").agg(
            F.count("*").alias("n"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("f")
        )
    )
    k, n, f, squares, parts = hosts.select(F.count("*"), F.sum("n"), F.sum("f"), F.sum(F.col("n") * F.col("n").cast("double")), F.sum(F.col("f") * F.col("f").cast("double") / F.col("n"))).first()
    m = min(max(f / n if n else 0.0, 1e-3), 1 - 1e-3)
    spread, able = (parts - f * f / n, n - squares / n - (k - 1)) if n else (0.0, 0.0)
    within = (spread / (m * (1 - m)) - (k - 1)) / able if able > 1e-6 else 0.0
    if within > 1e-9:
        weight = max(1 / min(within, 1.0) - 1, LEAST_WEIGHT)
        rate = (F.col("f") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
        most = min(max_rate, m + deviations * math.sqrt(m * (1 - m) / (weight + 1)))
    else:
        rate, most = F.lit(m), max_rate
    return hosts.select("source", rate.alias("host_rate"), (rate > most).alias("host_rejected"))


def judged(counted: DataFrame, verdicts: DataFrame, max_broadcast_hosts: int = 100_000) -> DataFrame:
    """Join host verdicts back and add `kept`. Only rejected hosts are joined; beyond the bound the join shuffles, hot hosts in parts."""
    bad = verdicts.filter("host_rejected").select("source", F.lit(True).alias("_bad"))
    known, small = small_or(bad.withColumnRenamed("source", "_host"), max_broadcast_hosts)
    if small:
        d = counted.join(known, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    else:
        # drawn per row of a written table, so a task run again draws the same
        d = counted.withColumn("_deal", F.rand(0))
        d = spread_join(d, bad, ["source"], ["_deal"], hot_keys(counted.groupBy("source").count(), counted.count()), "left").drop("_deal")
    kept = ~F.col("base_failed") & ~(F.coalesce(F.col("_bad"), F.lit(False)) & F.col("soft_failed"))
    return d.withColumn("kept", kept).drop("_bad")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; texts are read once."""
    counted = written(rule_counts(docs.select("doc_id", "text", "source")).drop("text"))
    return judged(counted, host_verdicts(counted)).select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. They are written with their flags, so texts are counted once."""
    counted = rule_counts(docs.select(F.struct(*docs.columns).alias("row"), "text", "source"))
    counted = written(counted.select("row", "source", "base_failed", "soft_failed"))
    return judged(counted, host_verdicts(counted)).filter("kept").select("row.*")
