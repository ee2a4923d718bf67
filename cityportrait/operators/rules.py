"""Rules over rows and over groups of rows, and repair of rows by the fewest fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from cityportrait.functions import expr
from cityportrait.functions.checks import require_columns
from cityportrait.operators import allocation
from cityportrait.operators.lineage import settled


@dataclass(frozen=True)
class Rule:
    """What must not hold, as SQL: of a row, or with `per` of all rows that share a key, then out of aggregates."""

    rule_id: str
    message: str
    predicate: str
    per: str | None = None


def _known(df: DataFrame, rule: Rule) -> bool:
    """Whether the table has the columns that the rule names; analysis only, no job."""
    if rule.per is not None and rule.per not in df.columns:
        return False
    try:
        df.groupBy(rule.per).agg(F.expr(rule.predicate)) if rule.per else df.select(F.expr(rule.predicate))
    except AnalysisException as e:
        if "UNRESOLVED_COLUMN" in (e.getCondition() or ""):
            return False
        raise
    return True


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, message, count): rows, or groups, that break each rule; null where the table lacks a rule's columns.

    Rules over groups of one key share one grouping, and rules over rows are counted inside it, so all rules of a key
    cost one scan and one shuffle. Rows without the key are in no group; an unknown (null) outcome breaks no rule.
    """
    known = [_known(df, r) for r in rules]
    broken = lambda r: F.coalesce(F.expr(r.predicate), F.lit(False))
    of_rows = [(i, r) for i, r in enumerate(rules) if known[i] and r.per is None]
    keys = list(dict.fromkeys(r.per for i, r in enumerate(rules) if known[i] and r.per is not None))
    parts = []
    for k, key in enumerate(keys or [None]):
        here = [(i, r) for i, r in enumerate(rules) if known[i] and r.per == key and key is not None]
        rows = of_rows if k == 0 else []
        if not here and not rows:
            continue
        if key is None:
            sums = df.agg(*[F.count_if(broken(r)).alias(f"_{i}") for i, r in rows])
        else:
            own = df.groupBy(key).agg(*[F.count_if(broken(r)).alias(f"_{i}") for i, r in rows], *[(broken(r) & F.col(key).isNotNull()).alias(f"_{i}") for i, r in here])
            sums = own.agg(*[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i, _ in rows], *[F.count_if(f"_{i}").alias(f"_{i}") for i, _ in here])
        parts.append(sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_{i}").cast("long").alias("count")) for i, _ in [*rows, *here]])).alias("x")).select("x.*"))
    told = df.sparkSession.createDataFrame([(i, r.rule_id, r.message) for i, r in enumerate(rules)], "n int, rule_id string, message string")
    counts = parts[0] if parts else df.sparkSession.createDataFrame([], "i int, count long")
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return told.join(counts, F.col("n") == F.col("i"), "left").select("rule_id", "message", "count")


MOST_FIELDS, MOST_RULES = 16, 62


def _uses(df: DataFrame, predicate: str, fields: Sequence[str]) -> list[int]:
    """The places of the fields that a predicate names: without one of them it can't be analysed."""
    out = []
    for i, f in enumerate(fields):
        try:
            df.drop(f).select(F.expr(predicate))
        except AnalysisException:
            out.append(i)
    return out


def repaired_fewest(df: DataFrame, donors: DataFrame, rules: dict[str, str], fields: Sequence[str], group: str, key: str, seed: int = 0) -> DataFrame:
    """The rows with broken rules mended by as few of the fields as will do; adds `changed`, the fields' names.

    A set of fields can mend a row only if it has a field of every rule that the row breaks (rules and fields are bit
    masks). Sets are tried by size, then in the order of the fields: each draws one valid donor of the row's group and
    takes the set's fields of it, and the first set of that size after which no rule is broken, new ones included, is
    used. All sets of a size are tried at once, so there is a round for each size, over the rows that are left. A row
    that no set mends stays as it is, as do rows of groups without a valid donor. `key` tells the rows apart.
    """
    fields = list(fields)
    require_columns(df, [group, key, *fields], "rows")
    if len(fields) > MOST_FIELDS or len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_FIELDS} fields and {MOST_RULES} rules")
    uses = [_uses(df, p, fields) for p in rules.values()]
    broken = [F.coalesce(F.expr(p), F.lit(False)) for p in rules.values()]
    mask: Column = F.lit(0).cast("long")
    for i, b in enumerate(broken):
        mask = mask + F.when(b, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    good = settled(donors.filter((mask == 0) & F.col(group).isNotNull()).select(F.col(key).alias("_donor"), group, *[F.col(f).alias(f"_new_{f}") for f in fields]))
    slices = settled(allocation.weight_slices(good, [group], "_donor", F.lit(1.0)))
    values = good.drop(group)
    masked = df.withColumn("_broken", mask)
    left = settled(masked.filter("_broken <> 0"))
    mended = []
    for size in range(1, len(fields) + 1):
        if left.isEmpty():
            break
        sets = []
        for rank, places in enumerate(combinations(range(len(fields)), size)):
            hits = sum(1 << i for i, u in enumerate(uses) if set(u) & set(places))
            sets.append(F.struct(F.lit(sum(1 << p for p in places)).alias("fields"), F.lit(rank).alias("rank"), F.lit(hits).cast("long").alias("hits")))
        able = F.filter(F.array(*sets), lambda s: s["hits"].bitwiseAND(F.col("_broken")) == F.col("_broken"))
        tried = left.withColumn("_set", F.explode(able)).withColumn("_u", expr.hash_uniform(seed, key, F.col("_set.fields")))
        tried = allocation.draw(tried, slices, [group], "_donor", "_u").join(values, "_donor")
        taken = lambda i: F.col("_set.fields").bitwiseAND(1 << i) != 0
        new = tried.select(*[F.when(taken(fields.index(c)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns], "_set")
        best = new.filter(mask == 0).groupBy(F.col(key).alias("_of")).agg(F.min_by(F.struct(*df.columns, "_set"), F.col("_set.rank")).alias("_b"))
        best = settled(best)
        named = F.filter(F.array(*[F.when(F.col("_b._set.fields").bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(fields)]), lambda x: x.isNotNull())
        mended.append(best.select(*[F.col(f"_b.{c}").alias(c) for c in df.columns], named.alias("changed")))
        left = settled(left.join(best.select("_of"), F.col(key) == F.col("_of"), "left_anti"))
    none = F.array().cast("array<string>").alias("changed")
    out = masked.filter("_broken = 0").select(*df.columns, none).unionByName(left.select(*df.columns, none))
    for m in mended:
        out = out.unionByName(m)
    return out
