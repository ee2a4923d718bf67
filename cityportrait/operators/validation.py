"""Statistical validation: marginal distances, associations, rules, errors against targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cityportrait.functions import expr
from cityportrait.functions.checks import require_columns


def frequencies(df: DataFrame, column: str, drop_null: bool = False) -> DataFrame:
    """(category, n, share) of a column; a null is a category of its own unless dropped."""
    d = df.filter(F.col(column).isNotNull()) if drop_null else df
    n = d.groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    return n.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("_total")).alias("share"))


def long_form(df: DataFrame, group: str, variables: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """(group, variable, category, w): one row per row and variable. A missing category reads "nan"; a null group goes.

    All variables are stacked at once, so any number of them costs one scan and one shuffle.
    """
    pairs = [F.struct(F.lit(v).alias("variable"), F.coalesce(c.cast("string"), F.lit(expr.NO_BIN)).alias("category")) for v, c in variables.items()]
    d = df.filter(F.col(group).isNotNull())
    w = weight if weight is not None else F.lit(1.0)
    return d.select(F.col(group).cast("string").alias("group"), w.cast("double").alias("w"), F.explode(F.array(*pairs)).alias("_p")).select("group", "_p.variable", "_p.category", "w")


def standard_variables(df: DataFrame, employment: bool = False, bin_edges: dict[str, Sequence[float]] | None = None) -> dict[str, Column]:
    """The variables that the columns of a person table allow; `bin_edges` replaces the edges of AGEP or PINCP."""
    edges = {"AGEP": expr.AGE_EDGES, "PINCP": expr.INCOME_EDGES} | dict(bin_edges or {})
    out: dict[str, Column] = {}
    if "AGEP" in df.columns:
        out["AGEP_bin"] = expr.binned(expr.clipped("AGEP", 0.0, 99.0), edges["AGEP"])
    if "PINCP" in df.columns:
        out["PINCP_bin"] = expr.binned(expr.clipped("PINCP", 0.0), edges["PINCP"])
    for c in ("SEX", "ESR"):
        if c in df.columns:
            out[c] = F.col(c)
    if employment and {"AGEP", "ESR"} <= set(df.columns):
        out["ESR_16p"] = expr.employment_16p("AGEP", "ESR")
    return out


def shares(long: DataFrame, weight: str = "w") -> DataFrame:
    """(group, variable, category, n, p): p is the share within group and variable; groups without weight are left out."""
    n = long.groupBy("group", "variable", "category").agg(F.sum(weight).alias("n"))
    t = n.groupBy("group", "variable").agg(F.sum("n").alias("_t")).filter("_t > 0")
    return n.join(t, ["group", "variable"]).select("group", "variable", "category", "n", (F.col("n") / F.col("_t")).alias("p"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(group, variable, category, p, q) of two share tables: groups on both sides, missing categories 0."""
    on = ["group", "variable", "category"]
    both = left.select("group", "variable").distinct().intersect(right.select("group", "variable").distinct())
    j = left.select(*on, "p").join(right.select(*on, F.col("p").alias("q")), on, "full_outer")
    return j.join(both, ["group", "variable"], "left_semi").fillna(0.0, ["p", "q"])


def distances(pairs: DataFrame) -> DataFrame:
    """(group, variable, tvd): half the sum of absolute differences."""
    return pairs.groupBy("group", "variable").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tvd"))


def distance_summary(tvd: DataFrame) -> DataFrame:
    """(variable, groups, mean_tvd, max_tvd, worst_group); of equally bad groups the first."""
    return tvd.groupBy("variable").agg(
        F.count("*").alias("groups"), F.avg("tvd").alias("mean_tvd"), F.max("tvd").alias("max_tvd"),
        F.min_by("group", F.struct(-F.round("tvd", 12), F.col("group"))).alias("worst_group"),
    )


def marginal_distances(synthetic: DataFrame, reference: DataFrame, group: str = "puma", bin_edges: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Distances between two person tables for every variable both have."""
    a, b = (standard_variables(t, bin_edges=bin_edges) for t in (synthetic, reference))
    names = [v for v in a if v in b]
    return distances(aligned(shares(long_form(synthetic, group, {v: a[v] for v in names})), shares(long_form(reference, group, {v: b[v] for v in names}))))


def target_distances(synthetic: DataFrame, targets: DataFrame, group: str = "puma", variables: Sequence[str] | None = None, bin_edges: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Distances from target marginals (group, variable, category, target); ESR_16p counts persons of 16 and over only."""
    require_columns(targets, [group, "variable", "category", "target"], "targets")
    have = standard_variables(synthetic, employment=True, bin_edges=bin_edges)
    names = [v for v in (variables or have) if v in have]
    long = long_form(synthetic, group, {v: have[v] for v in names})
    long = long.filter((F.col("variable") != "ESR_16p") | (F.col("category") != expr.NO_BIN))
    t = targets.filter(F.col(group).isNotNull() & F.col("variable").isin(names))
    t = t.select(F.col(group).cast("string").alias("group"), "variable", F.col("category").cast("string").alias("category"), expr.non_negative("target").alias("w"))
    return distances(aligned(shares(long), shares(t)))


def srmse(pairs: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Per variable: root mean square relative error, absolute errors and r2 of shares against targets, over cells."""
    d = F.col("p") - F.col("q")
    return pairs.groupBy("variable").agg(
        F.sqrt(F.avg(F.pow(d / (F.col("q") + eps), 2))).alias("srmse"),
        F.sum(F.abs(d)).alias("total_abs_error"),
        (F.sum(F.abs(d)) / F.sum("q")).alias("standardised_abs_error"),
        F.regr_r2("p", "q").alias("r2"),
    )


def pearson(df: DataFrame, x: str, y: str, least: int = 2, log: bool = False, weight: str | None = None) -> DataFrame:
    """One row (n, r) over complete pairs; null with fewer than `least` pairs or without spread."""
    a, b = expr.number(x), expr.number(y)
    if log:
        a, b = F.log1p(a), F.log1p(b)
    d = df.select(a.alias("_x"), b.alias("_y"), *([expr.non_negative(weight).alias("_w")] if weight else [])).filter(expr.finite("_x") & expr.finite("_y"))
    if weight:
        s = d.agg(F.count("*").alias("n"), *[F.sum(e).alias(f"_{i}") for i, e in enumerate([F.col("_w"), F.col("_w") * F.col("_x"), F.col("_w") * F.col("_y"), F.col("_w") * F.col("_x") ** 2, F.col("_w") * F.col("_y") ** 2, F.col("_w") * F.col("_x") * F.col("_y")])])
        vx, vy = F.col("_0") * F.col("_3") - F.col("_1") ** 2, F.col("_0") * F.col("_4") - F.col("_2") ** 2
        r = F.try_divide(F.col("_0") * F.col("_5") - F.col("_1") * F.col("_2"), F.sqrt(vx * vy))
        return s.select("n", F.when((F.col("n") >= least) & ~F.isnan(r), r).alias("r"))
    r = d.agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("_r"))
    return r.select("n", F.when((F.col("n") >= least) & ~F.isnan("_r"), F.col("_r")).alias("r"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, v): 0 with a single row or column, null without pairs. Empty cells are never built."""
    n = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").cast("double").alias("_n"))
    rows, columns = n.groupBy("_x").agg(F.sum("_n").alias("_r")), n.groupBy("_y").agg(F.sum("_n").alias("_c"))
    j = n.join(rows, "_x").join(columns, "_y")
    s = j.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_n") / F.col("_r") / F.col("_c")).alias("_s"), F.count_distinct("_x").alias("_a"), F.count_distinct("_y").alias("_b"))
    least = F.least("_a", "_b") - 1
    v = F.when(F.col("n").isNull(), None).when(least < 1, 0.0).otherwise(F.sqrt(F.greatest(F.col("_s") - 1, F.lit(0.0)) / least))
    return s.select(F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"), v.alias("v"))


def retention(synthetic: DataFrame, truth: DataFrame, column: str, eps: float = 1e-9) -> DataFrame:
    """How far an association holds: |s - t| and s / (t + eps) of two one-row tables."""
    s, t = synthetic.select(F.col(column).alias("synthetic")), truth.select(F.col(column).alias("reference"))
    return s.join(F.broadcast(t)).select("synthetic", "reference", F.abs(F.col("synthetic") - F.col("reference")).alias("difference"), (F.col("synthetic") / (F.col("reference") + eps)).alias("ratio"))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule_id, violations, rate) of SQL predicates, all counted in one scan; a rule naming absent columns is not known."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(F.expr(p), F.lit(False))).alias(r) for r, p in rules.items()])
    long = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col(r).alias("violations")) for r in rules])).alias("x"))
    return long.select("x.rule_id", "x.violations", F.coalesce(F.col("x.violations") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)).alias("rate"))


def repaired(df: DataFrame, donors: DataFrame, rule: str, fields: Sequence[str], group: str, key: str, seed: int = 0) -> DataFrame:
    """Replace only the named fields of rows that break the rule, by those of a drawn valid donor of the group.

    A group without valid donors keeps its rows. Adds `repaired`.
    """
    from cityportrait.operators import allocation

    bad = F.coalesce(F.expr(rule), F.lit(False))
    good = donors.filter(~bad & F.col(group).isNotNull())
    slices = allocation.weight_slices(good.withColumnRenamed(key, "_donor"), [group], "_donor", F.lit(1.0))
    wrong = df.filter(bad).withColumn("_u", expr.hash_uniform(seed, key))
    drawn = allocation.draw(wrong, slices, [group], "_donor", "_u").drop("_u")
    values = good.select(F.col(key).alias("_donor"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    fixed = drawn.join(values, "_donor", "left")
    out = fixed.select(*[F.when(F.col("_donor").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns], F.col("_donor").isNotNull().alias("repaired"))
    return df.filter(~bad).withColumn("repaired", F.lit(False)).unionByName(out)


def run_counts(df: DataFrame, group: str) -> DataFrame:
    """One row: rows, and groups with null as one."""
    return df.agg(F.count("*").alias("rows"), (F.count_distinct(group) + F.max(F.when(F.col(group).isNull(), 1).otherwise(0))).alias("groups"))


def cosine(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: cosine similarity of two curves, missing points 0. Sums are doubles: a product of two sums of squared counts is beyond a long."""
    number = lambda name: F.col(value).cast("double").alias(name)
    j = left.select(key, number("_a")).join(right.select(key, number("_b")), key, "full_outer").fillna(0.0, ["_a", "_b"])
    return j.agg(F.try_divide(F.sum(F.col("_a") * F.col("_b")), F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b")))).alias("cosine"))
