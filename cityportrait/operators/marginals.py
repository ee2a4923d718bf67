"""Census tables to long target marginals, by one table-driven recode."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityportrait.functions import expr

LONG = ["variable", "category", "target", "table_id", "source", "acs_year", "geo_level"]
_AGE_BINS = expr.bin_labels(expr.AGE_EDGES)
#: Lower ages of a sex's detailed cells in B01001, in cell order; the sexes' totals are cells 2 and 26 (fixed values).
_CELL_AGES = [0, 5, 10, 15, 18, 20, 21, 22, 25, 30, 35, 40, 45, 50, 55, 60, 62, 65, 67, 70, 75, 80, 85]
_AGE_OF_CELL = [max(i for i, e in enumerate(expr.AGE_EDGES) if e <= a) for a in _CELL_AGES]
#: Income edges of B19001 in cell order (fixed values).
HOUSEHOLD_INCOME_EDGES = [0, 10000, 15000, 20000, 25000, 30000, 35000, 40000, 45000, 50000, 60000, 75000, 100000, 125000, 150000, 200000]


def _cell(table: str, i: int) -> str:
    return f"{table}_{i:03d}E"


def recodes() -> dict[str, list[tuple[str, str, str]]]:
    """Per table: (cell, variable, category) of every cell that is recoded."""
    out: dict[str, list[tuple[str, str, str]]] = {"B01001": [], "B19001": [], "B23025": []}
    for sex, total in (("1", 2), ("2", 26)):
        out["B01001"].append((_cell("B01001", total), "SEX", sex))
        out["B01001"] += [(_cell("B01001", total + 1 + i), "AGEP_bin", _AGE_BINS[b]) for i, b in enumerate(_AGE_OF_CELL)]
    edges = [float(e) for e in HOUSEHOLD_INCOME_EDGES] + [float("inf")]
    out["B19001"] = [(_cell("B19001", 2 + i), "HHINCP_bin", label) for i, label in enumerate(expr.bin_labels(edges))]
    out["B23025"] = [(_cell("B23025", 4 + i), "ESR_16p", c) for i, c in enumerate(["employed", "unemployed", "armed_forces", "not_in_labor_force"])]
    out["B11016"] = [(_cell("B11016", 3 + i), "HH_SIZE", f"family_{2 + i}") for i in range(6)] + [(_cell("B11016", 10 + i), "HH_SIZE", f"nonfamily_{1 + i}") for i in range(7)]
    out["B08301"] = [(_cell("B08301", i), "COMMUTE_MODE", m) for i, m in [(3, "drove_alone"), (4, "carpooled"), (10, "public_transit"), (16, "taxi"), (17, "motorcycle"), (18, "bicycle"), (19, "walked"), (20, "other"), (21, "worked_from_home")]]
    out["B08303"] = [(_cell("B08303", 2 + i), "COMMUTE_TIME", t) for i, t in enumerate(expr.bin_labels([0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 60, 90, float("inf")]))]
    return out


def table_recode(wide: DataFrame, table: str, group: str, codes: list[tuple[str, str, str]]) -> DataFrame:
    """(group, variable, category, target) of a wide table: cells are unpivoted once and joined to their codes."""
    cells = sorted({c for c, _, _ in codes if c in wide.columns})
    if not cells:
        raise ValueError(f"{table} has none of the expected cells")
    long = wide.filter(F.col(group).isNotNull()).select(F.col(group).cast("string").alias(group), *[expr.non_negative(c).alias(c) for c in cells]).unpivot([group], cells, "cell", "value")
    names = wide.sparkSession.createDataFrame(codes, "cell string, variable string, category string")
    return long.join(F.broadcast(names), "cell").groupBy(group, "variable", "category").agg(F.sum("value").alias("target"))


def rolled_up(wide: DataFrame, crosswalk: DataFrame, key: str, group: str, table: str) -> DataFrame:
    """Sum the table's estimate cells over areas of a crosswalk (key, group); unmatched rows go."""
    cells = [c for c in wide.columns if c.startswith(f"{table}_") and c.endswith("E")]
    return wide.join(crosswalk.select(key, group), key).filter(F.col(group).isNotNull()).groupBy(group).agg(*[F.sum(expr.non_negative(c)).alias(c) for c in cells])


def marginals(tables: dict[str, DataFrame], group: str, source: str, year: int, level: str) -> DataFrame:
    """All tables as one long table; an error if none gives rows."""
    known = recodes()
    parts = [
        table_recode(df, t, group, known[t]).select(group, "variable", "category", "target", F.lit(t).alias("table_id"), F.lit(source).alias("source"), F.lit(year).alias("acs_year"), F.lit(level).alias("geo_level"))
        for t, df in tables.items()
        if t in known
    ]
    if not parts:
        raise ValueError("no known table")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
