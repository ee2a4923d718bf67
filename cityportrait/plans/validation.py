"""Queries of validation, marginals, calibration errors and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cityportrait.functions import expr
from cityportrait.operators import marginals, portrait, validation as v
from cityportrait.plans.common import PARTS, PERSONS, parts, persons, slices_sql, table, uniform

Q, S = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def micro(spark: SparkSession, d: str, odd: int | None = None) -> DataFrame:
    """Orders as person microdata: all of them, or for comparisons of two sides the even or the odd ones."""
    o = table(spark, d, "orders")
    o = o if odd is None else o.filter(F.col("o_orderkey") % 2 == odd)
    return o.select(
        F.col("o_orderkey").alias("person_id"), F.col("o_orderpriority").alias("puma"), F.col("o_totalprice").alias("PINCP"), (F.col("o_orderkey") * 37 % 100).alias("AGEP"),
        F.col("o_orderstatus").alias("SEX"), (F.col("o_orderkey") % 6 + 1).cast("string").alias("ESR"),
    )


def _micro_sql(name: str, odd: int | None = None) -> str:
    side = "" if odd is None else f"WHERE o_orderkey % 2 = {odd}"
    return f"""{name} AS (SELECT o_orderkey AS person_id, o_orderpriority AS puma, o_totalprice AS "PINCP", (o_orderkey * 37) % 100 AS "AGEP", o_orderstatus AS "SEX", (o_orderkey % 6 + 1)::VARCHAR AS "ESR" FROM orders {side})"""


def _bin_sql(value: str, *bins: tuple[str, str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a} AND {value} < {b} THEN '{label}'" for a, b, label in bins) + " ELSE 'nan' END"


# written out, not taken from the engine, so that the SQL shows a wrong edge or label
_AGE = _bin_sql(
    'least(greatest("AGEP", 0), 99)', ("0", "5", "[0.0, 5.0)"), ("5", "18", "[5.0, 18.0)"), ("18", "25", "[18.0, 25.0)"), ("25", "35", "[25.0, 35.0)"), ("35", "45", "[35.0, 45.0)"),
    ("45", "55", "[45.0, 55.0)"), ("55", "65", "[55.0, 65.0)"), ("65", "75", "[65.0, 75.0)"), ("75", "85", "[75.0, 85.0)"), ("85", "1000", "[85.0, 1000.0)"),
)
_INCOME = _bin_sql(
    'greatest("PINCP", 0)', ("0", "10000", "[0.0, 10000.0)"), ("10000", "25000", "[10000.0, 25000.0)"), ("25000", "50000", "[25000.0, 50000.0)"), ("50000", "75000", "[50000.0, 75000.0)"),
    ("75000", "100000", "[75000.0, 100000.0)"), ("100000", "150000", "[100000.0, 150000.0)"), ("150000", "250000", "[150000.0, 250000.0)"), ("250000", "10000000", "[250000.0, 10000000.0)"),
)
_E16 = """CASE WHEN "AGEP" >= 16 THEN CASE WHEN "ESR" IN ('1', '2') THEN 'employed' WHEN "ESR" = '3' THEN 'unemployed' WHEN "ESR" IN ('4', '5') THEN 'armed_forces' ELSE 'not_in_labor_force' END END"""


def _long_sql(name: str, source: str) -> str:
    return f"""{name}_x AS (SELECT puma, 'AGEP_bin' AS variable, {_AGE} AS category FROM {source} UNION ALL SELECT puma, 'PINCP_bin', {_INCOME} FROM {source}
      UNION ALL SELECT puma, 'SEX', "SEX" FROM {source} UNION ALL SELECT puma, 'ESR', "ESR" FROM {source}),
    {name}_n AS (SELECT puma AS "group", variable, category, count(*) AS n FROM {name}_x GROUP BY ALL),
    {name} AS (SELECT "group", variable, category, n / sum(n) OVER (PARTITION BY "group", variable) AS p FROM {name}_n)"""


_PAIR = f"""WITH {_micro_sql('a', 0)}, {_micro_sql('b', 1)}, {_long_sql('la', 'a')}, {_long_sql('lb', 'b')},
  al AS (SELECT coalesce(la."group", lb."group") AS "group", coalesce(la.variable, lb.variable) AS variable, coalesce(la.category, lb.category) AS category, coalesce(la.p, 0) AS p, coalesce(lb.p, 0) AS q
    FROM la FULL JOIN lb ON la."group" = lb."group" AND la.variable = lb.variable AND la.category = lb.category),
  tv AS (SELECT "group", variable, sum(abs(p - q)) / 2 AS tvd FROM al GROUP BY ALL)"""


def _aligned(spark, d):
    a, b = micro(spark, d, 0), micro(spark, d, 1)
    return v.aligned(v.shares(v.long_form(a, "puma", v.standard_variables(a))), v.shares(v.long_form(b, "puma", v.standard_variables(b))))


@query('SELECT o_orderstatus AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 9) AS share FROM orders GROUP BY 1')
def agg1_frequencies(spark, d):
    return v.frequencies(table(spark, d, "orders"), "o_orderstatus").withColumn("share", F.round("share", 9))


@query(f"WITH {_micro_sql('a')}, {_long_sql('la', 'a')} SELECT \"group\", variable, category, round(p, 9) AS p FROM la")
def agg2_group_shares(spark, d):
    a = micro(spark, d)
    return v.shares(v.long_form(a, "puma", v.standard_variables(a))).select("group", "variable", "category", F.round("p", 9).alias("p"))


@query(_PAIR + ' SELECT "group", variable, round(tvd, 9) AS tvd FROM tv')
def agg3_marginal_tvd(spark, d):
    return v.marginal_distances(micro(spark, d, 0), micro(spark, d, 1)).withColumn("tvd", F.round("tvd", 9))


@query(_PAIR + """ SELECT variable, count(*) AS groups, round(avg(tvd), 9) AS mean_tvd, round(max(tvd), 9) AS max_tvd,
  arg_min("group", lpad(((1 - round(tvd, 12)) * 1000000000000)::BIGINT::VARCHAR, 15, '0') || "group") AS worst_group FROM tv GROUP BY variable""")
def agg5_tvd_summary(spark, d):
    s = v.distance_summary(v.distances(_aligned(spark, d)))
    return s.select("variable", "groups", F.round("mean_tvd", 9).alias("mean_tvd"), F.round("max_tvd", 9).alias("max_tvd"), "worst_group")


def _targets(spark, d):
    b = micro(spark, d, 1)
    vs = v.standard_variables(b, employment=True)
    long = v.long_form(b, "puma", {k: vs[k] for k in ("AGEP_bin", "SEX", "ESR_16p")}).filter("category <> 'nan'")
    return long.groupBy(F.col("group").alias("puma"), "variable", "category").agg(F.sum("w").alias("target"))


@query(f"""WITH {_micro_sql('a', 0)}, {_micro_sql('b', 1)},
  xa AS (SELECT puma, 'AGEP_bin' AS variable, {_AGE} AS category FROM a UNION ALL SELECT puma, 'SEX', "SEX" FROM a UNION ALL SELECT puma, 'ESR_16p', {_E16} FROM a WHERE "AGEP" >= 16),
  xb AS (SELECT puma, 'AGEP_bin' AS variable, {_AGE} AS category FROM b UNION ALL SELECT puma, 'SEX', "SEX" FROM b UNION ALL SELECT puma, 'ESR_16p', {_E16} FROM b WHERE "AGEP" >= 16),
  na AS (SELECT *, count(*) OVER (PARTITION BY puma, variable) AS t FROM xa), pa AS (SELECT puma, variable, category, count(*) / any_value(t)::DOUBLE AS p FROM na GROUP BY ALL),
  nb AS (SELECT *, count(*) OVER (PARTITION BY puma, variable) AS t FROM xb), pb AS (SELECT puma, variable, category, count(*) / any_value(t)::DOUBLE AS q FROM nb GROUP BY ALL)
  SELECT coalesce(pa.puma, pb.puma) AS "group", coalesce(pa.variable, pb.variable) AS variable, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS tvd
  FROM pa FULL JOIN pb ON pa.puma = pb.puma AND pa.variable = pb.variable AND pa.category = pb.category GROUP BY 1, 2""")
def agg4_target_tvd(spark, d):
    return v.target_distances(micro(spark, d, 0), _targets(spark, d), variables=["AGEP_bin", "SEX", "ESR_16p", "HHINCP_bin"]).withColumn("tvd", F.round("tvd", 9))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def agg6_pearson(spark, d):
    return v.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@query("SELECT count(*) AS n, round(corr(ln(1 + l_quantity), ln(1 + l_extendedprice)), 6) AS r FROM lineitem")
def agg7_pearson_log(spark, d):
    return v.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", least=3, log=True).withColumn("r", F.round("r", 6))


@query("""WITH n AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), r AS (SELECT x, sum(n) AS r FROM n GROUP BY 1), c AS (SELECT y, sum(n) AS c FROM n GROUP BY 1)
  SELECT sum(n)::BIGINT AS n, round(sqrt(greatest(sum(n * n / r / c) - 1, 0) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)), 5) AS v FROM n JOIN r USING (x) JOIN c USING (y)""")
def agg8_cramers_v(spark, d):
    return v.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("v", F.round("v", 5))


_RULES = {"child_labour": "AGEP < 16 AND ESR IN ('1', '2', '3')", "negative_income": "PINCP < 0", "rich_child": "AGEP < 15 AND PINCP > 400000"}


@query(f"""WITH {_micro_sql('a')}, x AS (SELECT count(*) AS n, count_if("AGEP" < 16 AND "ESR" IN ('1', '2', '3')) AS a, count_if("PINCP" < 0) AS b, count_if("AGEP" < 15 AND "PINCP" > 400000) AS c FROM a)
  SELECT 'child_labour' AS rule_id, a AS violations, round(a / n::DOUBLE, 9) AS rate FROM x UNION ALL SELECT 'negative_income', b, round(b / n::DOUBLE, 9) FROM x UNION ALL SELECT 'rich_child', c, round(c / n::DOUBLE, 9) FROM x""")
def agg9_rule_violations(spark, d):
    return v.violations(micro(spark, d), _RULES).withColumn("rate", F.round("rate", 9))


@query(f"WITH {_micro_sql('a')} SELECT count(*) AS rows, count(DISTINCT puma) AS groups FROM a")
def agg10_run_counts(spark, d):
    return v.run_counts(micro(spark, d), "puma")


_BAD = """("AGEP" < 16 AND "ESR" IN ('1', '2', '3'))"""


@query(f"""WITH {_micro_sql('a', 0)}, {_micro_sql('b', 1)}, good AS (SELECT * FROM b WHERE NOT {_BAD}), {slices_sql('sl', 'good', 'puma', 'person_id', '1')}
  SELECT a.person_id, a.puma, a."AGEP", CASE WHEN {_BAD.replace('("AGEP"', '(a."AGEP"').replace('"ESR"', 'a."ESR"')} THEN g."ESR" ELSE a."ESR" END AS "ESR", {_BAD.replace('("AGEP"', '(a."AGEP"').replace('"ESR"', 'a."ESR"')} AS repaired
  FROM a JOIN sl ON a.puma = sl.g AND {uniform(3, 'a.person_id')} >= lo AND {uniform(3, 'a.person_id')} < hi JOIN good g ON g.person_id = sl.item""")
def ext2_minimal_repair(spark, d):
    a = micro(spark, d, 0)
    return v.repaired(a, micro(spark, d, 1), _RULES["child_labour"], ["ESR"], "puma", "person_id", seed=3).select("person_id", "puma", "AGEP", "ESR", "repaired")


@query(_PAIR + """ SELECT variable, round(sqrt(avg(((p - q) / (q + 1e-9)) ** 2)), 4) AS srmse, round(sum(abs(p - q)), 6) AS total_abs_error, round(sum(abs(p - q)) / sum(q), 6) AS standardised_abs_error, round(regr_r2(p, q), 6) AS r2
  FROM al WHERE variable IN ('SEX', 'AGEP_bin') GROUP BY variable""")
def ext14_srmse(spark, d):
    s = v.srmse(_aligned(spark, d).filter("variable IN ('SEX', 'AGEP_bin')"))
    return s.select("variable", F.round("srmse", 4).alias("srmse"), *[F.round(c, 6).alias(c) for c in ("total_abs_error", "standardised_abs_error", "r2")])


@query(f"""WITH {_micro_sql('a', 0)}, {_micro_sql('b', 1)}, x AS (SELECT (SELECT corr("PINCP", "AGEP") FROM a) AS s, (SELECT corr("PINCP", "AGEP") FROM b) AS t)
  SELECT round(s, 6) AS synthetic, round(t, 6) AS reference, round(abs(s - t), 6) AS difference, round(s / (t + 1e-9), 3) AS ratio FROM x""")
def ext16_retention(spark, d):
    r = v.retention(v.pearson(micro(spark, d, 0), "PINCP", "AGEP"), v.pearson(micro(spark, d, 1), "PINCP", "AGEP"), "r")
    return r.select(*[F.round(c, 6).alias(c) for c in ("synthetic", "reference", "difference")], F.round("ratio", 3).alias("ratio"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS y FROM supplier GROUP BY 1),
  j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.k = b.k),
  r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
  SELECT count(*) AS units, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def ext17_poi_alignment(spark, d):
    from cityportrait.operators import ranks

    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("y"))
    j = a.join(b, "k", "full_outer").fillna(0, ["x", "y"]).withColumn("g", F.lit("all"))
    j = ranks.percent_rank_average(ranks.percent_rank_average(j, ["g"], "x", "k", "rx"), ["g"], "y", "k", "ry")
    return j.agg(F.count("*").alias("units"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


@query("""WITH h AS (SELECT hour(ts) AS h, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1) SELECT round(sum(a * b) / sqrt(sum(a * a)::DOUBLE * sum(b * b)), 6) AS cosine FROM h""")
def ext18_cycle_cosine(spark, d):
    e = table(spark, d, "events").withColumn("h", F.hour(F.col("ts").cast("timestamp")))
    side = lambda k: e.filter(F.col("user_id") % 2 == k).groupBy("h").agg(F.count("*").alias("n"))
    return v.cosine(side(0), side(1), "h", "n").withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {_micro_sql('a')}, w AS (SELECT *, (person_id % 5 + 1)::DOUBLE AS w FROM a) SELECT count(*) AS n,
  round((sum(w) * sum(w * "PINCP" * "AGEP") - sum(w * "PINCP") * sum(w * "AGEP")) / sqrt((sum(w) * sum(w * "PINCP" * "PINCP") - sum(w * "PINCP") ** 2) * (sum(w) * sum(w * "AGEP" * "AGEP") - sum(w * "AGEP") ** 2)), 5) AS r FROM w""")
def ext22_weighted_pearson(spark, d):
    a = micro(spark, d).withColumn("w", (F.col("person_id") % 5 + 1).cast("double"))
    return v.pearson(a, "PINCP", "AGEP", weight="w").withColumn("r", F.round("r", 5))


@query(f"""WITH {_micro_sql('a')}, w AS (SELECT puma, "SEX" AS category, sum((person_id % 5 + 1)::DOUBLE) AS n FROM a GROUP BY ALL)
  SELECT puma AS "group", category, round(n / sum(n) OVER (PARTITION BY puma), 9) AS p FROM w""")
def ext22_weighted_shares(spark, d):
    a = micro(spark, d)
    return v.shares(v.long_form(a, "puma", {"SEX": F.col("SEX")}, F.col("person_id") % 5 + 1)).select("group", "category", F.round("p", 9).alias("p"))


# -- marginals: the wide census tables are counts of orders per nation


def _wide(spark, d, table_id: str, first: int, cells: int):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("tract")).agg(*[F.count_if(F.col("o_orderkey") % cells == i).cast("double").alias(f"{table_id}_{first + i:03d}E") for i in range(cells)])


def _recode_sql(table_id: str, first: int, cells: int) -> str:
    return f"""WITH n AS (SELECT c_nationkey AS tract, o_orderkey % {cells} + {first} AS i, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), g AS (SELECT DISTINCT tract FROM n),
      codes(i, variable, category) AS ({_CODES[table_id]})
      SELECT tract::VARCHAR AS puma, variable, category, sum(coalesce(n, 0))::DOUBLE AS target FROM g CROSS JOIN codes LEFT JOIN n USING (tract, i) GROUP BY ALL"""


def _codes(variable: str, *cells: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT unnest([{i}]), '{variable}', '{category}'" for i, category in cells)


# written out like the bins above
_CODES = {
    "B01001": _codes("SEX", ("2", "1"), ("26", "2")) + " UNION ALL " + _codes(
        "AGEP_bin", ("3, 27", "[0.0, 5.0)"), ("4, 5, 6, 28, 29, 30", "[5.0, 18.0)"), ("7, 8, 9, 10, 31, 32, 33, 34", "[18.0, 25.0)"), ("11, 12, 35, 36", "[25.0, 35.0)"), ("13, 14, 37, 38", "[35.0, 45.0)"),
        ("15, 16, 39, 40", "[45.0, 55.0)"), ("17, 18, 19, 41, 42, 43", "[55.0, 65.0)"), ("20, 21, 22, 44, 45, 46", "[65.0, 75.0)"), ("23, 24, 47, 48", "[75.0, 85.0)"), ("25, 49", "[85.0, 1000.0)")),
    "B19001": _codes(
        "HHINCP_bin", ("2", "[0.0, 10000.0)"), ("3", "[10000.0, 15000.0)"), ("4", "[15000.0, 20000.0)"), ("5", "[20000.0, 25000.0)"), ("6", "[25000.0, 30000.0)"), ("7", "[30000.0, 35000.0)"), ("8", "[35000.0, 40000.0)"),
        ("9", "[40000.0, 45000.0)"), ("10", "[45000.0, 50000.0)"), ("11", "[50000.0, 60000.0)"), ("12", "[60000.0, 75000.0)"), ("13", "[75000.0, 100000.0)"), ("14", "[100000.0, 125000.0)"), ("15", "[125000.0, 150000.0)"),
        ("16", "[150000.0, 200000.0)"), ("17", "[200000.0, inf)")),
    "B23025": _codes("ESR_16p", ("4", "employed"), ("5", "unemployed"), ("6", "armed_forces"), ("7", "not_in_labor_force")),
    "B08303": _codes(
        "COMMUTE_TIME", ("2", "[0, 5)"), ("3", "[5, 10)"), ("4", "[10, 15)"), ("5", "[15, 20)"), ("6", "[20, 25)"), ("7", "[25, 30)"), ("8", "[30, 35)"), ("9", "[35, 40)"), ("10", "[40, 45)"), ("11", "[45, 60)"),
        ("12", "[60, 90)"), ("13", "[90, inf)")),
    "B11016": _codes(
        "HH_SIZE", ("3", "family_2"), ("4", "family_3"), ("5", "family_4"), ("6", "family_5"), ("7", "family_6"), ("8", "family_7"), ("10", "nonfamily_1"), ("11", "nonfamily_2"), ("12", "nonfamily_3"), ("13", "nonfamily_4"),
        ("14", "nonfamily_5"), ("15", "nonfamily_6"), ("16", "nonfamily_7")),
    "B08301": _codes(
        "COMMUTE_MODE", ("3", "drove_alone"), ("4", "carpooled"), ("10", "public_transit"), ("16", "taxi"), ("17", "motorcycle"), ("18", "bicycle"), ("19", "walked"), ("20", "other"), ("21", "worked_from_home")),
}


def _recode(spark, d, table_id: str, first: int, cells: int):
    wide = _wide(spark, d, table_id, first, cells).withColumnRenamed("tract", "puma")
    return marginals.table_recode(wide, table_id, "puma", marginals.recodes()[table_id])


@query(_recode_sql("B01001", 2, 48))
def agg12_sex_by_age(spark, d):
    return _recode(spark, d, "B01001", 2, 48)


@query(_recode_sql("B19001", 2, 16))
def agg13_household_income(spark, d):
    return _recode(spark, d, "B19001", 2, 16)


@query(_recode_sql("B23025", 4, 4))
def agg14_employment(spark, d):
    return _recode(spark, d, "B23025", 4, 4)


@query(_recode_sql("B08303", 2, 12))
def ext21_commute_time(spark, d):
    return _recode(spark, d, "B08303", 2, 12)


@query(_recode_sql("B11016", 2, 15))
def ext21_household_size(spark, d):
    return _recode(spark, d, "B11016", 2, 15)


@query(_recode_sql("B08301", 2, 20))
def ext21_commute_mode(spark, d):
    return _recode(spark, d, "B08301", 2, 20)


@query("""WITH n AS (SELECT n_regionkey AS puma, o_orderkey % 4 AS i, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
  SELECT puma, sum(n) FILTER (i = 0)::DOUBLE AS "B23025_004E", sum(n) FILTER (i = 1)::DOUBLE AS "B23025_005E", sum(n) FILTER (i = 2)::DOUBLE AS "B23025_006E", sum(n) FILTER (i = 3)::DOUBLE AS "B23025_007E" FROM n GROUP BY puma""")
def agg11_tract_rollup(spark, d):
    cw = table(spark, d, "nation").select(F.col("n_nationkey").alias("tract"), F.col("n_regionkey").alias("puma"))
    return marginals.rolled_up(_wide(spark, d, "B23025", 4, 4), cw, "tract", "puma", "B23025")


@query(f"""SELECT *, 'B23025' AS table_id, 'stand-in' AS source, 2023 AS acs_year, 'puma' AS geo_level FROM ({_recode_sql("B23025", 4, 4)})
  UNION ALL SELECT *, 'B19001', 'stand-in', 2023, 'puma' FROM ({_recode_sql("B19001", 2, 16)})""")
def set2_marginals_union(spark, d):
    return census_marginals(spark, d)


def census_marginals(spark, d):
    t = {k: _wide(spark, d, k, a, b).withColumnRenamed("tract", "puma") for k, a, b in (("B23025", 4, 4), ("B19001", 2, 16))}
    return marginals.marginals(t, "puma", "stand-in", 2023, "puma")


# -- summaries


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders")
def agg16_distribution(spark, d):
    s = portrait.distribution(table(spark, d, "orders"), "o_totalprice", "o_orderkey")
    return s.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "p10", "p50", "p90")])


@query(f"WITH {PARTS} SELECT (footprint_area_m2::INTEGER % 5) AS price_tier, count(*) AS n, round(median(value), 4) AS median, round(avg(value), 4) AS mean FROM prt WHERE footprint_area_m2::INTEGER % 5 > 0 GROUP BY 1")
def agg17_tier_summary(spark, d):
    p = parts(spark, d).withColumn("price_tier", (F.col("footprint_area_m2").cast("int") % 5))
    s = portrait.tier_summary(p, "price_tier", "value")
    return s.select("price_tier", "n", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"))


@query("SELECT round(quantile_cont(o_totalprice, 0.02), 4) AS lo, round(quantile_cont(o_totalprice, 0.98), 4) AS hi FROM orders")
def agg19_plot_range(spark, d):
    return portrait.plot_range(table(spark, d, "orders"), "o_totalprice", "o_orderkey").select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(f"WITH {PARTS} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM prt")
def agg20_bounding_box(spark, d):
    return portrait.bounding_box(parts(spark, d), "x", "y")


@query("""WITH m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT least(floor((o_totalprice - a) / ((b - a) / 60)), 59)::INTEGER AS bin, count(*) AS n FROM orders, m GROUP BY 1""")
def agg21_histogram(spark, d):
    return portrait.histogram(table(spark, d, "orders"), "o_totalprice")


@query("""WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
  SELECT g AS o_orderpriority, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5::DOUBLE * (q3 - q1)) AS whisker_low, max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_high
  FROM orders JOIN q ON o_orderpriority = g GROUP BY g""")
def agg22_box_stats(spark, d):
    b = portrait.box_stats(table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return b.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "whisker_low", "whisker_high")


@query(f"""WITH {PERSONS} SELECT person_id, CASE WHEN trim(' 0' || puma || ' ') = '' THEN NULL ELSE puma::BIGINT::VARCHAR END AS area, lpad(puma::VARCHAR, 2, '0') || lpad(puma::VARCHAR, 3, '0') || lpad(person_id::VARCHAR, greatest(6, length(person_id::VARCHAR))::INTEGER, '0') AS geoid,
  greatest("PINCP", 0) AS floored, {_AGE.replace("ELSE 'nan'", "ELSE NULL")} AS age_bin, {_INCOME.replace("ELSE 'nan'", "ELSE NULL")} AS income_bin, CASE WHEN "AGEP" < 50 THEN greatest(least("PINCP", 5000), 100) END AS clipped,
  {_E16.replace('"ESR"', "(person_id % 7)::VARCHAR")} AS esr_16p, coalesce("AGEP" < 16 AND person_id % 7 IN (1, 2, 3), false) AS child_labour FROM persons""")
def prj_person_expressions(spark, d):
    p = persons(spark, d)
    esr = (F.col("person_id") % 7).cast("string")
    return p.select(
        "person_id", expr.area_code(F.concat(F.lit(" 0"), F.col("puma").cast("string"), F.lit(" "))).alias("area"), expr.geoid("puma", "puma", "person_id").alias("geoid"),
        expr.non_negative("PINCP").alias("floored"), expr.binned("AGEP", expr.AGE_EDGES).alias("age_bin"), expr.binned(expr.clipped("PINCP", 0.0), expr.INCOME_EDGES).alias("income_bin"),
        expr.clipped(F.when(F.col("AGEP") < 50, F.col("PINCP")), 100.0, 5000.0).alias("clipped"), expr.employment_16p("AGEP", esr).alias("esr_16p"), expr.child_labour("AGEP", esr).alias("child_labour"),
    )
