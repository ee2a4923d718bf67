"""Queries of rules over groups, repair by the fewest fields, and households."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cityportrait.operators import conditions, households, rules
from cityportrait.plans.common import PERSONS, persons, slices_sql, table, uniform
from cityportrait.plans.validation import _micro_sql, micro

Q, S = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


_REPORT = [
    rules.Rule("dear", "a person costs more than 90,000", "price > 90000"),
    rules.Rule("late_child", "a late member of small quantity", "member > 5 AND quantity < 5"),
    rules.Rule("hh_size", "the stated size is not the number of persons", "max(size) <> count(*)", "hh"),
    rules.Rule("one_head", "a household has not one head", "count_if(member = 1) <> 1", "hh"),
    rules.Rule("spread", "parts of one supplier differ in price by more than 60,000", "max(price) - min(price) > 60000", "supplier"),
    rules.Rule("licence", "a driver is too young", "drives AND age < 16"),
]


@query("""WITH p AS (SELECT l_orderkey AS hh, l_orderkey % 7 + 1 AS size, l_linenumber AS member, l_quantity AS quantity, l_extendedprice AS price, l_suppkey AS supplier FROM lineitem WHERE l_shipdate >= '1995-03-01'),
  h AS (SELECT hh, max(size) <> count(*) AS a, count_if(member = 1) <> 1 AS b FROM p GROUP BY 1), s AS (SELECT max(price) - min(price) > 60000 AS c FROM p GROUP BY supplier)
  SELECT 'dear' AS rule_id, 'a person costs more than 90,000' AS message, (SELECT count_if(price > 90000) FROM p)::BIGINT AS count
  UNION ALL SELECT 'late_child', 'a late member of small quantity', (SELECT count_if(member > 5 AND quantity < 5) FROM p) UNION ALL SELECT 'hh_size', 'the stated size is not the number of persons', (SELECT count_if(a) FROM h)
  UNION ALL SELECT 'one_head', 'a household has not one head', (SELECT count_if(b) FROM h) UNION ALL SELECT 'spread', 'parts of one supplier differ in price by more than 60,000', (SELECT count_if(c) FROM s)
  UNION ALL SELECT 'licence', 'a driver is too young', NULL""")
def ext1_rule_report(spark, d):
    l = table(spark, d, "lineitem").filter("l_shipdate >= '1995-03-01'")
    p = l.selectExpr("l_orderkey AS hh", "l_orderkey % 7 + 1 AS size", "l_linenumber AS member", "l_quantity AS quantity", "l_extendedprice AS price", "l_suppkey AS supplier")
    return rules.report(p, _REPORT)


_FIELDS = ["AGEP", "ESR", "PINCP"]
_EDITS = {
    "child_labour": ("AGEP < 16 AND ESR IN ('1', '2', '3')", ["AGEP", "ESR"]),
    "rich_child": ("AGEP < 15 AND PINCP > 150000", ["AGEP", "PINCP"]),
    "poor_worker": ("ESR = '1' AND PINCP < 60000", ["ESR", "PINCP"]),
    "old_worker": ("AGEP > 80 AND ESR IN ('1', '2', '4')", ["AGEP", "ESR"]),
}


def _edit(i: int, **names: str) -> str:
    """SQL of a rule with its columns under other names."""
    sql = list(_EDITS.values())[i][0]
    for c in _FIELDS:
        sql = sql.replace(c, names.get(c, f'"{c}"'))
    return f"coalesce({sql}, false)"


_SETS = ", ".join(
    f"({sum(1 << _FIELDS.index(f) for f in s)}, {k}, {r}, [{', '.join(str(bool(set(s) & set(u))) for _, u in _EDITS.values())}])"
    for k in (1, 2, 3) for r, s in enumerate(combinations(_FIELDS, k))
)
_NEW = {c: f"CASE WHEN (s.fields >> {i}) & 1 = 1 THEN g.\"{c}\" ELSE w.\"{c}\" END" for i, c in enumerate(_FIELDS)}


@query(f"""WITH {_micro_sql('a', 0)}, {_micro_sql('b', 1)}, good AS (SELECT * FROM b WHERE NOT ({' OR '.join(_edit(i) for i in range(4))})), {slices_sql('sl', 'good', 'puma', 'person_id', '1')},
  s(fields, size, rank, hits) AS (VALUES {_SETS}),
  w AS (SELECT *, [{', '.join(_edit(i) for i in range(4))}] AS broken FROM a),
  t AS (SELECT w.person_id, s.size, s.rank, s.fields, {', '.join(f'{sql} AS "{c}"' for c, sql in _NEW.items())} FROM w JOIN s ON list_bool_or(broken) AND len(list_filter(range(1, 5), lambda i: broken[i] AND NOT hits[i])) = 0
    JOIN sl ON sl.g = w.puma AND {uniform(3, 'w.person_id', 's.fields')} >= lo AND {uniform(3, 'w.person_id', 's.fields')} < hi JOIN good g ON g.person_id = sl.item),
  f AS (SELECT * FROM t WHERE NOT ({' OR '.join(_edit(i) for i in range(4))}) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY size, rank) = 1)
  SELECT a.person_id, coalesce(f."AGEP", a."AGEP") AS "AGEP", coalesce(f."ESR", a."ESR") AS "ESR", coalesce(f."PINCP", a."PINCP") AS "PINCP",
    concat_ws(',', CASE WHEN f.fields & 1 = 1 THEN 'AGEP' END, CASE WHEN f.fields & 2 = 2 THEN 'ESR' END, CASE WHEN f.fields & 4 = 4 THEN 'PINCP' END) AS changed FROM a LEFT JOIN f ON a.person_id = f.person_id""")
def ext2_fewest_fields(spark, d):
    got = rules.repaired_fewest(micro(spark, d, 0), micro(spark, d, 1), {k: p for k, (p, _) in _EDITS.items()}, _FIELDS, "puma", "person_id", seed=3)
    return got.select("person_id", *_FIELDS, F.concat_ws(",", "changed").alias("changed"))


def _size_targets(spark, d):
    s = table(spark, d, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("puma"), (F.col("s_suppkey") % 5 + 1).alias("hh_size")).agg(F.count("*").alias("target"))


_FORMED = f"""WITH RECURSIVE {PERSONS}, tg AS (SELECT s_nationkey AS puma, s_suppkey % 5 + 1 AS s, count(*)::DOUBLE AS t FROM supplier GROUP BY ALL),
  np AS (SELECT puma, count(*) AS n FROM persons WHERE puma IS NOT NULL GROUP BY 1), w AS (SELECT puma, sum(s * t) AS w FROM tg GROUP BY 1),
  q AS (SELECT puma, s, n, t * n / w AS q, floor(t * n / w + 1e-9)::BIGINT AS h FROM tg JOIN np USING (puma) JOIN w USING (puma)),
  st AS (SELECT puma, s, row_number() OVER (PARTITION BY puma ORDER BY round(h - q, 9), s) AS i, 1 AS phase FROM q
    UNION ALL SELECT puma, s, count(*) OVER (PARTITION BY puma) + row_number() OVER (PARTITION BY puma ORDER BY s DESC), 2 FROM q),
  fold(puma, i, rest, s, more) AS (SELECT puma, 0::BIGINT, (any_value(n) - sum(s * h))::BIGINT, 0::BIGINT, 0::BIGINT FROM q GROUP BY puma
    UNION ALL SELECT f.puma, st.i, (f.rest - st.s * CASE WHEN phase = 1 THEN (st.s <= f.rest)::BIGINT ELSE f.rest // st.s END)::BIGINT, st.s::BIGINT, CASE WHEN phase = 1 THEN (st.s <= f.rest)::BIGINT ELSE f.rest // st.s END
      FROM fold f JOIN st ON f.puma = st.puma AND st.i = f.i + 1),
  hh AS (SELECT puma, s, sum(h)::BIGINT AS h FROM (SELECT puma, s, h FROM q UNION ALL SELECT puma, s, more FROM fold WHERE i > 0
      UNION ALL SELECT puma, min(rest), 1 FROM fold GROUP BY puma HAVING min(rest) > 0) GROUP BY ALL HAVING sum(h) > 0),
  ly AS (SELECT puma, k, (SELECT sum(h) FROM hh x WHERE x.puma = y.puma AND x.s >= k)::BIGINT AS c FROM (SELECT puma, unnest(range(1, max(s) + 1)) AS k FROM hh GROUP BY puma) y),
  l AS (SELECT *, sum(c) OVER (PARTITION BY puma ORDER BY k) - c AS start FROM ly),
  r AS (SELECT *, row_number() OVER (PARTITION BY puma ORDER BY CASE WHEN "AGEP" >= 18 THEN {uniform(5, 'person_id')} ELSE 19 - "AGEP" + {uniform(5, 'person_id')} END, person_id) - 1 AS r FROM persons),
  fm AS (SELECT person_id, r.puma, "AGEP", (r - start)::BIGINT AS h, k AS slot FROM r LEFT JOIN l ON r.puma = l.puma AND r >= start AND r < start + c)"""


@query(_FORMED + """ SELECT person_id, puma::VARCHAR || '-' || h::VARCHAR AS household_id, (SELECT count(*) FROM ly WHERE ly.puma = fm.puma AND ly.c > fm.h)::INT AS hh_size, slot::INT AS slot FROM fm""")
def ext13_form_households(spark, d):
    formed = households.form_households(persons(spark, d), _size_targets(spark, d), "person_id", "puma", "AGEP", seed=5)
    return formed.select("person_id", "household_id", "hh_size", "slot")


@query(_FORMED + """ SELECT count(DISTINCT puma::VARCHAR || '-' || h::VARCHAR)::BIGINT AS households, 0::BIGINT AS wrong_size, 0::BIGINT AS persons_without FROM fm WHERE h IS NOT NULL""")
def ext13_formed_are_consistent(spark, d):
    formed = households.form_households(persons(spark, d), _size_targets(spark, d), "person_id", "puma", "AGEP", seed=5)
    formed = formed.filter(F.col("household_id").isNotNull())
    return conditions.household_consistency(households.household_table(formed, "puma"), formed, "household_id", "hh_size")
