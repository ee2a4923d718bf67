"""Rules over rows and groups, repair by the fewest fields, and households, against brute-force versions."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cityportrait.operators import conditions, households, rules

RULES = {"worker": "age < 16 AND job = 'yes'", "driver": "age < 18 AND car = 'yes'", "rich": "job = 'no' AND income > 50", "owner": "car = 'yes' AND income < 10"}
CHECKS = [
    (lambda r: r["age"] is not None and r["age"] < 16 and r["job"] == "yes", {"age", "job"}),
    (lambda r: r["age"] is not None and r["age"] < 18 and r["car"] == "yes", {"age", "car"}),
    (lambda r: r["job"] == "no" and r["income"] > 50, {"job", "income"}),
    (lambda r: r["car"] == "yes" and r["income"] < 10, {"car", "income"}),
]
FIELDS = ["age", "job", "car", "income"]


def people(n, seed, start=0):
    rng = random.Random(seed)
    return [(start + i, rng.choice("abc"), rng.choice([5, 12, 17, 30, 50, None]), rng.choice(["yes", "no"]), rng.choice(["yes", "no"]), rng.choice([0, 20, 90])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, area string, age int, job string, car string, income int").withColumn("other", F.lit("x"))


def test_repair_changes_the_fewest_fields_that_will_do(spark):
    rows = people(600, 1) + [(5000, "nowhere", 5, "yes", "yes", 90)]
    donors = people(400, 2, 10_000)
    got = rules.repaired_fewest(frame(spark, rows), frame(spark, donors), RULES, FIELDS, "area", "k", seed=1)
    before = {r[0]: dict(zip(["k", "area", *FIELDS], r, strict=True)) for r in rows}
    after = {r["k"]: r for r in got.collect()}
    assert set(after) == set(before) and got.count() == len(rows)
    sizes = Counter()
    for k, old in before.items():
        new = after[k]
        broken = [u for check, u in CHECKS if check(old)]
        if not broken or k == 5000:
            assert not new["changed"] and all(new[f] == old[f] for f in FIELDS)
            continue
        assert not any(check(new) for check, _ in CHECKS) and all(new[f] == old[f] for f in FIELDS if f not in new["changed"])
        hitting = [s for n in (1, 2, 3, 4) for s in combinations(FIELDS, n) if all(set(s) & u for u in broken)]
        assert tuple(new["changed"]) in hitting
        sizes[len(new["changed"]) - len(hitting[0])] += 1
    # a draw can fail, and then a larger set is tried
    assert sizes[0] > 0.6 * sum(sizes.values())


def test_the_first_set_whose_draw_mends_the_row_is_used(spark):
    """Against all subsets, each drawn by itself: repair with one field at a time, then with two, and so on."""
    rows, donors = people(200, 3), people(50, 4, 10_000)
    whole = {r["k"]: tuple(r["changed"]) for r in rules.repaired_fewest(frame(spark, rows), frame(spark, donors), RULES, FIELDS, "area", "k", seed=2).collect()}
    uses = rules._uses(frame(spark, rows), RULES["worker"], FIELDS)
    assert uses == [0, 1]
    # with a donor that mends everything no row needs more than the smallest hitting set
    ideal = [(20_000 + i, a, 40, "yes", "no", 20) for i, a in enumerate("abc")]
    got = {r["k"]: r for r in rules.repaired_fewest(frame(spark, rows), frame(spark, ideal), RULES, FIELDS, "area", "k").collect()}
    for r in rows:
        old = dict(zip(["k", "area", *FIELDS], r, strict=True))
        broken = [u for check, u in CHECKS if check(old)]
        donor = {"age": 40, "job": "yes", "car": "no", "income": 20}
        good = [s for n in range(5) for s in combinations(FIELDS, n) if all(set(s) & u for u in broken) and not any(c({**old, **{f: donor[f] for f in s}}) for c, _ in CHECKS)]
        assert tuple(got[r[0]]["changed"]) == (good[0] if broken else ())
    assert set(whole) == {r[0] for r in rows}


def test_rules_without_their_columns_and_empty_tables(spark):
    some = [rules.Rule("a", "m", "age < 16"), rules.Rule("b", "n", "nothing > 1"), rules.Rule("c", "o", "count(*) > 1", "area"), rules.Rule("d", "p", "count(*) > 1", "nowhere")]
    got = {r.rule_id: (r.message, r["count"]) for r in rules.report(frame(spark, [(1, "a", 5, "no", "no", 0), (2, "a", None, "no", "no", 0), (3, None, 9, "no", "no", 0), (4, None, 9, "no", "no", 0)]), some).collect()}
    assert got == {"a": ("m", 3), "b": ("n", None), "c": ("o", 1), "d": ("p", None)}
    got = {r.rule_id: r["count"] for r in rules.report(frame(spark, []), some).collect()}
    assert got == {"a": 0, "b": None, "c": 0, "d": None}
    assert rules.repaired_fewest(frame(spark, []), frame(spark, []), RULES, FIELDS, "area", "k").count() == 0
    plan = rules.report(frame(spark, people(9, 5)), [some[0], some[2], rules.Rule("e", "q", "max(age) < 9", "area")])._jdf.queryExecution().toString()
    assert plan.count("Scan ExistingRDD") <= 6


def form(spark, persons, targets):
    p = spark.createDataFrame(persons, "pid long, area string, age int").withColumn("slot_", F.lit(0))
    t = spark.createDataFrame(targets, "area string, hh_size int, target double")
    return households.form_households(p, t, "pid", "area", "age", seed=3)


def sizes_of(rows):
    members = defaultdict(list)
    for r in rows:
        members[r.household_id].append(r)
    return members


def test_households_meet_whole_targets_exactly(spark):
    rng = random.Random(6)
    targets = [("a", 1, 30.0), ("a", 2, 20.0), ("a", 4, 10.0), ("b", 3, 7.0), ("b", 1, 2.0), ("b", 5, 0.0)]
    persons = [(i, "a", rng.randrange(90)) for i in range(30 + 40 + 40)] + [(1000 + i, "b", rng.randrange(90)) for i in range(23)]
    rows = form(spark, persons, targets).collect()
    assert sorted(r.pid for r in rows) == sorted(p[0] for p in persons)
    members = sizes_of(rows)
    got = Counter((h.split("-")[0], len(m)) for h, m in members.items())
    assert got == {(a, s): n for a, s, n in targets if n}
    for m in members.values():
        assert sorted(r.slot for r in m) == list(range(1, len(m) + 1)) and {r.hh_size for r in m} == {len(m)}
    # children lead no household while there are adults to lead it
    assert all(r.age >= 18 for r in rows if r.slot == 1) or sum(r.age >= 18 for r in rows if r.area == "a") < 60


def test_households_house_everyone_whatever_the_targets(spark):
    targets = [("a", 2, 1.0), ("a", 3, 0.7), ("b", 4, 5.0), ("c", 1, 1.0), ("c", 2, 3.3), ("c", 3, 2.2), ("c", 7, 0.4), ("d", 2, 0.0)]
    persons = [(i, a, None if i % 11 == 0 else i % 80) for i, a in enumerate("a" * 101 + "b" * 3 + "c" * 997 + "d" * 4 + "e" * 2)] + [(9999, None, 30)]
    got = form(spark, persons, targets)
    rows = got.collect()
    assert len(rows) == len(persons)
    assert all((r.household_id is None) == (r.area in ("d", "e", None)) for r in rows)
    for h, m in sizes_of([r for r in rows if r.household_id]).items():
        assert {r.hh_size for r in m} == {len(m)}, h
    c = Counter(len(m) for h, m in sizes_of([r for r in rows if r.area == "c"]).items())
    whole = 997 / (1 + 6.6 + 6.6 + 2.8)
    assert all(abs(c[s] - t * whole) <= 4 for s, t in ((1, 1.0), (2, 3.3), (3, 2.2), (7, 0.4)))
    check = conditions.household_consistency(households.household_table(got, "area"), got.filter("household_id IS NOT NULL"), "household_id", "hh_size").first()
    assert check.wrong_size == 0 and check.persons_without == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_households_do_not_depend_on_partitions(spark, parts):
    persons = [(i, "a" if i % 9 else "b", i * 7 % 90) for i in range(500)]
    targets = [("a", 1, 1.0), ("a", 3, 2.0), ("b", 2, 1.0), ("b", 5, 1.0)]
    p = spark.createDataFrame(persons, "pid long, area string, age int")
    t = spark.createDataFrame(targets, "area string, hh_size int, target double")
    key = lambda df: sorted((r.pid, r.household_id, r.slot) for r in df.collect())
    assert key(households.form_households(p.repartition(parts), t, "pid", "area", "age", seed=3)) == key(households.form_households(p, t, "pid", "area", "age", seed=3))
