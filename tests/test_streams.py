"""Streams over shuffled files against the batch queries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cityportrait.operators import mobility
from cityportrait.streaming import visits

SCHEMA = "caid long, area string, ts timestamp"
START = dt.datetime(2024, 1, 3)


def sightings(n, seed, days=100):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(25)]), rng.choice("abc"), START + dt.timedelta(days=rng.uniform(0, days))) for _ in range(n)]


def files(spark, folder, groups):
    """One file a group, in that order of arrival."""
    for i, rows in enumerate(groups):
        path = f"{folder}/{i:03d}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return f"{folder}/*"


def read(spark, glob):
    return visits.read_events(spark, glob, SCHEMA)


def result(spark, query, folder):
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_monthly_population_equals_the_batch(spark, tmp_path, seed):
    rows = sorted(sightings(400, seed), key=lambda r: r[2])
    # rows come up to a month late
    rng = random.Random(seed)
    arrived = sorted(rows, key=lambda r: r[2] + dt.timedelta(days=rng.uniform(0, 25)))
    groups = [arrived[i : i + 60] for i in range(0, len(arrived), 60)] + [[(99, "z", dt.datetime(2026, 1, 1))], [(99, "z", dt.datetime(2026, 1, 2))]]
    glob = files(spark, tmp_path / "in", groups)
    q = visits.write_rows(visits.monthly_population(read(spark, glob), "area"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(tuple(r) for r in result(spark, q, str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in mobility.monthly_population(spark.createDataFrame(rows, SCHEMA), "area").collect())
    assert got == want and len(got) == 12


def test_rows_of_a_finished_month_are_dropped(spark, tmp_path):
    day = lambda m, d: dt.datetime(2024, m, d)
    groups = [[(1, "a", day(1, 5)), (2, "a", day(1, 6)), (1, "a", day(1, 7))], [(3, "a", day(2, 9))], [(4, "a", day(1, 30))], [(5, "a", day(5, 1))], [(5, "a", day(5, 2))], [(6, "a", day(1, 31))], [(7, "a", day(9, 1))], [(7, "a", day(9, 2))]]
    glob = files(spark, tmp_path / "in", groups)
    q = visits.write_rows(visits.monthly_population(read(spark, glob), "area"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.month: r.devices for r in result(spark, q, str(tmp_path / "out")).collect()}
    # the fourth device of January came in time, the sixth did not
    assert got == {"2024-01": 3, "2024-02": 1, "2024-05": 1}


def test_home_work_pairs_equal_the_batch(spark, tmp_path):
    home, work = sightings(150, 3, 80), sightings(150, 4, 80)
    last = [(-1, "z", dt.datetime(2025, 6, 1))]
    more = [(-2, "z", dt.datetime(2025, 9, 1))]

    def shuffled(rows, seed):
        rows, rng = sorted(rows, key=lambda r: r[2]), random.Random(seed)
        groups = [rows[i : i + 30] for i in range(0, len(rows), 30)]
        for g in groups:
            rng.shuffle(g)
        return [*groups, last, more, more]

    glob = [files(spark, tmp_path / name, shuffled(rows, seed)) for name, rows, seed in (("home", home, 1), ("work", work, 2))]
    pairs = visits.home_work_pairs(read(spark, glob[0]), read(spark, glob[1]), "caid", "area", "area", late="20 days")
    q = visits.write_rows(pairs, str(tmp_path / "out"), str(tmp_path / "check"))
    got = result(spark, q, str(tmp_path / "out")).filter("device >= 0")
    batch = visits.home_work_pairs(spark.createDataFrame(home, SCHEMA), spark.createDataFrame(work, SCHEMA), "caid", "area", "area")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(batch)
    assert batch.filter("home IS NULL").count() > 0 and batch.filter("work IS NULL").count() > 0
    # and the counts by month are those of the plain query over the month's rows
    january = lambda t: spark.createDataFrame([r for r in t if r[2].month == 1], SCHEMA)
    plain = mobility.flows(january(home), january(work), "caid", "area", "area").select("home", "work", "devices")
    assert rows(visits.flows_of(got).filter("month = '2024-01'").select("home", "work", "devices")) == rows(plain)


def test_streams_keep_bounded_state(spark, tmp_path):
    """A pair's state goes once no partner can come: the state store is empty of old rows at the end."""
    groups = [[(i, "a", START + dt.timedelta(days=40 * k))] for k in range(6) for i in range(1)]
    glob = files(spark, tmp_path / "in", groups)
    q = visits.write_rows(visits.monthly_population(read(spark, glob), "area"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    left = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    assert left <= 6, q.lastProgress["stateOperators"]
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count_distinct("month")).first()[0] >= 3
