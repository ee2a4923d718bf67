"""The first rows of several files, in file order."""

import pytest

from cityportrait.sources import scans


@pytest.mark.parametrize("n", [1, 40, 100, 101, 370, 399, 400, 1000])
def test_first_rows_of_several_files(spark, tmp_path, n):
    key, rows = "spark.sql.files.maxPartitionBytes", []
    for f in range(4):
        own = [(f * 100 + i, "x" * (i % 7), f) for i in range(100)]
        # the files are not written in the order of their names
        (tmp_path / f"p{f}.csv").write_text("id,t,f\n" + "".join(f"{a},{b},{c}\n" for a, b, c in own))
        rows += own
    before = spark.conf.get(key)
    spark.conf.set(key, "300")
    try:
        got = sorted(int(r.id) for r in scans.persons(spark, str(tmp_path), ["id"], n).collect())
    finally:
        spark.conf.set(key, before)
    assert got == [r[0] for r in rows[:n]]


def test_later_files_are_not_read(spark, tmp_path):
    for f in range(6):
        (tmp_path / f"p{f}.csv").write_text("id\n" + "".join(f"{f * 10 + i}\n" for i in range(10)))
    d = scans.first_rows(spark, str(tmp_path), 15)
    assert len(d.inputFiles()) == 3 and d.count() == 15
