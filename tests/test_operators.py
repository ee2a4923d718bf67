"""The reference's own fixtures, invariants, plans, and edge cases."""

import math

import pytest
from pyspark.sql import Window as W, functions as F

from cityportrait.functions import expr
from cityportrait.functions.checks import first_present, require_columns, split_requested
from cityportrait.operators import allocation, calibration, lineage, marginals, microdata, mobility, portrait, ranks, spatial, tiers, validation
from cityportrait.plans import places
from cityportrait.sources import scans, sinks
from cityportrait.streaming import visits as stream


def test_assign_keeps_persons_within_their_area(spark):
    p = spark.createDataFrame([(1, "bg1"), (2, "bg1"), (3, "bg2"), (4, "bg_missing")], "person_id long, bg_geoid string")
    b = spark.createDataFrame([("b1", "bg1", 100.0), ("b2", "bg1", 50.0), ("b3", "bg2", 10.0)], "bldg_id string, bg_geoid string, footprint_area_m2 double")
    got = {r.person_id: r.bldg_id for r in allocation.assign_within_area(p, b, "person_id", "bg_geoid", "bldg_id").collect()}
    assert len(got) == 4 and got[1] in ("b1", "b2") and got[2] in ("b1", "b2") and got[3] == "b3" and got[4] is None


PERSONS = [(1, "1", 10.0), (2, "1", 20.0), (3, "1", 30.0), (4, "2", 40.0), (5, "missing", 50.0)]
BUILDINGS = [("b1", "1", 1.0, 1), ("b2", "1", 3.0, 2), ("b3", "2", 2.0, 1)]


def _fixture(spark):
    return (
        spark.createDataFrame(PERSONS, "person_id long, puma string, PINCP double"),
        spark.createDataFrame(BUILDINGS, "bldg_id string, puma string, cap_proxy double, price_tier int"),
    )


@pytest.mark.parametrize("method", allocation.METHODS)
def test_allocation_methods(spark, method):
    p, b = _fixture(spark)
    got = {r.person_id: r.bldg_id for r in allocation.allocate(p, b, method, n_tiers=2).collect()}
    assert len(got) == 5 and got[5] is None and got[4] == "b3"
    if method == "income_price_match":
        assert (got[1], got[2], got[3]) == ("b1", "b1", "b2")


def test_allocation_does_not_depend_on_partitions(spark):
    p, b = _fixture(spark)
    one = sorted(allocation.allocate(p.coalesce(1), b, "capacity_only", seed=3).collect())
    assert one == sorted(allocation.allocate(p.repartition(7), b.repartition(3), "capacity_only", seed=3).collect())


def test_allocation_edge_cases(spark):
    p, b = _fixture(spark)
    zero = b.withColumn("cap_proxy", F.lit(0.0))
    assert allocation.allocate(p, zero, "capacity_only").filter("bldg_id is not null").count() == 4
    none = b.withColumn("price_tier", F.lit(None).cast("int"))
    d = allocation.diagnostics(allocation.allocate(p, none, "income_price_match")).first()
    assert (d.assigned, d.unassigned, d.no_tier_persons, d.fallbacks) == (4, 1, 4, 0)
    assert allocation.allocate(p.limit(0), b, "random").count() == 0
    with pytest.raises(ValueError):
        allocation.allocate(p, b, "best")
    with pytest.raises(ValueError, match="cap_proxy"):
        allocation.allocate(p, b.drop("cap_proxy"), "capacity_only")


def _people(spark, esr=True):
    rows = [("1", 10, 0, "1", "1"), ("1", 30, 20000, "2", "6"), ("2", 40, 50000, "1", "2"), ("2", 12, 1000, "2", "3")]
    d = spark.createDataFrame(rows, "puma string, AGEP long, PINCP long, SEX string, ESR string")
    return d if esr else d.drop("ESR")


def test_child_labour_and_variables(spark):
    d = _people(spark)
    rate = validation.violations(d, {"child_labour": "AGEP < 16 AND ESR IN ('1','2','3')"}).first()
    assert rate.violations == 2 and rate.rate == 0.5
    assert {"AGEP_bin", "PINCP_bin", "SEX", "ESR"} <= set(validation.standard_variables(d))
    assert d.filter(expr.child_labour("AGEP", "ESR")).count() == 2


def test_distance_to_itself_is_zero(spark):
    d = _people(spark, esr=False)
    assert {r.tvd for r in validation.marginal_distances(d, d).collect()} == {0.0}
    long = validation.long_form(d, "puma", validation.standard_variables(d)).groupBy(F.col("group").alias("puma"), "variable", "category").agg(F.sum("w").cast("long").alias("target"))
    extra = spark.createDataFrame([("1", "ESR_16p", "employed", 1), ("2", "ESR_16p", "employed", 1)], "puma string, variable string, category string, target long")
    got = validation.target_distances(d, long.unionByName(extra), variables=["SEX", "AGEP_bin"]).collect()
    assert {r.variable for r in got} == {"SEX", "AGEP_bin"} and {r.tvd for r in got} == {0.0}


def test_tiers(spark):
    d = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate([0, 0, 0, 0, 0, 0, 1, 2, 3, 4])], "k int, g string, v double")
    assert {r.price_tier for r in tiers.quantile_tier(d, "g", "v", "k", 5).collect()} == {2, 4, 5}
    flat = d.withColumn("v", F.lit(7.0))
    assert {r.price_tier for r in tiers.quantile_tier(flat, "g", "v", "k", 5).collect()} == {3}
    assert tiers.quantile_tier(flat.limit(1), "g", "v", "k", 5).first().price_tier == 5
    lost = d.withColumn("g", F.lit(None).cast("string"))
    assert {r.price_tier for r in tiers.quantile_tier(lost, "g", "v", "k", 5).collect()} == {1}
    seven = spark.createDataFrame([(i, "g", float(i)) for i in range(7)], "k int, g string, v double")
    assert [r.desired_tier for r in tiers.income_tier(seven, "g", "v", "k", 5).orderBy("k").collect()] == [1, 2, 2, 3, 4, 4, 5]


def test_ranks_and_quantiles_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "a", 1.0), (4, None, 5.0), (5, "a", None)], "k int, g string, v double")
    r = {x.k: (x.rank, x.n) for x in ranks.ranked(d.filter("v is not null"), ["g"], "v", "k").collect()}
    assert r == {3: (0, 3), 1: (1, 3), 2: (2, 3), 4: (0, 1)}
    q = {x.g: list(x.q) for x in ranks.quantiles(d, ["g"], "v", "k", [0.0, 0.25, 1.0]).collect()}
    assert q == {"a": [1.0, 1.5, 2.0], None: [5.0, 5.0, 5.0]}


def test_reweighting(spark):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "k int, c string")
    t = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "category string, target double")
    w = {r.k: r.weight for r in calibration.reweighted(d, t, "c").collect()}
    assert w == {1: 1.0, 2: 1.0, 3: 2.0, 4: 0.0}
    with pytest.raises(ValueError):
        calibration.reweighted(d, t.withColumn("target", F.lit(0.0)), "c")
    same = calibration.resampled(d.withColumn("weight", F.lit(0.0)), "k")
    assert same.count() == 4 and same.first().weight == 1.0


def test_split_is_recreated_and_keeps_both_sides(spark):
    d = spark.createDataFrame([(i, str(i % 3) if i else "solo") for i in range(31)], "k int, g string")
    a = {r.k: r.part for r in allocation.split(d, "g", "k", 0.8, 5).collect()}
    assert a == {r.k: r.part for r in allocation.split(d.repartition(5), "g", "k", 0.8, 5).collect()}
    assert a[0] == "train" and sum(v == "holdout" for v in a.values()) == 6
    with pytest.raises(ValueError):
        allocation.split(d, "g", "k", 1.0)


def test_repair_changes_only_the_named_field(spark):
    d = _people(spark).withColumn("k", F.monotonically_increasing_id())
    donors = spark.createDataFrame([("1", 11, 0, "1", "6", 100), ("2", 40, 0, "1", "1", 101)], "puma string, AGEP long, PINCP long, SEX string, ESR string, k long")
    got = validation.repaired(d, donors, "AGEP < 16 AND ESR IN ('1','2','3')", ["ESR"], "puma", "k")
    fixed = got.filter("repaired").collect()
    assert {(r.puma, r.AGEP, r.ESR) for r in fixed} == {("1", 10, "6"), ("2", 12, "1")} and got.count() == 4


def test_spatial_join_plan_and_hole(spark):
    points = spark.createDataFrame([(1, 1.5, 1.2), (2, 2.5, 2.0), (3, 20.0, 20.0)], "k int, x double, y double")
    j = spatial.points_in_areas(points, places.areas(spark), "k", how="left")
    plan = j._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert {r.k: r.area_id for r in j.collect()} == {1: "A", 2: None, 3: None}
    cw = spatial.crosswalk(places.areas(spark), places.areas(spark).withColumnRenamed("area_id", "outer_id"), "area_id", "outer_id")
    assert cw.filter("from_id = to_id").count() >= 2
    with pytest.raises(ValueError):
        spatial.select_area(places.areas(spark), "nowhere")


def test_draw_plan(spark):
    p, b = _fixture(spark)
    plan = allocation.allocate(p, b, "capacity_only")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_portraits_and_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "bldg_id string, AGEP double, PINCP double, k int")
    assert portrait.portrait(empty).count() == 0
    assert portrait.distribution(empty, "AGEP", "k").count() == 0
    assert portrait.histogram(empty, "AGEP").count() == 0
    assert validation.pearson(empty, "AGEP", "PINCP").first().r is None
    assert validation.cramers_v(empty, "AGEP", "PINCP").first().v is None


def test_checks():
    class T:
        columns = ["a", "B"]

    assert first_present(T, ["x", "b"]) == "B"
    with pytest.raises(TypeError):
        require_columns(T, ["a"])
    assert split_requested(["q", "a"], ["a", "b"]) == (["a"], ["q"]) and split_requested(None, ["b", "a"]) == (["a", "b"], [])


def test_recode_labels():
    r = marginals.recodes()
    assert r["B01001"][0] == ("B01001_002E", "SEX", "1") and ("B01001_026E", "SEX", "2") in r["B01001"] and len(r["B01001"]) == 48
    for cell, label in (("003", "[0.0, 5.0)"), ("004", "[5.0, 18.0)"), ("030", "[5.0, 18.0)"), ("007", "[18.0, 25.0)"), ("024", "[75.0, 85.0)"), ("049", "[85.0, 1000.0)")):
        assert (f"B01001_{cell}E", "AGEP_bin", label) in r["B01001"]
    assert r["B19001"][-1] == ("B19001_017E", "HHINCP_bin", "[200000.0, inf)")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "parcels_offset0.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Parcel_ID":"7","Assessed_Value":"12.5"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}}]}')
    (tmp_path / "p" / "parcels_offset1.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    got = scans.parcels(spark, str(tmp_path / "p")).collect()
    assert len(got) == 1 and got[0].parcel_id == "7" and got[0].assessed_value == 12.5 and len(got[0].ring) == 5
    d = spark.createDataFrame([("b", 1.0, 2.0, None)], "bldg_id string, lon double, lat double, puma string")
    assert sinks.feature(d, "lon", "lat", ["bldg_id", "puma"]).first().value == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"bldg_id":"b"}}'
    sinks.rows(d, str(tmp_path / "o"))
    sinks.rows(d.union(d), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    (tmp_path / "c.csv").write_text("AGEP,SEX,PINCP,PUMA\n10,1,5,03202\n20,2,x,3202\n")
    c = microdata.cleaned(scans.persons(spark, str(tmp_path / "c.csv"), ["AGEP", "SEX", "PINCP", "PUMA"])).collect()
    assert len(c) == 1 and c[0].puma == "3202"


def test_hourly_stream(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "a.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    events = stream.read_events(spark, str(tmp_path / "in"), batch.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    q = stream.write_hours(stream.hourly_counts(events, "event_type", dwell="value"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.hour, r.area): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = mobility.hourly_visits(batch.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("area"), F.col("value").alias("dwell")), "area")
    full = {(r.hour, r.area): r.n for r in want.collect()}
    assert got and all(full[k] == n for k, n in got.items()) and len(got) >= 0.9 * len(full)


def test_bin_edges_can_be_given(spark):
    d = spark.createDataFrame([("1", 3.0), ("1", 70.0)], "puma string, AGEP double")
    got = {r.category for r in validation.long_form(d, "puma", validation.standard_variables(d, bin_edges={"AGEP": [0.0, 50.0, 100.0]})).collect()}
    assert got == {"[0.0, 50.0)", "[50.0, 100.0)"}
    assert {r.category for r in validation.long_form(d, "puma", validation.standard_variables(d)).collect()} == {"[0.0, 5.0)", "[65.0, 75.0)"}


@pytest.mark.parametrize("tie", ["id", "concat('k', lpad(id, 7, '0'))"])
def test_equal_values_are_dealt_to_many_buckets(spark, tie):
    """A constant column, and a column without values, fill as many buckets as any other, in the order of the tie key."""
    for value in (F.lit(5.0), F.lit(None).cast("double"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(2).cast("double")):
        d = spark.range(100_000).select(value.alias("v"), F.expr(tie).alias("k"))
        b = ranks.with_bucket(d, "v", "k")
        # a text's first bytes tell fewer keys apart
        assert b.select("_bucket").distinct().count() >= 16 or dict(d.dtypes)["k"] == "string"
        w = W.orderBy("v", "k")
        assert b.withColumn("before", F.lag("_bucket").over(w)).filter("before > _bucket").isEmpty()


def test_parts_of_the_unit_interval_meet(spark):
    d = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("i"), (F.col("id") % 13 / 7.0).alias("w"))
    parts = sorted((r.lo, r.hi) for r in allocation.weight_slices(d, ["g"], "i", F.col("w")).collect())
    assert parts[0][0] == 0.0 and parts[-1][1] == 1.0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_nearest_building_equals_brute_force(spark):
    """Clusters, equal buildings, outliers and missing values, in two features and one."""
    import random

    rng = random.Random(1)
    place = lambda: rng.choice([(rng.random(), rng.random()), (5 + rng.random() / 1000, 7.0), (rng.gauss(0, 50), rng.gauss(0, 1))])
    b = [(i, "ab"[i % 2], *place()) for i in range(400)] + [(900 + i, "a", 5.0, 7.0) for i in range(5)]
    p = [(i, "abc"[i % 3], *place()) for i in range(300)] + [(700, "a", 1e4, 0.0), (701, "a", None, 1.0)]
    bd, pd_ = spark.createDataFrame(b, "bldg_id long, g string, x double, y double"), spark.createDataFrame(p, "person_id long, g string, u double, v double")
    sd = bd.agg(F.stddev_pop("x"), F.stddev_pop("y")).first()
    for features, k in (({"u": "x", "v": "y"}, 2), ({"u": "x"}, 1)):
        got = {r.person_id: r.bldg_id for r in allocation.nearest_building(pd_, bd, "person_id", "bldg_id", "g", features).collect()}
        want = {}
        for i, g, *at in p:
            near = [(round(sum(((at[j] - x[j]) / sd[j]) ** 2 for j in range(k)), 9), n) for n, h, *x in b if h == g] if None not in at[:k] else []
            if near:
                want[i] = min(near)[1]
        assert got == want


def test_nearest_building_in_many_features(spark):
    """Eight features, clusters and outliers in some of them only; persons without any occupied cell near them."""
    import random

    rng = random.Random(2)
    n = 8
    centres = [[rng.gauss(0, 3) for _ in range(n)] for _ in range(12)]
    place = lambda: [round(x + rng.gauss(0, 0.05), 4) for x in rng.choice(centres)] if rng.random() < 0.9 else [round(rng.gauss(0, 9), 4) for _ in range(n)]
    b = [(i, "ab"[i % 2], *place()) for i in range(600)]
    b += [(900 + i, *b[i][1:]) for i in range(5)]
    p = [(i, "abc"[i % 3], *place()) for i in range(250)] + [(500, *b[3][1:]), (501, "a", *[1e3] * n), (502, "a", None, *[0.0] * (n - 1))]
    names = [f"x{i}" for i in range(n)]
    bd = spark.createDataFrame(b, "bldg_id long, g string, " + ", ".join(f"{c} double" for c in names))
    pd_ = spark.createDataFrame(p, "person_id long, g string, " + ", ".join(f"{c} double" for c in names))
    sd = bd.agg(*[F.stddev_pop(c) for c in names]).first()
    got = {r.person_id: r.bldg_id for r in allocation.nearest_building(pd_, bd, "person_id", "bldg_id", "g", {c: c for c in names}).collect()}
    want = {}
    for i, g, *at in p:
        near = [(round(sum(((at[j] - x[j]) / sd[j]) ** 2 for j in range(n)), 9), m) for m, h, *x in b if h == g] if None not in at else []
        if near:
            want[i] = min(near)[1]
    assert got == want


def test_train_and_holdout_are_not_empty(spark):
    d = spark.createDataFrame([("a", 1)], "g string, k long")
    with pytest.raises(ValueError, match="holdout"):
        allocation.train_and_holdout(d, "g", "k", 0.5)


def test_parcels_in_metres_become_degrees(spark, tmp_path):
    (tmp_path / "parcels_offset0.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"PIN":"1","SEV":"-3"},"geometry":{"type":"Polygon","coordinates":[[[-11169055.58,2800000.0],[-11169000,2800000],[-11169000,2800100]]]}}]}')
    r = scans.parcels(spark, str(tmp_path)).first()
    assert round(r.ring[0].x, 5) == -100.33333 and round(r.ring[0].y, 5) == 24.38179 and r.assessed_value == 0.0


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        lineage.shared_dir(Session())

def test_cosine_of_counts_beyond_the_root_of_a_long(spark):
    """The product of the two sums of squares is far beyond a long."""
    a = spark.createDataFrame([(h, 100_000 + h) for h in range(24)], "h int, n long")
    b = spark.createDataFrame([(h, 200_000 + 2 * h) for h in range(24)], "h int, n long")
    assert validation.cosine(a, b, "h", "n").first().cosine == pytest.approx(1.0, abs=1e-12)


def test_building_scores_move_no_pairs(spark):
    """Pairs of devices and buildings are not shuffled: no exchange in the plan stands over the join that makes them."""
    c = spark.createDataFrame([(i, i % 2, -83 + i / 100, 42.0) for i in range(30)], "caid long, z int, centre_lon double, centre_lat double")
    b = spark.createDataFrame([(j, j % 2, -83 + j % 9 / 50, 42 + j % 7 / 50) for j in range(2500)], "bldg_id long, z int, lon double, lat double")
    s = mobility.building_scores(c, b, "caid", "z")
    plan = s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Join") == 1 and "Exchange" not in plan[: plan.index("Join")]
    rows = s.collect()
    assert len(rows) == 30 * 1250 and len({(r.caid, r.bldg_id) for r in rows}) == len(rows)
    total = {}
    for r in rows:
        total[r.caid] = total.get(r.caid, 0.0) + r.score
    assert all(t == pytest.approx(1.0, abs=1e-9) for t in total.values())


def test_building_scores_of_one_place_are_taken_once(spark, monkeypatch):
    """Buildings of one place are lists: scores are made and rounded before their pairs are, which equal plain sums."""
    monkeypatch.setattr(mobility, "LIST_ROWS", 7)
    monkeypatch.setattr(mobility, "BLOCK_ROWS", 4)
    centres = [(i, i % 3, -83 + i / 100, 42 + i / 90) for i in range(20)] + [(90, None, -83.0, 42.0), (91, 1, None, 42.0)]
    blds = [(j, j % 2, -83 + j % 3 / 50, 42 + j % 2 / 50) for j in range(120)] + [(200 + j, 0, -83 + j / 40, 42.0) for j in range(9)]
    blds += [(None, 1, -83.0, 42.0), (None, 1, -83.0, 42.0), (300, 1, None, 42.0), (301, None, -83.0, 42.0)]
    c = spark.createDataFrame(centres, "caid long, z int, centre_lon double, centre_lat double")
    s = mobility.building_scores(c, spark.createDataFrame(blds, "bldg_id long, z int, lon double, lat double"), "caid", "z", digits=8)
    plan = s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.index("explode(_ids") < plan.index("round(") < plan.index("Join") and "EXP(" not in plan[: plan.index("explode(_ids")]

    def near(x, y, lon, lat):
        a = math.sin(math.radians(lat - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - x) / 2) ** 2
        return math.exp(1 / (1 + 2 * 6371.0088 * math.asin(math.sqrt(a))))

    want = []
    for k, z, x, y in centres:
        e = [(b, None if x is None or lon is None else near(x, y, lon, lat)) for b, area, lon, lat in blds if area == z and z is not None]
        want += [(k, b, None if v is None else v / sum(w for _, w in e if w is not None)) for b, v in e]
    key = lambda r: (r[0], r[1] is None, r[1] or 0, r[2] or 0.0)
    got = sorted(map(tuple, s.collect()), key=key)
    want.sort(key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 600
    assert all(g[2] is None and w[2] is None or g[2] == round(g[2], 8) and g[2] == pytest.approx(w[2], abs=6e-9) for g, w in zip(got, want, strict=True))


def test_building_scores_of_one_area_and_place_are_many_tasks(spark):
    c = spark.createDataFrame([(i, 1, -83.0, 42.0) for i in range(200)], "caid long, z int, centre_lon double, centre_lat double")
    b = spark.createDataFrame([(j, 1, -83.0, 42.5) for j in range(50)], "bldg_id long, z int, lon double, lat double")
    n = mobility.building_scores(c, b, "caid", "z").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in n) == 200 * 50 and len(n) > 2 and max(r["count"] for r in n) < 0.8 * 200 * 50
