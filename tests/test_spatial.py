"""Spatial joins against a ray cast over all edges, and how many cells an area needs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cityportrait.operators import spatial

SCHEMA = "area_id string, name string, part int, is_hole boolean, ring array<struct<x:double,y:double>>"


def rows_of(rings):
    return [(a, a, i, False, [(float(x), float(y)) for x, y in ring]) for i, (a, ring) in enumerate(rings)]


def by_hand(points, rings):
    out = set()
    for k, x, y in points:
        odd = {}
        for a, ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd[a] = odd.get(a, 0) + 1
        out |= {(k, a) for a, n in odd.items() if n % 2}
    return out


def joined(spark, points, rings, how="inner"):
    p = spark.createDataFrame(points, "k long, x double, y double")
    got = [(r.k, r.area_id) for r in spatial.points_in_areas(p, spark.createDataFrame(rows_of(rings), SCHEMA), "k", how=how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def star(n, r0, r1, cx=0.0, cy=0.0):
    return [(cx + (r0 if i % 2 else r1) * math.cos(2 * math.pi * i / n), cy + (r0 if i % 2 else r1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_shapes_equal_a_ray_cast(spark, seed):
    rng = random.Random(seed)
    rings = [("tri", [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(3)]) for _ in range(3)]
    rings += [("wild", [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(40)])]  # crosses itself
    rings += [("star", star(60, 3.0, 11.0)), ("star", star(30, 1.0, 2.0, 0.3, 0.2)), ("box", [(-4, -4), (4, -4), (4, 4), (-4, 4), (-4, -4)]), ("tiny", star(8, 1e-4, 2e-4, 3.0, 3.0))]
    # tall and flat teeth, whose edges span whole rows
    rings += [("comb", [p for i in range(60) for p in ((i / 10, -8), (i / 10 + 0.05, 8))] + [(6, -9), (0, -9)]), ("flat", [(-40, 1), (40, 1), (40, 1.001), (-40, 1.001)])]
    rings += [("far", [(x + 1e7, y + 2e7) for x, y in star(50, 100, 300)]), ("nothing", [(1, 1), (1, 1), (1, 1)])]
    points = [(i, rng.uniform(-12, 12), rng.uniform(-12, 12)) for i in range(1500)] + [(2000 + i, 1e7 + rng.uniform(-300, 300), 2e7 + rng.uniform(-300, 300)) for i in range(300)]
    # on corners, borders and cell borders
    points += [(3000 + i, float(x), float(y)) for i, (x, y) in enumerate([(-4, -4), (4, 4), (0, 4), (4, 0), (0, 0), (-4, 0), (0, -4), (1, 1), (0.25, 0.25), (3.0, 3.0)])]
    points += [(4000 + i, rng.randrange(-40, 40) / 4, rng.randrange(-40, 40) / 4) for i in range(300)]
    assert joined(spark, points, rings) == by_hand(points, rings)


def test_points_without_a_place_and_no_areas(spark):
    points = [(1, None, 0.0), (2, float("nan"), 0.0), (3, 0.0, float("inf")), (4, 0.5, 0.5)]
    box = [("box", [(0, 0), (1, 0), (1, 1), (0, 1)])]
    assert joined(spark, points, box, "left") == {(1, None), (2, None), (3, None), (4, "box")}
    assert joined(spark, points, [], "left") == {(k, None) for k in range(1, 5)} and joined(spark, points, []) == set()


def test_a_ring_of_many_corners_has_as_many_cells(spark):
    n = 100_000
    rng = random.Random(4)
    ring = [(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [1000 + rng.uniform(-1, 1)]]
    areas = spark.createDataFrame(rows_of([("big", ring)]), SCHEMA)
    edges = spatial._edges(areas, "area_id")
    rows = spatial._rows(edges)
    border = spatial._border(rows).cache()
    inner, bands = spatial._inner(border).count(), spatial._bands(rows)[1]
    most = bands.agg(F.sum(F.size("edges")).alias("all"), F.max(F.size("edges")).alias("most")).first()
    assert edges.count() == n and border.count() < 3 * n and inner < 3 * n and most["all"] < 8 * n and most["most"] < n / 50
    p = spark.createDataFrame([(i, rng.uniform(-1002, 1002), rng.uniform(-1002, 1002)) for i in range(4000)], "k long, x double, y double")
    got = {r.k for r in spatial.points_in_areas(p, areas, "k").collect()}
    sure = {r.k: math.hypot(r.x, r.y) for r in p.collect()}
    assert {k for k, d in sure.items() if d < 998} <= got and not {k for k, d in sure.items() if d > 1002} & got
    # those near the border against all edges
    close = [(r.k, r.x, r.y) for r in p.collect() if 998 <= math.hypot(r.x, r.y) <= 1002]
    assert {k for k, _ in by_hand(close, [("big", ring)])} == got & {k for k, *_ in close}


def test_a_detail_on_a_large_area_keeps_its_lists_short(spark):
    """Most corners in one row of the area's cells: the row is halved until its lists are short."""
    n = 4000
    detail = [(1e-3 * math.cos(i), 5 + 2e-3 * i / n) for i in range(n)]
    ring = [(-100, -100), (100, -100), (100, 100), (-100, 100), *reversed(detail)]
    areas = spark.createDataFrame(rows_of([("a", ring)]), SCHEMA)
    bands = spatial._bands(spatial._rows(spatial._edges(areas, "area_id")))[1]
    s = bands.agg(F.sum(F.size("edges")).alias("all"), F.max(F.size("edges")).alias("most")).first()
    assert s["all"] < 8 * n and s["most"] < n / 8
    points = [(i, random.Random(i).uniform(-2e-3, 2e-3), 5 + random.Random(-i).uniform(0, 2e-3)) for i in range(300)]
    assert joined(spark, points, [("a", ring)]) == by_hand(points, [("a", ring)])

def test_centroids_on_a_border_stay_on_it(spark):
    """Centres of squares on the slope y = 0.8 (x - 7) + 2 and on other borders: the centroid is the centre to its last digit."""
    at = [(i / 1000, (0.8 * (i - 7000) + 2000) / 1000) for i in range(7005, 7700, 5)] + [(i / 1000, 7.0) for i in range(5000, 6000, 7)]
    h = 0.25
    rows = [(k, False, [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]) for k, (x, y) in enumerate(at)]
    d = spark.createDataFrame(rows, "area_id int, is_hole boolean, ring array<struct<x:double,y:double>>")
    got = {r.area_id: (r.x, r.y) for r in spatial.area_centroids(d).collect()}
    exact = {k: p for k, p in enumerate(at) if all(v + h - h == v and v - h + h == v for v in p)}
    assert len(exact) > 200 and {k: got[k] for k in exact} == exact


def test_centroids_of_squares_whose_corners_were_rounded(spark):
    """Half of all x + 0.25 are no doubles: the square's centre is x nevertheless, in both directions of the ring."""
    at = [i / 1000 for i in range(125, 10_011)]
    lost = [v for v in at if v + 0.25 - 0.25 != v]
    assert len(lost) > 500
    ring = lambda v, w: [(v - 0.25, w - 0.25), (v + 0.25, w - 0.25), (v + 0.25, w + 0.25), (v - 0.25, w + 0.25)]
    rows = [(k, False, ring(v, at[-k - 1])[:: 1 - k % 2 * 2]) for k, v in enumerate(at)]
    rows += [(-1, False, []), (-2, False, None), (-3, False, [(0.0, 0.0), (0.0, 0.0)]), (-4, False, [(-5e-324, 0.0), (5e-324, 0.0), (0.0, 5e-324)])]
    d = spark.createDataFrame(rows, "area_id int, is_hole boolean, ring array<struct<x:double,y:double>>")
    got = {r.area_id: (r.area, r.x, r.y) for r in spatial.area_centroids(d).collect()}
    assert [(k, v, got[k]) for k, v in enumerate(at) if got[k] != (0.25, v, at[-k - 1])] == []
    assert got[-1][1:] == got[-2][1:] == got[-3][1:] == got[-4][1:] == (None, None)


def test_centroids_of_several_rings(spark):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = [("a", False, box(1e6, 1e6, 4.0)), ("a", False, box(1e6 + 8, 1e6, 4.0)), ("a", True, box(1e6, 1e6, 2.0)), ("b", False, []), ("c", False, box(0.0, 0.0, 2.0)), ("c", True, box(0.0, 0.0, 1.0))]
    d = spark.createDataFrame(rows, "area_id string, is_hole boolean, ring array<struct<x:double,y:double>>")
    got = {r.area_id: (r.area, r.x, r.y) for r in spatial.area_centroids(d).collect()}
    # the same sums by hand: 16 at 2, 16 at 10, less 4 at 1
    assert got["a"] == pytest.approx((28.0, 1e6 + (32 + 160 - 4) / 28, 1e6 + (32 + 32 - 4) / 28), rel=1e-12)
    assert got["b"][0] == 0.0 and got["b"][1] is None
    assert got["c"] == pytest.approx((3.0, (4 - 0.5) / 3, (4 - 0.5) / 3), rel=1e-12)


def overlapping(n):
    """n unit squares around few places, many of them on each other, and points on and off their borders."""
    rng = random.Random(n)
    rings = [(f"{i:06d}", [(cx - 0.5, cy - 0.5), (cx + 0.5, cy - 0.5), (cx + 0.5, cy + 0.5), (cx - 0.5, cy + 0.5)]) for i in range(n) for cx, cy in [(i * 37 % 97 / 10, i * 53 % 89 / 10)]]
    return rings, [(i, rng.randrange(-20, 110) / 10, rng.uniform(-2, 11)) for i in range(200)] + [(900, None, 1.0)]


def test_overlapping_areas_all_and_the_largest(spark):
    rings, points = overlapping(600)
    want = by_hand(points[:-1], rings)
    hit = {k for k, _ in want}
    assert joined(spark, points, rings) == want
    assert joined(spark, points, rings, "left") == want | {(k, None) for k, *_ in points if k not in hit}
    assert joined(spark, points, rings, "largest") == {(k, max(a for j, a in want if j == k)) for k in hit}


def test_overlapping_areas_give_few_candidates(spark):
    """A point meets about as many areas as hold it, and a few where only the largest counts."""
    rings, points = overlapping(600)
    p = spark.createDataFrame(points, "k long, x double, y double")
    cells, _ = spatial._cells(spark.createDataFrame(rows_of(rings), SCHEMA), "area_id")
    grids = [tuple(r) for r in cells.select("e", "size", "k").distinct().collect()]
    placed = spatial._placed(p, "k", "x", "y", grids)
    met = placed.join(cells, spatial.CELL).count()
    assert met < 2.5 * len(by_hand(points[:-1], rings))
    assert placed.join(spatial._largest(cells, [0]), spatial.CELL).count() < met / 2


def test_areas_of_one_ring_are_decided_once(spark, monkeypatch):
    """Many areas of few rings, in lists of three: every pair comes, once, with the area's columns; cells are those of the rings."""
    monkeypatch.setattr(spatial, "MEMBERS", 3)
    box = lambda x, y: [(x, y), (x + 2, y), (x + 2, y + 1), (x, y + 1)]
    rings = [(f"{i:03d}", box(i % 3, i % 2)) for i in range(40)]
    # areas of several rings stay their own, also where their rings are those of others or cancel each other
    rings += [("two", box(0, 0)), ("two", box(5, 5)), ("too", box(0, 0)), ("too", box(5, 5)), ("none", box(1, 1)), ("none", box(1, 1))]
    rng = random.Random(5)
    points = [(i, rng.uniform(-1, 8), rng.uniform(-1, 7)) for i in range(150)] + [(200 + i, i % 6, i // 6) for i in range(24)] + [(300, None, 0.0)]
    points = [(k, x if x is None else float(x), float(y)) for k, x, y in points]
    want = by_hand(points[:-1], rings)
    hit = {k for k, _ in want}
    assert joined(spark, points, rings) == want
    assert joined(spark, points, rings, "left") == want | {(k, None) for k, *_ in points if k not in hit}
    assert joined(spark, points, rings, "largest") == {(k, max(a for j, a in want if j == k)) for k in hit}
    areas = spark.createDataFrame(rows_of(rings), SCHEMA).withColumn("n", F.length("area_id")).withColumn("text", F.concat(F.lit("<"), "area_id"))
    p = spark.createDataFrame(points, "k long, x double, y double")
    got = spatial.points_in_areas(p, areas, "k", how="left", more=["n", "text"])
    assert got.columns == ["k", "area_id", "n", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(k, a, len(a), f"<{a}") for k, a in want] + [(k, None, None, None) for k, *_ in points if k not in hit], key=repr)
    with pytest.raises(ValueError):
        spatial.points_in_areas(p, areas, "k", how="largest", more=["n"])
    alone = spatial._alike(areas, "area_id", [])[0]
    assert sorted(r.a for r in alone.collect()) == ["034", "035", "036", "037", "038", "039", "none", "none", "too", "too", "two", "two"]


@pytest.mark.parametrize("join", ["10m", "-1"])
def test_the_join_of_points_and_cells_is_compiled(spark, join):
    """The JVM interprets methods of more than 8,000 bytes."""
    rings, points = overlapping(50)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", join)
        p = spark.createDataFrame(points, "k long, x double, y double")
        areas = spark.createDataFrame(rows_of(rings), SCHEMA)
        for how, more in (("left", ["name"]), ("inner", []), ("largest", [])):
            plan = spatial.points_in_areas(p, areas, "k", how=how, more=more)._jdf.queryExecution()
            text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
            sizes = [int(s.split(";")[0]) for s in text.split("maxMethodCodeSize:")[1:]]
            assert len(sizes) > 2 and max(sizes) < 8_000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
