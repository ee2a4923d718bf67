"""Spatial joins as equi-joins on cells of each area's own grid, with ray casting in border cells only.

Areas are ring tables (area_id, part, is_hole, ring). A point matches an area if the ray crosses the rings of its
parts, holes among them, an odd number of times; left and lower borders count as inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cityportrait.functions import expr, geo
from cityportrait.operators.lineage import settled

#: Edges of a border cell, about: they set an area's cell size, which is a power of GROW; rows of more edges are halved.
EDGES, GROW, BAND_EDGES = 8, 4, 8
#: Cells along an area's border at least, so that a cell is a small part of an area of few corners.
LEAST_CELLS = 16
CELL = ["e", "k", "cy", "cx"]
#: Areas of one ring in a list, about.
MEMBERS = 1_000
MOST_HALVINGS = 40


def _alike(areas: DataFrame, area_id: str, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """(a, ring): of areas with the same single ring only the last one; and (a, members): for each of these, the areas
    of its ring as structs (_id and the columns of `more`), in lists of about MEMBERS.

    So a ring that many areas have is cut into cells once, and a point is tested once for all of them.
    """
    m = areas.select(F.col(area_id).alias("a"), "ring", F.struct(F.col(area_id).alias("_id"), *more).alias("m")).filter("a IS NOT NULL")
    m = m.groupBy("a").agg(F.count("*").alias("n"), F.first("ring").alias("ring"), F.first("m").alias("m"))
    one, parts = m.filter("n = 1").select("a", "ring", "m"), m.filter("n > 1").select("a", "m")
    shapes = one.groupBy("ring").agg(F.max("a").alias("s"), F.count("*").alias("n"))
    dealt = one.join(shapes, "ring").select(F.col("s").alias("a"), F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / MEMBERS)).alias("deal"), "m")
    members = dealt.unionByName(parts.select("a", F.lit(0).cast("long").alias("deal"), "m")).groupBy("a", "deal").agg(F.collect_list("m").alias("members"))
    rings = shapes.select(F.col("s").alias("a"), "ring").unionByName(areas.select(F.col(area_id).alias("a"), "ring").join(parts.select("a"), "a", "left_semi"))
    return rings, members.drop("deal")


def _edges(areas: DataFrame, area_id: str) -> DataFrame:
    """(a, e, size, x1, y1, x2, y2): every edge once, written, with the cell size that its area's border asks for."""
    e = areas.select(F.col(area_id).alias("a"), F.inline(geo.edges(F.col("ring")))).dropna()
    extent = F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))
    sizes = e.groupBy("a").agg(F.count("*").alias("n"), extent.alias("w")).filter("w > 0")
    # the slack keeps equal areas at different places on one grid
    power = F.floor(F.log(F.col("w") * F.least(EDGES / F.col("n"), F.lit(1 / LEAST_CELLS))) / math.log(GROW) + 1e-9).cast("int")
    sizes = sizes.select("a", power.alias("e")).withColumn("size", F.pow(F.lit(float(GROW)), F.col("e")))
    return settled(e.join(sizes, "a"))


def _rows(edges: DataFrame) -> DataFrame:
    """The edges by row of their area's cells: cy, and the part of the edge in it (lo, hi along y, cx0 to cx1 along x)."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    r = edges.withColumn("cy", F.explode(F.sequence(F.floor(low / F.col("size")), F.floor(high / F.col("size")))))
    r = r.withColumns({"lo": F.greatest(low, F.col("cy") * F.col("size")), "hi": F.least(high, (F.col("cy") + 1) * F.col("size"))})
    at = lambda y: F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    flat = F.col("y1") == F.col("y2")
    xa, xb = F.when(flat, F.col("x1")).otherwise(at("lo")), F.when(flat, F.col("x2")).otherwise(at("hi"))
    # a cell too many at the side of an edge costs a ray cast, one too few would be wrong
    slack = F.col("size") * 1e-6 + F.greatest(F.abs("x1"), F.abs("x2")) * 1e-14
    return r.withColumns({"cx0": F.floor((F.least(xa, xb) - slack) / F.col("size")), "cx1": F.floor((F.greatest(xa, xb) + slack) / F.col("size"))})


def _border(rows: DataFrame) -> DataFrame:
    """(a, e, size, cy, cx, odd, next): the cells that edges touch. Where `next` is not the following cell, there is a
    gap without edges; it is inside if `odd`: an odd number of edges cross the middle of the row up to here."""
    middle = (F.col("cy") + 0.5) * F.col("size")
    crosses = (F.col("y1") > middle) != (F.col("y2") > middle)
    x = (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    own = F.when(crosses, F.greatest(F.least(F.floor(x / F.col("size")), F.col("cx1")), F.col("cx0")))
    c = rows.withColumn("own", own).withColumn("cx", F.explode(F.sequence("cx0", "cx1")))
    c = c.groupBy("a", "e", "size", "cy", "cx").agg(F.count_if(F.col("own") == F.col("cx")).alias("n"))
    w = W.partitionBy("a", "e", "size", "cy").orderBy("cx")
    return c.withColumns({"odd": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) % 2 == 1, "next": F.lead("cx").over(w)}).drop("n")


def _inner(border: DataFrame) -> DataFrame:
    """(a, e, size, k, cy, cx): the gaps inside, cut into runs of GROW ** k cells that begin at a multiple of it."""
    g = border.filter("odd AND next > cx + 1").select("a", "e", "size", "cy", (F.col("cx") + 1).alias("p"), F.col("next").alias("q"))
    g = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("q") - F.col("p")) / 2).cast("int"))))
    # runs of this length lie from f to t, those of the next length cover from c to d
    up, down = "-shiftright(-{v}, {s})", "shiftright({v}, {s})"
    g = g.withColumns({n: F.expr(how.format(v=v, s=s)) for n, how, v, s in (("f", up, "p", "2 * k"), ("t", down, "q", "2 * k"), ("c", up, "p", "2 * k + 2"), ("d", down, "q", "2 * k + 2"))})
    some = lambda lo, hi: F.expr(f"CASE WHEN {lo} < {hi} THEN sequence({lo}, {hi} - 1) ELSE cast(array() AS array<bigint>) END")
    runs = F.when(F.col("c") < F.col("d"), F.concat(some("f", "4 * c"), some("4 * d", "t"))).otherwise(some("f", "t"))
    return g.select("a", "e", "size", "k", "cy", F.explode(runs).alias("cx"))


def _bands(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, cy, halvings) and (a, cy, band, edges): the edges of a row, halved along y as long as that makes lists shorter.

    Edges as high as the row stay in all its bands, so a row has at most four times its edges.
    """
    r = rows.filter("y1 <> y2")
    high = F.sum((F.col("hi") - F.col("lo")) / F.col("size"))
    h = r.groupBy("a", "cy").agg(F.count("*").alias("n"), high.alias("s"))
    halvings = F.least(F.floor(F.log2(3 * F.col("n") / F.greatest("s", F.lit(1e-12)))), F.lit(MOST_HALVINGS))
    h = h.select("a", "cy", F.when(F.col("n") > BAND_EDGES, F.greatest(halvings, F.lit(0))).otherwise(0).cast("int").alias("halvings"))
    b = r.join(h, ["a", "cy"])
    band = lambda y: F.floor(F.col(y) / F.col("size") * F.pow(F.lit(2.0), F.col("halvings")))
    b = b.withColumn("band", F.explode(F.sequence(band("lo"), band("hi"))))
    return h, b.groupBy("a", "cy", "band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))


def _cells(areas: DataFrame, area_id: str) -> tuple[DataFrame, DataFrame]:
    """The areas' cells, written: (a, e, size, k, cy, cx, inside, halvings, edges), and the bands of rows with more edges.

    A border cell has the edges of its row where these are BAND_EDGES at most, as `_flat` numbers; else `edges` is null
    and the row's bands have them. A row with flat edges only holds no point.
    """
    rows = _rows(_edges(areas, area_id))
    halvings, bands = _bands(rows)
    border = _border(rows)
    short = bands.filter((F.col("band") == F.col("cy")) & (F.size("edges") <= BAND_EDGES)).join(halvings.filter("halvings = 0").drop("halvings"), ["a", "cy"]).select("a", "cy", _flat(F.col("edges")).alias("edges"))
    touched = border.join(halvings, ["a", "cy"]).join(short, ["a", "cy"], "left").select("a", "e", "size", F.lit(0).alias("k"), "cy", "cx", F.lit(False).alias("inside"), "halvings", "edges")
    inner = _inner(border).select("a", "e", "size", "k", "cy", "cx", F.lit(True).alias("inside"), F.lit(None).cast("int").alias("halvings"), F.lit(None).cast(dict(short.dtypes)["edges"]).alias("edges"))
    return settled(touched.unionByName(inner)), bands


def _largest(cells: DataFrame, lengths: list[int]) -> DataFrame:
    """The cells that a point's largest area may come from.

    A cell's points are in all areas that it is inner to, so only the largest of these stays, and of the areas whose
    border it has only larger ones. Every point keeps an area if it has any.
    """
    names = cells.columns
    best = cells.filter("inside").groupBy(*CELL).agg(F.max_by(F.struct(*names), "a").alias("_c")).select("_c.*")
    border = cells.filter("NOT inside")
    at = border.select("e", "cy", "cx").distinct().withColumn("k", F.explode(F.array(*map(F.lit, lengths)))).withColumn("_cx", F.col("cx")).withColumn("cx", F.expr("shiftright(cx, 2 * k)"))
    known = at.join(best.select(*CELL, F.col("a").alias("_best")), CELL).groupBy("e", "cy", F.col("_cx").alias("cx")).agg(F.max("_best").alias("_best"))
    border = border.join(known, ["e", "cy", "cx"], "left").filter("_best IS NULL OR a > _best").select(*names)
    return settled(border.unionByName(best))


#: Numbers of an edge in a flat list: where it begins and ends along y, its first corner, its extent.
EDGE = ("lo", "hi", "x1", "y1", "dx", "dy")


def _flat(edges: Column) -> Column:
    number = lambda e: F.array(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]), e["x1"], e["y1"], e["x2"] - e["x1"], e["y2"] - e["y1"])
    return F.flatten(F.transform(edges, number))


def _odd(x: str, y: str) -> Column:
    """Whether a ray crosses an odd number of a cell's edges, BAND_EDGES at most.

    Plain functions of flat numbers: the code that Spark makes of a join with it must stay below the 8,000 bytes that the
    JVM compiles, else every pair is interpreted (tested).
    """
    n = F.lit(0)
    for i in range(BAND_EDGES):
        e = {name: F.get("edges", F.lit(i * len(EDGE) + j)) for j, name in enumerate(EDGE)}
        crosses = (e["lo"] <= F.col(y)) & (F.col(y) < e["hi"]) & (F.col(x) < F.try_divide(e["dx"] * (F.col(y) - e["y1"]), e["dy"]) + e["x1"])
        n = n.bitwiseXOR(F.when(crosses, 1).otherwise(0))
    return n == 1


def _placed(points: DataFrame, key: str, x: str, y: str, grids: list[tuple[int, float, int]]) -> DataFrame:
    """(_key, _px, _py, e, k, cy, cx): every point with its cell on each grid."""
    p = points.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).filter(expr.finite("_px") & expr.finite("_py"))
    p = p.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(size).alias("size"), F.lit(k).alias("k")) for e, size, k in sorted(grids)])))
    return p.select("_key", "_px", "_py", F.col("_g.e").alias("e"), F.col("_g.k").alias("k"), F.floor(F.col("_py") / F.col("_g.size")).alias("cy"), F.expr("shiftright(floor(_px / _g.size), 2 * _g.k)").alias("cx"))


def _pairs(p: DataFrame, cells: DataFrame, bands: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(_key, a) of the points in the areas of `cells`; with `members` (_key, _id, more) of all areas in its lists. Pairs
    are decided in the task that makes them and not moved, except for those in rows of more than BAND_EDGES edges."""
    # pairs may be many more than the rows they come from, so tasks are not merged by the rows' size
    tasks = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short, rest = cells.filter("inside OR edges IS NOT NULL"), cells.filter("NOT inside AND edges IS NULL")
    found = ["_key", "a"] if members is None else ["_key", F.inline("members")]
    if members is not None:
        short = short.join(members, "a")
    held = p.repartition(tasks, *CELL).join(short.repartition(tasks, *CELL), CELL).filter(F.col("inside") | _odd("_px", "_py")).select(*found)
    if rest.isEmpty():
        return held
    near = p.join(rest, CELL).withColumn("band", F.floor(F.col("_py") / F.col("size") * F.pow(F.lit(2.0), F.col("halvings"))))
    cast = near.drop("edges").join(bands, ["a", "cy", "band"]).filter(geo.crossings_of(F.col("_px"), F.col("_py"), F.col("edges")) % 2 == 1)
    if members is not None:
        cast = cast.select("_key", "a").join(members, "a")
    return held.unionByName(cast.select(*found))


def points_in_areas(points: DataFrame, areas: DataFrame, key: str, area_id: str = "area_id", x: str = "x", y: str = "y", how: str = "inner", more: list[str] | None = None) -> DataFrame:
    """(key, area_id) of every area that holds the point; with how="left" also points without one, with null; with
    how="largest" only the largest area_id of each point.

    Each area has a grid of its own size, so its cells are as many as its edges, whatever its extent. A point meets the
    cells of its place by an equi-join: in a cell without edges it is inside without further tests, in a border cell
    the edges of its row tell. Every point has one cell of an area, so no pair comes twice. Areas of the same ring are
    one until the pairs are made. `more` names columns of the areas, alike in all rows of one, that its pairs get: the
    pairs may be many more than the areas, and need no join then.
    """
    more = more or []
    if more and how == "largest":
        raise ValueError("the largest area's columns are not known: its pairs are decided by the areas' rings only")
    rings, members = _alike(areas, area_id, more)
    cells, bands = _cells(rings, "a")
    # one pair for each cell size and length of runs: powers, so a few dozen
    grids = [(r.e, r.size, r.k) for r in cells.select("e", "size", "k").distinct().collect()]
    nulls = [F.lit(None).cast(areas.schema[c].dataType).alias(c) for c in (area_id, *more)]
    if not grids:
        return points.select(key, *nulls).filter(F.lit(how == "left")).distinct()
    p = _placed(points, key, x, y, grids)
    if how == "inner":
        return _pairs(p, cells, bands, settled(members)).toDF(key, area_id, *more)
    few = _largest(cells, sorted({k for *_, k in grids}))
    if how == "largest":
        return _pairs(p, few, bands).groupBy("_key").agg(F.max("a").alias("a")).toDF(key, area_id)
    # which points have an area is known by the few cells, so the pairs themselves are not moved
    none = points.select(key).distinct().join(_pairs(p, few, bands).select(F.col("_key").alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    hit = _pairs(p, cells, bands, settled(members)).filter("_key IS NOT NULL").toDF(key, area_id, *more)
    return hit.unionByName(none.select(key, *nulls))


def area_centroids(areas: DataFrame, area_id: str = "area_id") -> DataFrame:
    """(area_id, area, x, y): holes are taken off, parts are added up.

    Moments are taken from each ring's origin. Where all rings of an area have one origin, so in any area of one ring,
    the centroid is that place and a shift, exact to its last digit: one on a border stays there, and where opposite
    corners were rounded, it is the place that they lie around.
    """
    r = areas.select(area_id, F.when(F.col("is_hole"), -1.0).otherwise(1.0).alias("_sign"), geo.origin(F.col("ring")).alias("_from"), geo.from_origin(F.col("ring")).alias("_near"))
    r = r.select(area_id, "_sign", "_from", geo.moments(F.col("_near")).alias("_of"))
    size, turn = F.col("_sign") * F.abs("_of.area"), F.col("_sign") * F.when(F.col("_of.area") < 0, -1.0).otherwise(1.0)
    sums = [F.sum(size).alias("area")]
    for axis in "xy":
        corner = F.col(f"_from.{axis}")
        sums += [F.min(corner).alias(f"_lo{axis}"), F.max(corner).alias(f"_hi{axis}"), F.sum(size * corner).alias(f"_at{axis}"), F.sum(turn * F.col(f"_of.{axis}")).alias(f"_m{axis}")]
    s = r.groupBy(area_id).agg(*sums)
    place = lambda axis: F.when(F.col(f"_lo{axis}") == F.col(f"_hi{axis}"), F.col(f"_lo{axis}")).otherwise(F.try_divide(f"_at{axis}", "area")) + F.try_divide(f"_m{axis}", "area")
    return s.select(area_id, "area", place("x").alias("x"), place("y").alias("y"))


def crosswalk(inner: DataFrame, outer: DataFrame, inner_id: str = "area_id", outer_id: str = "area_id") -> DataFrame:
    """(from_id, to_id): the outer area that holds each inner area's centroid; of several the last; unmatched ones go."""
    points = area_centroids(inner, inner_id).select(F.col(inner_id).alias("from_id"), "x", "y")
    return points_in_areas(points, outer.withColumnRenamed(outer_id, "to_id"), "from_id", "to_id", how="largest")


def inside_area(points: DataFrame, areas: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """The points, all columns, that lie in any of the areas."""
    return points.join(points_in_areas(points, areas, key, x=x, y=y, how="largest").select(key), key, "left_semi")


def select_area(areas: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Areas of exactly this name, whatever its case; else those that contain it; an error if there are none."""
    n = F.lower(F.trim(F.col(column)))
    wanted = name.strip().lower()
    exact = areas.filter(n == wanted)
    found = exact if not exact.isEmpty() else areas.filter(n.contains(wanted))
    if found.isEmpty():
        raise ValueError(f"no area named {name!r}")
    return found


def best_per_key(matches: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """One row per key: the one of largest value, of equals the one of smallest tie column."""
    best = F.max_by(F.struct(*matches.columns), F.struct(F.coalesce(F.col(value), F.lit(float("-inf"))), -F.xxhash64(tie), F.col(tie).cast("string")))
    if dict(matches.dtypes)[tie] in ("int", "bigint", "double", "float"):
        best = F.max_by(F.struct(*matches.columns), F.struct(F.coalesce(F.col(value), F.lit(float("-inf"))), -F.col(tie)))
    return matches.groupBy(key).agg(best.alias("_b")).select("_b.*")
