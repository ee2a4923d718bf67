"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles. Its sketch has T coordinates: in round i every shingle is hashed
to a bin and a value, a bin keeps the smallest value of the first round that reached it, and from round T on bin
i - T takes every shingle, so each coordinate is filled. Sets with the same sketch coordinates in one of the bands
are candidates; a link counts once the full sets confirm it.

Equal sets are one class and meet only once. Each class is first checked against the pivot it meets in most bands,
a pivot being the member of a bucket that meets most others. What then remains between components is narrowed by an
exact rule on how two sets differ from their group's centre, joined on the rare differences only (see
_between_components), so a group of many near copies is not expanded into its pairs, and no link between components is
lost. Where most documents of a group share many differences with each other and yet are too far apart to be linked,
as pages filled in from one list of a few dozen phrases, most of their pairs do meet and are checked. Keys that many rows share (a large group's bands, pivot, centre and representative) are joined in
parts. Sketches miss a pair at a similarity of 0.8 with probability (1 - 0.8**8)**64, below 8e-6 (see bands_for).

Cases: null and empty texts have an empty set, link with nothing and stay; one word is a set of one; repeated rows of
a doc_id count as one document, with different texts by the first of them in order; rows without a doc_id are never linked and stay; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cityportrait.llm.common import hot_keys, mapped, small_or, spread_join, written

SHINGLE = 2
PERCENT = 80
T = 512
#: A pair at the threshold shares no band with this probability at most.
MISSED = 1e-5
SLICE_BYTES = 4 << 20
MAX_BROADCAST_IDS = 500_000
#: Members that a group's centre is taken from.
VOTERS = 16

_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64((1 << 54) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = max(len(w) - k + 1, 1)
    out = np.full(n, np.uint64(min(len(w), k)))
    for j in range(min(len(w), k)):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) ^ h[j : j + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t coordinates per non-empty set."""
    out = np.full(len(sets) * t, _EMPTY)
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    check = 1
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = mixed(values ^ mixed(np.uint64(i) * np.uint64(0xA0761D6478BD642F) + np.zeros(1, np.uint64)))
            bins = (h >> np.uint64(54)).astype(np.int64) % t if i < t else i - t
            np.minimum.at(out, doc * t + bins, (np.uint64(i) << np.uint64(54)) | (h & _LOW))
            if i + 1 == check:
                # a filled set needs no more rounds: a later round never lowers a coordinate
                open_ = (out.reshape(-1, t) == _EMPTY).any(axis=1)
                stay = open_[doc]
                if not stay.any():
                    break
                if not stay.all():
                    values, doc = values[stay], doc[stay]
                check = i + 1 + max(1, (i + 1) // 4)
    return out.reshape(-1, t)


def bands_for(percent: int) -> int:
    """The number of bands that T coordinates make: as few as MISSED allows at this similarity; 64 of 8 rows at 80."""
    for rows in (64, 32, 16, 8, 4, 2):
        if (1 - (percent / 100) ** rows) ** (T // rows) <= MISSED:
            return T // rows
    return T


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = sketch.reshape(len(sketch), bands, -1)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2]).copy()
        for j in range(s.shape[2]):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) ^ s[:, :, j])
    return key


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Parts of a batch of about SLICE_BYTES of text."""
    ids, texts, start, size = batch.column(0), batch.column(1), 0, 0
    for i in range(batch.num_rows):
        size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if size >= SLICE_BYTES or i == batch.num_rows - 1:
            yield ids[start : i + 1], texts[start : i + 1].to_pylist()
            start, size = i + 1, 0


SKETCH_SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _sketch_batches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for ids, texts in _slices(batch):
            with np.errstate(over="ignore"):
                sets = [shingle_set(t, hashes, shingle) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            n = np.array([len(s) for s in sets], np.int64)
            keys = np.zeros((len(sets), 2), np.int64)
            for i in full:
                keys[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
            values = band_keys(sketches([sets[i] for i in full]), bands) if full else np.empty((0, bands), np.uint64)
            offsets = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)))],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for ids, texts in _slices(batch):
            with np.errstate(over="ignore"):
                sets = [shingle_set(t, hashes, shingle) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "hashes"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id in a link.

    Alternating large and small stars; each round is a written table, and no group is gathered in one task.
    """
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(small.union(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, hashes): the shingle sets of the documents whose id is in the written table `ids`. No other text is read."""
    near, _ = small_or(ids, MAX_BROADCAST_IDS)
    picked = docs.select("doc_id", "text").join(near, F.col("doc_id") == F.col("id"), "left_semi")
    # only texts of ids that stand in several rows are moved
    twice = written(picked.groupBy(F.col("doc_id").alias("_twice")).count().filter("count > 1").select("_twice"))
    twice, _ = small_or(twice, MAX_BROADCAST_IDS)
    again = F.col("doc_id") == F.col("_twice")
    first = picked.join(twice, again, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    once = picked.join(twice, again, "left_anti").unionByName(first)
    return written(mapped(once, partial(_set_batches, shingle=shingle), "id long, hashes array<long>"))


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of a written table whose full shingle sets are similar enough; one document may be in most pairs."""
    n = pairs.count()
    hot_a, hot_b = (hot_keys(pairs.groupBy(x).count(), n) for x in ("a", "b"))
    both = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), ["a"], ["b"], hot_a)
    both = spread_join(both, sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), ["b"], ["a"], hot_b)
    both = both.withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return both.filter(100 * F.col("i") >= percent * (F.size("ha") + F.size("hb") - F.col("i"))).select("a", "b")


def _pivot(degree: str = "degree", doc: str = "doc_id"):
    return F.max_by(doc, F.struct(degree, -F.col(doc)))


def _differences(members: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """(g, id, c, w, slack, delta) of the members (g, id, c): how each one's set differs from its group's centre.

    The centre holds the shingles of at least half of up to VOTERS members. Any set would do for the rule below; this
    one keeps differences few, and none is common to most members.
    """
    cell = F.pmod(F.xxhash64("id"), F.lit(VOTERS)).alias("cell")
    voters = written(members.filter("c = g").groupBy("g", cell).agg(F.min("id").alias("id")))
    votes = voters.join(sets, "id").select("g", F.explode("hashes").alias("e")).groupBy("g", "e").agg(F.count("*").alias("n"))
    of = voters.groupBy("g").agg(F.count("*").alias("of"))
    centre = written(votes.join(of, "g").filter("2 * n >= of").groupBy("g").agg(F.collect_list("e").alias("r")))
    d = spread_join(members.join(sets, "id"), centre, ["g"], ["id"], hot)
    d = d.withColumns({"added": F.array_except("hashes", "r"), "missing": F.array_except("r", "hashes")})
    return d.select(
        "g", "id", "c",
        (100 * F.size("missing") + percent * F.size("added")).cast("long").alias("w"),
        ((100 - percent) * F.size("r")).cast("long").alias("slack"),
        F.concat("added", F.transform("missing", F.bitwise_not)).alias("delta"),
    )


def _between_components(shared: DataFrame, sets: DataFrame, comps: DataFrame, percent: int, hot_bands: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links known for sure, pairs left to check) among documents of different components that meet in a bucket.

    A group is what meets the component that a bucket's best-connected document belongs to. Let R be the group's
    centre, and let a document's differences be the shingles it lacks of R (m of them) and those it has besides (d of
    them). With P = `percent` and w = 100 m + P d, two documents are linked exactly if the number s of differences
    they share satisfies (100 + P) s >= w_x + w_y - (100 - P) |R|. So documents whose w and the group's least w
    together stay within (100 - P) |R| are linked with the document of least w. All other pairs contain a far
    document and need at least one shared difference. Differences are put in one order for the whole group, rare
    ones first: a pair that needs s shared ones has its first one before either's last s - 1. Joining on these
    prefixes finds all such pairs, and what is common in the group is hardly ever joined on.
    """
    c = shared.join(comps.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    c = written(c.select("key", "doc_id", "degree", F.coalesce("component", "doc_id").alias("c")))
    per = c.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max_by("c", F.struct("degree", -F.col("doc_id"))).alias("g"))
    if hot_bands is None:
        hot_bands = hot_keys(c.groupBy("key").count(), c.count())
    met = spread_join(c, per.filter("c0 < c1").select("key", "g"), ["key"], ["doc_id"], hot_bands)
    members = written(met.select("g", F.col("doc_id").alias("id"), "c").distinct())
    hot_groups = hot_keys(members.groupBy("g").count(), members.count())
    d = written(_differences(members, sets, percent, hot_groups))
    least = d.groupBy("g").agg(F.min(F.struct("w", "id", "c")).alias("least"))
    d = spread_join(d, least, ["g"], ["id"], hot_groups).withColumn("far", F.col("w") + F.col("least.w") > F.col("slack"))
    sure = d.filter("NOT far AND c <> least.c").select(F.col("least.id").alias("a"), F.col("id").alias("b"))
    # the near ones are all in one component now
    d = d.withColumn("c", F.when(F.col("far"), F.col("c")).otherwise(F.col("least.c"))).drop("least").withColumn("n", F.size("delta"))
    e = written(d.select("g", "id", "c", "w", "slack", "far", "n", F.explode("delta").alias("e")))
    # what no far document has, or one component only, can't link anything: it comes first in the order and is left out
    live = e.groupBy("g", "e").agg(F.count("*").alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("far").alias("any")).filter("any AND c0 < c1")
    live = written(live.select("g", "e", "f"))
    hot = hot_keys(live.withColumnRenamed("f", "count"), e.count())
    live = spread_join(e, live, ["g", "e"], ["id"], hot)
    order = live.groupBy("g", "id", "c", "w", "slack", "far", "n").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("o"))
    at = order.select("g", "id", "c", "w", "slack", "far", (F.col("n") - F.size("o")).alias("skipped"), "n", F.posexplode("o").alias("place", "fe"))
    at = written(at.select("g", "id", "c", "w", "slack", "far", (F.col("n") - F.col("skipped") - F.col("place")).alias("rest"), F.col("fe.e").alias("e")))
    lack, p = "l.w + r.w - l.slack", 100 + percent
    on = f"l.g = r.g AND l.e = r.e AND l.c <> r.c AND (NOT r.far OR l.id < r.id) AND {p} * l.rest >= {lack} AND {p} * r.rest >= {lack}"
    pairs = at.filter("far").alias("l").join(at.alias("r"), F.expr(on))
    return sure, pairs.select(F.expr("least(l.id, r.id)").alias("a"), F.expr("greatest(l.id, r.id)").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    bands = bands_for(percent)
    t = written(mapped(docs.select("doc_id", "text"), partial(_sketch_batches, shingle=shingle, bands=bands), SKETCH_SCHEMA))
    real = t.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = t.count()
    classes = written(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("count")).filter("count > 1"))
    hot_classes, hot_reps = (hot_keys(classes.select(*keys, "count"), rows) for keys in (["k1", "k2"], ["rep"]))
    classes = classes.drop("count")
    of_class = written(spread_join(real.select("doc_id", "n_shingles", "k1", "k2"), classes, ["k1", "k2"], ["doc_id"], hot_classes, "left"))
    copies = written(of_class.filter("doc_id <> rep").select(F.col("doc_id").alias("_id")).distinct())
    others, _ = small_or(copies, MAX_BROADCAST_IDS)
    reps = real.join(others, F.col("doc_id") == F.col("_id"), "left_anti").select("doc_id", F.explode("bands").alias("key"))
    buckets = reps.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c")).filter("low < high")
    buckets = written(buckets.select("key", "c"))
    hot_bands = hot_keys(buckets.withColumnRenamed("c", "count"), rows * bands)
    shared = written(spread_join(reps, buckets, ["key"], ["doc_id"], hot_bands))
    degrees = written(shared.groupBy("doc_id").agg(F.sum("c").alias("degree")))
    shared = written(shared.select("doc_id", "key").distinct().join(degrees, "doc_id"))
    sets = sets_of(docs, degrees.select(F.col("doc_id").alias("id")), shingle)

    # one partner each: the pivot met in most bands
    pivots = shared.groupBy("key").agg(_pivot().alias("a"), F.max("degree").alias("da"))
    met = spread_join(shared.select("doc_id", "key"), pivots, ["key"], ["doc_id"], hot_bands).filter("a <> doc_id").groupBy("doc_id", "a").agg(F.count("*").alias("n"), F.max("da").alias("da"))
    first = met.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("a", F.struct("n", "da", -F.col("a"))).alias("a"))
    links = written(confirmed(sets, written(first), percent))
    sure, rest = _between_components(shared, sets, components(links), percent, hot_bands)
    comps = written(components(links.union(sure).union(confirmed(sets, written(rest), percent))))

    found = of_class.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    found = spread_join(found, comps.select(F.col("id").alias("rep"), "component"), ["rep"], ["doc_id"], hot_reps, "left")
    component = F.coalesce("component", "rep")
    linked = found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    alone = t.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)")
    return linked.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all columns."""
    gone = written(near_duplicates(docs, shingle, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    gone, _ = small_or(gone, MAX_BROADCAST_IDS)
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
