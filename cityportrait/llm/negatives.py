"""Hard negatives by exact integer scores, computed with Kronecker-packed products.

Every component x becomes the integer floor(256 x). A row's score is its inner product with an anchor's. To score
many candidates at once, candidates are packed: each component is lifted by a bias, so that it is not negative, and
several candidates' lifted components stand in separate fields of one wide integer. One multiplication with an
anchor's lifted component then multiplies all of them; the sums over the components are unpacked by shifts, and what
the biases added is taken off again. Fields are as wide as the largest possible sum needs (see `packed_scores`), so
no field runs into the next one and scores are exact.

Anchors are dealt to blocks and rows to shares, by arithmetic on counts; an anchor block meets each share in one task,
which keeps the best of the share only. Two passes: the positives of every anchor, then its negatives below them.

Cases: rows without a vec_id, label or vector, or with a null or non-finite component, take no part; equal rows count
once; rows of one vec_id with different vectors are rows of their own, and an anchor is no partner of its own vec_id;
vectors of different length are filled up with zeros; scores beyond 64 bits stand at the end of the range; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cityportrait.llm.common import shipped, written

SCALE = 256
#: Every such vec_id is an anchor; such vec_ids have their label moved on first.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Anchors of a block and rows of a share, about; a smaller table is dealt to so many shares still, of LEAST_SHARE rows.
BLOCK, SHARE, SHARES, LEAST_SHARE = 4_096, 8_192, 64, 512
#: Anchors scored at a time.
AT_A_TIME = 128
#: Integers up to this size are exact in a double, so products of packed integers below it go through a matrix product.
EXACT_BITS = 53
LOW, HIGH = -(2**63), 2**63 - 1


def quantised(vectors: list | pa.ListArray) -> np.ndarray:
    """floor(256 x) of each component, a row a vector: integers in doubles where these are exact, else Python's integers."""
    a = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
    values = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(a.offsets.to_numpy()).astype(np.int64)
    dim = int(lengths.max()) if len(lengths) else 0
    whole = np.abs(values).max(initial=0.0) < 2.0 ** (EXACT_BITS - 9)
    q = np.floor(values * SCALE) if whole else np.array([int(np.floor(x * SCALE)) if abs(x) < 2.0**62 else int(x) * SCALE for x in values.tolist()], object)
    if len(values) == len(lengths) * dim:
        return q.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), q.dtype)
    out[np.arange(dim)[None, :] < lengths[:, None]] = q
    return out


def _filled(x: np.ndarray, n: int, dim: int) -> np.ndarray:
    """The matrix with zeros up to n rows and dim columns."""
    out = np.full((n, dim), 0, x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The inner products of all anchors with all rows, int64, at the ends of the range beyond it.

    With a' = a - min a and c' = c - min c (per component), a.c = a'.c' + min a * sum c' + a . min c. A field holds any
    a'.c', as it has the bits of the largest possible one. As long as a field fits into 53 bits the packed integers
    are kept in doubles, where their sums are exact; wider ones are Python's integers, of any width.
    """
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    dim = max(anchors.shape[1], rows.shape[1])
    a, c = (_filled(x, len(x), dim) for x in (anchors, rows))
    if not dim:
        return np.zeros((len(a), len(c)), np.int64)
    low_a, low_c = a.min(), c.min(0)
    lifted_a, lifted_c = a - low_a, c - low_c
    bits = max(1, int(sum(int(x) for x in lifted_c.max(0)) * int(lifted_a.max())).bit_length())
    fits = bits <= EXACT_BITS and a.dtype != object and c.dtype != object
    bound = dim * int(np.abs(a).max()) * int(np.abs(c).max())
    if not fits or bound >= 2**62:
        lifted_a, lifted_c, a, c = (np.array([[int(v) for v in row] for row in x.tolist()], object) for x in (lifted_a, lifted_c, a, c))
        low_a, low_c = int(low_a), np.array([int(v) for v in low_c.tolist()], object)
        fits = False
    fields = EXACT_BITS // bits if fits else 64
    groups = _filled(lifted_c, -(-len(lifted_c) // fields) * fields, dim).reshape(-1, fields, dim)
    if fits:
        wide = (groups * (2.0 ** (bits * np.arange(fields)))[None, :, None]).sum(1)
        sums = (lifted_a @ wide.T).astype(np.int64)
        shift, mask = np.int64(bits), np.int64((1 << bits) - 1)
        out = np.empty((len(a), len(wide), fields), np.int64)
    else:
        wide = (groups * np.array([1 << (bits * f) for f in range(fields)], object)[None, :, None]).sum(1)
        sums, shift, mask = np.dot(lifted_a, wide.T), bits, (1 << bits) - 1
        out = np.empty((len(a), len(wide), fields), object)
    for f in range(fields):
        out[:, :, f] = (sums >> (shift * f)) & mask
    out = out.reshape(len(a), -1)[:, : len(c)]
    if fits:
        return out + np.int64(low_a) * lifted_c.sum(1).astype(np.int64)[None, :] + (a @ low_c).astype(np.int64)[:, None]
    exact = out + low_a * lifted_c.sum(1)[None, :] + np.dot(a, low_c)[:, None]
    return np.array([[min(max(v, LOW), HIGH) for v in row] for row in exact.tolist()], np.int64).reshape(len(a), len(c))


def _first(scores: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The places `at`, which rise, with the highest scores, equal ones in order; at most `most`."""
    if len(at) > most:
        s = scores[at]
        least = np.partition(s, len(s) - most)[len(s) - most]
        at = np.concatenate([at[s > least], at[s == least][: most - int((s > least).sum())]])
    return at[np.lexsort((at, -scores[at]))] if len(at) > 1 else at


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.sort_by("of_vec_id").combine_chunks()
    return rows["of_vec_id"].to_numpy(), rows["of_label"].to_numpy(), quantised(rows["of_embedding"].combine_chunks() if rows.num_rows else [])


def _scored(anchors: pa.Table, q: np.ndarray):
    """(place of the anchor in its table, its scores of all rows)."""
    own = quantised(anchors["embedding"].combine_chunks() if anchors.num_rows else [])
    for k in range(0, len(own), AT_A_TIME):
        for i, s in enumerate(packed_scores(own[k : k + AT_A_TIME], q)):
            yield k + i, s


POSITIVE = "anchor long, anchor_id long, positive_id long, positive_score long"


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """One block's anchors with one share of the rows: each one's best rows of its label."""
    anchors = anchors.combine_chunks()
    ids, labels, q = _sorted(rows)
    own, own_ids, own_labels = (anchors[c].to_numpy() for c in ("anchor", "vec_id", "label"))
    by_label = {x: np.flatnonzero(labels == x) for x in set(own_labels.tolist())}
    out: list[tuple] = []
    for i, s in _scored(anchors, q):
        at = by_label[int(own_labels[i])]
        at = _first(s, at[ids[at] != own_ids[i]], POSITIVES)
        out += [(int(own[i]), int(own_ids[i]), int(ids[j]), int(s[j])) for j in at]
    return _table(out, POSITIVE)


NEGATIVE = "anchor long, anchor_id long, place int, positive_id long, negative_id long, positive_score long, negative_score long"


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """One block's anchors, with their positives, and one share of the rows: the best other-label rows within each positive's bounds."""
    anchors = anchors.combine_chunks()
    ids, labels, q = _sorted(rows)
    own, own_ids, own_labels = (anchors[c].to_numpy() for c in ("anchor", "vec_id", "label"))
    positives = anchors["positives"].to_pylist()
    out: list[tuple] = []
    for i, s in _scored(anchors, q):
        # exact in Python's integers: least <= score <= most
        bounds = [(-(-LEAST * p["positive_score"] // 100), MOST * p["positive_score"] // 100) for p in positives[i]]
        able = np.flatnonzero((s >= max(min(b[0] for b in bounds), LOW)) & (s <= min(max(b[1] for b in bounds), HIGH)) & (labels != own_labels[i]))
        for place, (p, (least, most)) in enumerate(zip(positives[i], bounds, strict=True)):
            if least > most:
                continue
            at = _first(s, able[(s[able] >= least) & (s[able] <= most)], NEGATIVES)
            out += [(int(own[i]), int(own_ids[i]), place, p["positive_id"], int(ids[j]), p["positive_score"], int(s[j])) for j in at]
    return _table(out, NEGATIVE)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(fields, columns, strict=True)})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, once each, with the labels moved."""
    v = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return v.withColumn("label", moved).dropDuplicates()


def _tiles(df: DataFrame, blocks: int, shares: int, block: Column | None, share: Column | None) -> DataFrame:
    """Deal a table to the tiles (block, share): where one of the two isn't given, the row goes to all of them."""
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    df = df.withColumn("_block", whole(blocks) if block is None else block)
    return df.withColumn("_share", whole(shares) if share is None else share)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor and positive."""
    v = written(usable(vectors).withColumn("anchor", F.monotonically_increasing_id()))
    anchors = v.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    n = v.count()
    blocks, shares = max(1, -(-anchors.count() // BLOCK)), max(1, -(-n // SHARE), min(SHARES, -(-n // LEAST_SHARE)))
    dealt = lambda n, salt: F.pmod(F.xxhash64("anchor", F.lit(salt)), F.lit(n)).cast("int")
    # under other names: both sides of a cogroup must not share columns
    rows = _tiles(v, blocks, shares, None, dealt(shares, 1)).toDF(*[f"of_{c}" for c in v.columns], "_of_block", "_of_share")
    shipped(v.sparkSession)

    def met(own: DataFrame, function, schema: str) -> DataFrame:
        own = _tiles(own, blocks, shares, dealt(blocks, 0), None)
        return own.groupBy("_block", "_share").cogroup(rows.groupBy("_of_block", "_of_share")).applyInArrow(function, schema)

    best = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = met(anchors, _positives, POSITIVE).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= POSITIVES)
    lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives"))
    own = written(anchors.join(lists, "anchor"))
    best = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met(own, _negatives, NEGATIVE).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
