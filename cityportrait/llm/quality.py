"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of the whole text (lengths, shares, repetition, entropy) are transformed towards normal shape. Each class
gets a mean and a covariance shrunk towards the pooled one and then towards its diagonal; the score is the logistic
of the difference of log densities, whose Mahalanobis distances are solved with Cholesky factors computed once.
The moments are summed by Spark over all labelled rows; only sums of fixed size reach the driver.

Cases: null and empty texts have statistics of their own and a score; repeated rows each get a row; labels other
than 0 and 1 or of unknown documents are ignored; without labels of both classes every score is 0.5; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cityportrait.llm.common import mapped, written

#: Shrinkage towards the pooled covariance, and then towards its diagonal.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.05, 1e-4
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?"
ENTROPY_BYTES = np.arange(256)


def _share(part: float, whole: float) -> float:
    """A share on a log scale."""
    return float(np.log(part / whole + 1e-3)) if whole else float(np.log(1e-3))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    w = b.split()
    n, size = len(w), len(b)
    bins = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    letters_up = int(bins[65:91].sum())
    letters = letters_up + int(bins[97:123].sum()) + int(bins[128:].sum())
    lens = np.fromiter(map(len, w), np.int64, n) if n else np.zeros(1, np.int64)
    counts = Counter(w)
    top = counts.most_common(1)[0][1] if n else 0
    same = sum(map(bytes.__eq__, w, w[1:]))
    grams = len(set(zip(w, w[1:], w[2:], strict=False))) if n > 2 else max(n - 2, 0)
    lines = [x for x in b.split(b"\n") if x.strip()]
    p = bins[bins > 0] / max(size, 1)
    entropy = float(-(p * np.log2(p)).sum()) if size else 0.0
    starts = sum(1 for x in w if 65 <= x[0] <= 90)
    stops = sum(int(bins[c]) for c in STOPS)
    return [
        float(np.log1p(n)),
        float(np.log1p(lens.mean())),
        float(np.log1p(lens.std())),
        float(np.log1p(lens.max())),
        _share(len(counts), n) / max(1.0, np.log1p(n)),
        _share(top, n),
        _share(same, n),
        _share(max(n - 2, 0) - grams, max(n - 2, 0)),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(len(lines), 1))),
        _share(int(bins[48:58].sum()), size),
        _share(letters_up, max(letters, 1)),
        _share(sum(int(bins[c]) for c in SYMBOLS), size),
        _share(stops, size),
        _share(int(bins[33]), size),
        _share(int(bins[32]), size),
        _share(letters, size),
        _share(starts, n),
        _share(sum(1 for x in w if x[-1] in STOPS), n),
        entropy,
        _share(len(zlib.compress(b, 1)), size + 20),
    ]


N_STATS = len(statistics("a"))


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            x = np.array([statistics(t.as_py()) for t in part.column(1)], np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_STATS).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def _moment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per class: the count, the statistics, and their products, as rows (label, place, value)."""
    sums = np.zeros((2, 1 + N_STATS + N_STATS**2))
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        x = np.asarray(batch.column(0).flatten()).reshape(-1, N_STATS)
        for c in (0, 1):
            xc = x[y == c]
            sums[c] += np.concatenate([[len(xc)], xc.sum(0), (xc.T @ xc).reshape(-1)])
    k = sums.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], k), pa.int32()), pa.array(np.tile(np.arange(k), 2), pa.int32()), pa.array(sums.reshape(-1))], ["label", "place", "value"])


class Discriminant:
    """Class means and Cholesky factors from the classes' sums."""

    def __init__(self, sums: np.ndarray):
        n = sums[:, 0]
        self.ready = bool((n >= 2).all())
        if not self.ready:
            return
        d = N_STATS
        self.mean = sums[:, 1 : 1 + d] / n[:, None]
        scatter = sums[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(0) / n.sum()
        self.factor, self.constant = [], []
        for c in (0, 1):
            s = (1 - TO_POOLED) * scatter[c] / n[c] + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + FLOOR * np.eye(d)
            factor = np.linalg.cholesky(s)
            self.factor.append(factor)
            self.constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        density = [self.constant[c] - 0.5 * (np.linalg.solve(self.factor[c], (x - self.mean[c]).T) ** 2).sum(0) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Train on the rows of `stats` (doc_id, x) that have a label in `labels` (doc_id, quality)."""
    known = labels.filter("quality IN (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    train = stats.join(known, F.col("doc_id") == F.col("_id")).select("x", "y")
    rows = mapped(train, _moment_batches, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("v")).collect()
    sums = np.zeros((2, 1 + N_STATS + N_STATS**2))
    for r in rows:
        sums[r.label, r.place] = r.v
    return Discriminant(sums)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = written(mapped(docs.select("doc_id", "text"), _stat_batches, "doc_id long, x array<double>"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    stats = stats.withColumn("held_out", held)
    model = fit(stats.filter(~F.col("held_out")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, N_STATS)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(stats.select("doc_id", "held_out", "x"), run, "doc_id long, held_out boolean, score double, predicted int")
