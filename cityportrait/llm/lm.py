"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Tokens are the words of a text and one end. The model's symbols are the end, the words that make up at least
LEAST_SHARE of the training tokens (and occur LEAST_COUNT times), and classes of all other words by their last
letters; a word that is no symbol has its class's probability times its smoothed share of the class, which follows
from its own count. With h1 the symbol before, h2 the one before that, E the embeddings and C1, C2 a matrix for each
position, a symbol w scores s = (E_h1 C1 + E_h2 C2) . E_w + b_w.

Training starts on the table of symbol pairs, counted by Spark over all training documents: there the expectation of
the noise-contrastive objective of E, C1 and b is exact. Then all parameters are trained on each share of the training
tokens, in batches with drawn noise symbols, and the shares' parameters are averaged by tokens. A document's share, the
order within it and the draws follow from hashes, so the model does not depend on how the input is split.

The sum over all symbols of exp(s) for every pair of context symbols is one matrix product, exp(S1) exp(S2)', so
scores are normalised exactly and a token costs three look-ups.

Word counts cover all training documents. The most frequent words are broadcast (a bounded number); the counts of all
others reach their documents by a join, in which no word is frequent. Texts are split into words twice: to count
them, and to write their symbols.

Cases: null and empty texts are one end; repeated rows each get a row; without training documents all counts are 0
and symbols are equally likely; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cityportrait.llm.common import mapped, written

#: A word is a symbol of its own from this share and count of the training tokens on, some 900 in natural text. Symbol
#: tables have that size squared, so however even the words are, only the most frequent ones are; the others are in
#: the classes, with their own counts' shares of them.
LEAST_SHARE, LEAST_COUNT, MOST_WORDS = 1e-4, 50, 1_800
N_CLASSES = 256
DIM = 32
#: Noise symbols a token in the objective on the pair table, and drawn ones a batch of tokens.
NOISE, DRAWN = 10, 32
#: Tokens by which each symbol's followers are drawn towards their overall frequencies; keeps small corpora from overfitting.
SMOOTH = 30.0
STEPS, RATE = 250, 0.05
BATCH, BATCH_RATE = 2048, 0.02
#: Training tokens of a share, about, the most shares, and documents of a share that are trained on at a time.
SHARE_TOKENS, MOST_SHARES, SHARE_ROWS = 1_000_000, 1_000, 2_000
SEED = 11
#: Words whose counts are broadcast.
HEAD = 200_000
FLUSH = 200_000
SLICE_ROWS = 250
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for t in batch.column(0):
            counts.update(tokens(t.as_py()))
            counts[END] += 1
            if len(counts) > FLUSH:
                yield out()
    if counts:
        yield out()


class Words:
    """The broadcast words: their symbols and counts. Rank 0 is the end; the first n_words others are symbols of their own."""

    def __init__(self, words: list[bytes], counts: list[int], n_words: int):
        rank = dict(zip(words, counts, strict=True))
        order = [(END, rank.get(END, 0))] + [(w, c) for w, c in zip(words, counts, strict=True) if w != END]
        self.n_words, self.n_symbols = n_words, 1 + n_words + N_CLASSES
        self.place = {w: i for i, (w, _) in enumerate(order)}
        self.symbol = np.array([i if i <= n_words else self.word_class(w) for i, (w, _) in enumerate(order)], np.int32)
        self.count = np.array([c for _, c in order], np.int64)

    def word_class(self, word: bytes) -> int:
        return 1 + self.n_words + zlib.crc32(word[-2:]) % N_CLASSES

    def places(self, words: list[bytes]) -> np.ndarray:
        """-1 for any other word."""
        get = self.place.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def symbols(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        """Symbols of the words and the end."""
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = self.symbol[at]
        for i in np.flatnonzero(at < 0):
            out[i] = self.word_class(words[i])
        return out


def _scattered(into: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add rows of values at the rows `at`, which may repeat; 16-bit numbers are sorted by radix."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    into[at[first]] += np.add.reduceat(values[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class LogBilinear:
    """Parameters e (embeddings), c1 and c2 (position matrices) and b; q is the noise distribution."""

    def __init__(self, pairs: np.ndarray, dim: int = DIM, steps: int = STEPS, seed: int = SEED):
        """Start from a table of symbol pairs (previous, next); c2 is 0 until `refine`."""
        m = len(pairs)
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (m, dim))
        self.c1 = np.eye(dim) + rng.normal(0, 0.01, (dim, dim))
        self.c2 = np.zeros((dim, dim))
        total = pairs.sum()
        self.q = (pairs.sum(0) + 1.0) / (total + m)
        self.b = np.log(self.q)
        if total:
            smooth = pairs + SMOOTH * self.q
            self._start(smooth / smooth.sum(), steps)

    def _start(self, p: np.ndarray, steps: int) -> None:
        """Adam on the exact expectation of the objective over the pair table."""
        before = p.sum(1, keepdims=True)
        params = [self.e, self.c1, self.b]
        first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        # a symbol's gradients are scaled by its own frequency, else rare ones hardly move
        scale = 1 / np.sqrt(np.maximum(before + p.sum(0)[:, None], 1e-7))
        for step in range(1, steps + 1):
            made = self.e @ self.c1
            real = _sigmoid(made @ self.e.T + self.b - np.log(NOISE * self.q))
            g = p * (1 - real) - NOISE * before * self.q * real
            back = g @ self.e
            grads = [(g.T @ made + back @ self.c1.T) * scale, self.e.T @ back, g.sum(0) * scale[:, 0]]
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for x, d, f, s in zip(params, grads, first, second, strict=True):
                f += 0.1 * (d - f)
                s += 0.01 * (d * d - s)
                x += rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def state(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.e, self.c1, self.c2, self.b)])

    def restore(self, state: np.ndarray) -> None:
        m, d = self.e.shape
        cut = np.cumsum([m * d, d * d, d * d])
        e, c1, c2, b = np.split(state, cut)
        self.e, self.c1, self.c2, self.b = e.reshape(m, d), c1.reshape(d, d), c2.reshape(d, d), b

    def refine(self, h2: np.ndarray, h1: np.ndarray, w: np.ndarray, rng: np.random.Generator, squares: list[np.ndarray]) -> None:
        """Noise-contrastive steps on tokens w after h1 after h2, in batches in random order, each with its own noise."""
        m = len(self.e)
        below, lift = np.cumsum(self.q), np.log(DRAWN * self.q).astype(self.e.dtype)
        order = rng.permutation(len(w))
        for k in range(0, len(w), BATCH):
            o = order[k : k + BATCH]
            a2, a1, y = h2[o], h1[o], w[o]
            z = np.minimum(np.searchsorted(below, rng.random(DRAWN)), m - 1)
            x1, x2, real, noise = self.e[a1], self.e[a2], self.e[y], self.e[z]
            made = x1 @ self.c1 + x2 @ self.c2
            up = 1 - _sigmoid((made * real).sum(1) + self.b[y] - lift[y])
            down = _sigmoid(made @ noise.T + self.b[z] - lift[z])
            back = up[:, None] * real - down @ noise
            g = np.zeros_like(self.e)
            _scattered(g, np.concatenate([a1, a2, y, z]), np.concatenate([back @ self.c1.T, back @ self.c2.T, up[:, None] * made, -down.T @ made]))
            gb = (np.bincount(y, up, m) - np.bincount(z, down.sum(0), m)).astype(self.e.dtype)
            for x, d, s in zip((self.e, self.c1, self.c2, self.b), (g, x1.T @ back, x2.T @ back, gb), squares, strict=True):
                d /= len(o)
                s += d * d
                x += BATCH_RATE * d / np.sqrt(s)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of exp(s) by (h1, w) and by (h2, w), and of the sum over w by (h1, h2)."""
        s1, s2 = (self.e @ self.c1) @ self.e.T + self.b, (self.e @ self.c2) @ self.e.T
        s1 -= s1.max(1, keepdims=True)
        s2 -= s2.max(1, keepdims=True)
        whole = np.log(np.exp(s1) @ np.exp(s2).T)
        return tuple((x / np.log(10)).astype(np.float32) for x in (s1, s2, whole))


def frequent(counts: DataFrame, most: int) -> list:
    """The rows (word, c) of the most frequent words, at most `most` of them, and of the end.

    A histogram of log counts, of bounded size, gives the least count to take; only rows above it reach the driver.
    """
    level = F.floor(F.log2("c") * 16)
    least = None
    taken = 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        taken += r.n
        if taken > most:
            break
        least = r.level
    keep = F.col("word") == F.lit(bytearray(END))
    rows = counts.filter(keep if least is None else keep | (level >= least)).collect()
    return sorted(rows, key=lambda r: (-r.c, bytes(r.word)))


def contexts(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h2, h1, w, first): the symbols of a column of texts one after the other, each with the two before it in its
    text (the end's symbol, 0, before its beginning), and where each text begins."""
    offsets = np.frombuffer(symbols.buffers()[1], np.int32)[symbols.offset : symbols.offset + len(symbols) + 1] // 2
    w = np.frombuffer(symbols.buffers()[2] or b"", np.uint16)[offsets[0] : offsets[-1]].astype(np.int64)
    first = (offsets[:-1] - offsets[0]).astype(np.int64)
    h1 = np.concatenate([[0], w[:-1]])[: len(w)]
    h1[first] = 0
    h2 = np.concatenate([[0], h1[:-1]])[: len(w)]
    h2[first] = 0
    return h2, h1, w, first


@dataclass
class Trained:
    """What training gives: the written word counts and encoded texts, the broadcast words, log10 of each class's share
    divisor (0 for words of their own), the number of training tokens and distinct ones, and the model."""

    counts: DataFrame
    encoded: DataFrame
    words: Words
    cost: np.ndarray
    n: int
    v: int
    model: LogBilinear


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, counts double, within double, symbols binary, rest array<struct<word:binary,n:long>>"


def train(docs: DataFrame) -> Trained:
    """Count words, encode all texts, and fit the model on the training documents."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), "text")
    counts = written(mapped(d.filter(~F.col("held_out")).select("text"), _count_batches, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(counts, HEAD)
    n_words = min(MOST_WORDS, sum(r.c >= max(LEAST_COUNT, LEAST_SHARE * n) and bytes(r.word) != END for r in head))
    words = Words([bytes(r.word) for r in head], [r.c for r in head], n_words)
    shared, m = spark.sparkContext.broadcast(words), words.n_symbols

    def class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for batch in batches:
            w = batch.column(0).to_pylist()
            s = shared.value.symbols(w, shared.value.places(w))[:-1]
            np.add.at(mass, s, batch.column(1).to_numpy())
            np.add.at(kinds, s, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array(mass), pa.array(kinds)], ["symbol", "mass", "kinds"])

    cost = np.zeros(m)
    for r in mapped(counts, class_batches, "symbol int, mass long, kinds long").groupBy("symbol").agg(F.sum("mass").alias("mass"), F.sum("kinds").alias("kinds")).collect():
        # within a class: (c + 1) / (mass + kinds + 1), the last for all unseen words together
        if r.symbol > n_words:
            cost[r.symbol] = np.log10(r.mass + r.kinds + 1)

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        log_c = np.log10(known.count + 1.0)
        names = [x.split(" ")[0] for x in ENCODED.split(", ")]
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(begin, SLICE_ROWS)
                rows, offsets, rare_words, rare_counts = [], [0], [], []
                for t in piece.column(2):
                    w = tokens(t.as_py())
                    at = known.places(w)
                    s = known.symbols(w, at)
                    full = np.append(at, 0)
                    seen = full[full >= 0]
                    # a word that is no symbol of its own has its share of the class
                    within = float(log_c[seen[known.symbol[seen] > known.n_words]].sum() - cost[s].sum())
                    rest = Counter(w[i] for i in np.flatnonzero(at < 0))
                    rare_words.extend(rest)
                    rare_counts.extend(rest.values())
                    offsets.append(len(rare_words))
                    rows.append((len(w) + 1, int((known.count[seen] > 0).sum()), float(log_c[seen].sum()), within, s.astype(np.uint16).tobytes()))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
                rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)], names
                )

    encoded = written(mapped(d, encode_batches, ENCODED).withColumn("row", F.monotonically_increasing_id()))
    learnt = encoded.filter(~F.col("held_out")).select("symbols")

    def pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(m * m, np.int64)
        for batch in batches:
            _, h1, w, _ = contexts(batch.column(0))
            np.add.at(table, h1 * m + w, 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["pair", "c"])

    # at most the symbols squared
    found = mapped(learnt, pair_batches, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros(m * m)
    pairs[found.column("pair").to_numpy()] = found.column("c").to_numpy()
    model = LogBilinear(pairs.reshape(m, m))
    begun = spark.sparkContext.broadcast(model)

    shares = min(MOST_SHARES, max(1, -(-n // SHARE_TOKENS)))
    hashed = F.xxhash64("doc_id", "symbols")
    dealt = encoded.filter(~F.col("held_out")).select(F.pmod(hashed, F.lit(shares)).cast("int").alias("share"), hashed.alias("hash"), "symbols")
    dealt = dealt.repartition(shares, "share").sortWithinPartitions("share", "hash").select("share", "symbols")

    def refine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = begun.value
        begin = own.state()

        def trained(rows: Iterator[list]) -> np.ndarray:
            """One share's parameters, times its tokens, and these; rows come in lists of SHARE_ROWS."""
            # single precision halves the time of the steps
            own.restore(begin.astype(np.float32))
            squares = [np.full(x.shape, 1e-3, np.float32) for x in (own.e, own.c1, own.c2, own.b)]
            seen = 0
            for part in rows:
                h2, h1, w, _ = contexts(pa.array(part, pa.binary()))
                own.refine(h2, h1, w, rng, squares)
                seen += len(w)
            return np.append(own.state().astype(np.float64) * seen, seen)

        def flat() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        for share, rows in groupby(flat(), lambda r: r[0]):
            rng = np.random.default_rng([SEED, share])
            state = trained(iter(lambda rows=rows: [r[1] for r in islice(rows, SHARE_ROWS)], []))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(state), dtype=np.int32)), pa.array(state)], ["place", "value"])
        own.restore(begin)

    summed = mapped(dealt, refine_batches, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    state = np.zeros(len(model.state()) + 1)
    state[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
    if state[-1]:
        model.restore(state[:-1] / state[-1])
    return Trained(counts, encoded, words, cost, n, v, model)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    return scores(train(docs))


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counts double, within double, model double"


def scores(t: Trained) -> DataFrame:
    made = t.encoded.sparkSession.sparkContext.broadcast(t.model.tables())
    names = [x.split(" ")[0] for x in SCORED.split(", ")]

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_h1, by_h2, whole = made.value
        for batch in batches:
            h2, h1, w, first = contexts(batch.column(len(names) - 1))
            lm = (by_h1[h1, w] + by_h2[h2, w] - whole[h1, h2]).astype(np.float64)
            sums = np.add.reduceat(lm, first) if len(first) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], names)

    part = mapped(t.encoded.select(*names[:-1], "symbols"), score_batches, SCORED)
    rare = t.encoded.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n").join(t.counts, "word")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("known"))
    out = part.join(rare, "row", "left").fillna(0, ["more", "known"])
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(t.n).cast("long").alias("train_tokens"),
        (F.col("counts") + F.col("more") - F.col("n_tokens") * float(np.log10(t.n + t.v + 1))).alias("base_score"),
        (F.col("model") + F.col("within") + F.col("more")).alias("score"),
    )
