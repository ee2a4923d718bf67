"""SentencePiece encoding and decoding by suffix-array matching.

The new units of a batch (stretches that no piece crosses) are joined into one text with a suffix array over as many
characters as the longest piece has. All pieces are binary-searched at once for their ranges; each range gives the
edges of that piece, which are sorted by the position where they end and relaxed from left to right. For a unigram
model an edge is relaxed by its score. For a BPE model an edge may follow another only if the two pieces, joined,
are again encoded as these two; the edge that satisfies this is the last one of the prefix's encoding, and there is
exactly one, so the relaxed path is the encoding that merging gives. Characters outside the vocabulary become bytes.

Cases: null and empty texts have no tokens; the space mark itself decodes to a space; any text of any length is
encoded whole; repeated rows each get a row; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cityportrait.llm.common import mapped

from cityportrait.llm.neardup import _slices

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 600_000
LONG_UNIT = 64
MAX_CACHED = 500_000


@dataclass
class Vocabulary:
    """Pieces and scores of a model file; `bpe` tells how edges are relaxed."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    usable: list[int]
    unk: int
    bpe: bool = True

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL, bpe: bool = True) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        bytes_ = [i for i in range(n) if sp.is_byte(i)]
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        pieces = [sp.id_to_piece(i) for i in range(n)]
        return cls(pieces, [sp.get_score(i) for i in range(n)], sorted(bytes_, key=lambda i: int(pieces[i][3:-1], 16)), [i for i in range(n) if i not in special], sp.unk_id(), bpe)

    @cached_property
    def by_text(self) -> dict[str, int]:
        return {self.pieces[i]: i for i in self.usable}

    @cached_property
    def unknown_score(self) -> float:
        return min((self.scores[i] for i in self.usable), default=0.0) - 10.0

    @cached_property
    def max_len(self) -> int:
        return max((len(self.pieces[i]) for i in self.usable), default=1)

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, lengths and a matrix of character codes (0 behind the end) of the usable pieces."""
        ids = np.array(self.usable, np.int32)
        out = np.zeros((len(ids), self.max_len), np.uint32)
        for r, i in enumerate(self.usable):
            out[r, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        return ids, np.array([len(self.pieces[i]) for i in self.usable], np.int32), out

    @cached_property
    def units(self) -> re.Pattern:
        """Splits a text where no piece crosses: before a mark that follows another character, and around line ends."""
        usable = [self.pieces[i] for i in self.usable]
        if any(MARK in p.lstrip(MARK) for p in usable):
            return re.compile(r"(?s).+")
        if any("\n" in p for p in usable):
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        # marks of punctuation that no piece has behind a letter begin a unit of their own there
        behind = {b for p in usable for a, b in zip(p, p[1:]) if re.match(r"[^\W\d_]", a)}
        stop = "".join(re.escape(c) for c in ".,;:!?" if c not in behind)
        if not stop:
            return re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        return re.compile(rf"\n|{MARK}*[^{MARK}\n{stop}]+(?:(?<![^\W\d_])[{stop}][^{MARK}\n]*)?|{MARK}*[{stop}][^{MARK}\n]*|{MARK}+")

    @cached_property
    def surface(self) -> list[bytes]:
        out = [p.encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` characters or more, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        nxt = np.zeros_like(rank)
        nxt[:-k] = rank[k:] + 1 if k < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


def occurrences(codes: np.ndarray, sa: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range [lo, hi) of suffixes that begin with it, narrowed character by character."""
    n = len(sa)
    padded = np.concatenate([codes, np.zeros(pieces.shape[1] + 1, np.uint32)])
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    for j in range(pieces.shape[1]):
        live = np.flatnonzero((lengths > j) & (lo < hi))
        if not len(live):
            break
        want = pieces[live, j]
        ends = []
        for after in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                got = padded[sa[np.minimum(mid, n - 1)] + j]
                right = (got <= want if after else got < want) & open_
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        lo[live], hi[live] = ends
    return lo, hi


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        if vocabulary.bpe:
            # a piece that merging its characters does not give is never an edge
            vocabulary.usable = [i for i in vocabulary.usable if len(vocabulary.pieces[i]) == 1 or self.merged(vocabulary.pieces[i]) == [vocabulary.pieces[i]]]
            vocabulary.__dict__.pop("codes", None)

    # -- pairs of pieces
    def merged(self, text: str) -> list[str]:
        """A short text merged by rank; only for single pairs of pieces."""
        parts, ids, scores = list(text), self.v.by_text, self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or scores[p] > best):
                    best, at = scores[p], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        key = a * len(self.v.pieces) + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * MAX_CACHED:
                self.pairs.clear()
            x, y = self.v.pieces[a], self.v.pieces[b]
            ok = self.pairs[key] = self.merged(x + y) == [x, y]
        return ok

    # -- units
    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first edge of each end position, piece lengths, pieces): edges sorted by end, longest first."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ids, lengths, chars = self.v.codes
        sa = suffix_array(codes, self.v.max_len)
        lo, hi = occurrences(codes, sa, chars, lengths)
        count = hi - lo
        piece = np.repeat(np.arange(len(ids), dtype=np.int32), count)
        start = sa[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        size = lengths[piece]
        end = start + size
        order = np.argsort(end.astype(np.int64) * (self.v.max_len + 1) + (self.v.max_len - size), kind="stable")
        first = np.searchsorted(end[order], np.arange(len(codes) + 2))
        return first, size[order], ids[piece[order]]

    def _bytes(self, c: str) -> list[int]:
        return [self.v.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.v.byte_ids else [self.v.unk]

    def _relax(self, unit: str, first: list[int], size: list[int], piece: list[int], edge0: int) -> bytes:
        n, v, pairs, scores = len(unit), len(self.v.pieces), self.pairs, self.v.scores
        # last piece of each prefix: -1 at the start, -2 behind a character outside the vocabulary, which merges with nothing
        last, back = [-1] * (n + 1), list(range(-1, n))
        total = [0.0] * (n + 1)
        for i in range(1, n + 1):
            edges = range(first[i] - edge0, first[i + 1] - edge0)
            last[i] = -2
            if self.v.bpe:
                for e in edges:
                    p, s = piece[e], i - size[e]
                    before = last[s]
                    if before < 0 or (pairs[key] if (key := before * v + p) in pairs else self.follows(before, p)):
                        last[i], back[i] = p, s
                        break
            else:
                total[i] = total[i - 1] + self.v.unknown_score
                for e in edges:
                    p, s = piece[e], i - size[e]
                    if last[i] == -2 or total[s] + scores[p] > total[i]:
                        last[i], back[i], total[i] = p, s, total[s] + scores[p]
        out, i = [], n
        while i > 0:
            if last[i] == -2:
                out.extend(reversed(self._bytes(unit[i - 1])))
            else:
                out.append(last[i])
            i = back[i]
        out.reverse()
        return array("i", out).tobytes()

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Encode units, chunk by chunk."""
        out: dict[str, bytes] = {}
        at = 0
        while at < len(units):
            chars, begin = 0, at
            while at < len(units) and (at == begin or chars + len(units[at]) < CHUNK_CHARS):
                chars += len(units[at]) + 1
                at += 1
            part = units[begin:at]
            first, size, piece = self._edges("\0".join(part))
            pos = 0
            for u in part:
                f = first[pos : pos + len(u) + 2]
                e0, e1 = int(f[0]), int(f[-1])
                out[u] = self._relax(u, f.tolist(), size[e0:e1].tolist(), piece[e0:e1].tolist(), e0)
                pos += len(u) + 1
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.v.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > MAX_CACHED:
            self.cache.clear()
        new = {u for units in split for u in units} - self.cache.keys()
        fresh = self.learn(sorted(new))
        long_ = {u: fresh.pop(u) for u in [u for u in fresh if len(u) > LONG_UNIT]}
        self.cache.update(fresh)
        get = self.cache.__getitem__ if not long_ else (lambda u: long_[u] if u in long_ else self.cache[u])
        return [np.frombuffer(b"".join(map(get, units)), np.int32) for units in split]

    def decode(self, ids: np.ndarray) -> str:
        s = self.v.surface
        text = b"".join([s[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process and vocabulary, so that learned units are kept between tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids and round_trip (decoding gives the text back) of every document."""
    vocabulary = vocabulary or Vocabulary.load()
    key = hashlib.sha256("\0".join(vocabulary.pieces).encode() + bytes([vocabulary.bpe])).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, shared.value)
        low = np.zeros(len(enc.v.pieces), bool)
        low[enc.v.byte_ids] = True
        for batch in batches:
            for ids, texts in _slices(batch):
                out = enc.encode(texts)
                same = [enc.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(out, texts, strict=True)]
                lengths = np.array([len(x) for x in out], np.int64)
                flat = np.concatenate([*out, np.empty(0, np.int32)])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(lengths), pa.array([int(low[x].sum()) for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same)],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
                )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id and text of token ids; null ids give a null text."""
    vocabulary = vocabulary or Vocabulary.load()
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else enc.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return mapped(tokens.select("doc_id", "ids"), run, "doc_id long, text string")
