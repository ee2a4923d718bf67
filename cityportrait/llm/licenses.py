"""License scans: exact phrases, and a fuzzy search for short notices.

Words are runs of ASCII letters and digits and of other characters, with A-Z lowered. A phrase's base places are
where its words stand consecutively. The fuzzy search looks for whole notices with up to EDITS edits: a notice is
split into EDITS + 1 pieces, one of which stands unchanged in any text that is close enough (pigeonhole); the places
of the pieces give stretches of words, and on each the regex library's bounded-error matching verifies the edits, so
notices next to each other all count.
The words that tell one license from another (KEYS) are whole words in a match and take one edit at most, short ones
none. The words behind a Creative Commons notice complete its label.

Cases: null and empty texts have no words; texts are scanned whole; repeated rows each get a row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cityportrait.llm.common import mapped

#: Phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices searched with errors, and their labels (fixed values).
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "licensed under the apache license version": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "this is free and unencumbered software": "unlicense",
}
#: Words of the notices that name the license, and the conditions that may follow Creative Commons notices (fixed values).
KEYS = frozenset("gnu lesser apache mit mozilla eclipse creative commons attribution cc by unencumbered".split())
CONDITIONS = {
    ("noncommercial",): "nc", ("non", "commercial"): "nc", ("nc",): "nc",
    ("noderivatives",): "nd", ("no", "derivatives"): "nd", ("noderivs",): "nd", ("no", "derivs"): "nd", ("nd",): "nd",
    ("sharealike",): "sa", ("share", "alike"): "sa", ("sa",): "sa",
}
EDITS = 3
#: Keys of fewer letters take no edit.
EDITED_KEY = 6
#: Short notices get fewer edits.
FEW_EDITS = {"licensed under cc by": 1, "released under the mit license": 2, "mozilla public license": 2, "eclipse public license": 2}
BASE_SCORE = 0.9

#: Every byte below 0x80 but letters and digits separates words; A-Z is lowered.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def normal(text: str | None) -> bytes:
    """The words joined by single spaces, with one at either end."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    return b" " + b" ".join(filter(None, w)) + b" "


def pieces(notice: str, edits: int) -> list[bytes]:
    """edits + 1 pieces of about equal length that make up the notice."""
    n = len(notice)
    cut = [n * i // (edits + 1) for i in range(edits + 2)]
    return [notice[a:b].encode() for a, b in zip(cut, cut[1:], strict=False)]


def bounded(notice: str, k: int) -> regex.Pattern:
    """The notice with up to k edits in each part between keys; the sum is checked on the match."""
    edge, end = rb"(?<![a-z0-9\x80-\xff])", rb"(?![a-z0-9\x80-\xff])"
    out, plain = [], ""

    def part(text: str) -> bytes:
        return rb"(?:" + regex.escape(text, special_only=True).encode() + rb"){e<=%d}" % k if text else b""

    words = notice.split()
    for i, w in enumerate(words):
        gap = " " if i else ""
        if w in KEYS:
            key = b"(?:" + w.encode() + (b"){e<=1:[^ ]}" if len(w) >= EDITED_KEY else b")")
            out += [part(plain + gap), edge + key + end]
            plain = ""
        else:
            plain += gap + w
    out.append(part(plain))
    return regex.compile(rb"(?b)" + edge + b"".join(out) + end)


_CONDITION = regex.compile(rb" (" + b"|".join(" ".join(c).encode() for c in CONDITIONS) + rb")(?= |$)")


def completed(label: str, text: bytes, at: int) -> str:
    """A Creative Commons label with the conditions that the text goes on with."""
    found = set()
    while m := _CONDITION.match(text, at):
        found.add(CONDITIONS[tuple(m[1].decode().split())])
        at = m.end()
    return "-".join([label, *sorted(found, key=("nc", "nd", "sa").index)])


class Searcher:
    def __init__(self) -> None:
        self.notices = []
        for notice, label in NOTICES.items():
            k = FEW_EDITS.get(notice, EDITS)
            pattern = bounded(notice, k)
            parts, at = [], 0
            for p in pieces(notice, k):
                parts.append((p, at))
                at += len(p)
            self.notices.append((label, len(notice), k, parts, pattern))

    def stretches(self, text: bytes, length: int, k: int, parts: list[tuple[bytes, int]]) -> set[tuple[int, int]]:
        """Stretches of whole words in which the notice can stand, by its pieces' exact places.

        Up to k edits move a match's beginning from where a piece says it is, and its end from its beginning, by k.
        """
        out: set[tuple[int, int]] = set()
        for p, at in parts:
            i = text.find(p)
            while i >= 0:
                # a word begins after a space and ends before one
                a = text.find(b" ", max(0, i - at - k - 1))
                while 0 <= a < i - at + k:
                    e = text.find(b" ", max(a + 2, a + 1 + length - k))
                    while 0 <= e <= a + 1 + length + k:
                        out.add((a + 1, e))
                        e = text.find(b" ", e + 1)
                    a = text.find(b" ", a + 1)
                i = text.find(p, i + 1)
        return out

    def fuzzy(self, text: bytes) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in the joined words.

        Of a notice's matches that overlap, the one of fewest edits counts, of equals the first and then the longest.
        """
        found = []
        for label, length, k, parts, pattern in self.notices:
            # no piece, no place; a rare piece is asked for first
            if not any(p in text for p, _ in parts):
                continue
            matches = []
            for a, e in self.stretches(text, length, k, parts):
                if (m := pattern.fullmatch(text, a, e)) and (edits := sum(m.fuzzy_counts)) <= k:
                    matches.append((edits, a, -e))
            taken: list[tuple[int, int]] = []
            for edits, a, e in sorted(matches):
                place = bisect(taken, (a, len(text)))
                if (place and taken[place - 1][1] > a) or (place < len(taken) and taken[place][0] < -e):
                    continue
                taken.insert(place, (a, -e))
                found.append((completed(label, text, -e) if label == "cc-by" else label, a, -e, edits))
        return found

    def scan(self, text: str | None) -> tuple:
        t = normal(text)
        n_words = t.count(b" ") - 1 if len(t) > 2 else 0
        starts, labels, places = [], set(), 0
        for phrase, label in PHRASES.items():
            p = b" " + phrase.encode() + b" "
            i = t.find(p)
            while i >= 0:
                starts.append(i)
                labels.add(label)
                places += 1
                i = t.find(p, i + 1)
        spans = self.fuzzy(t)
        more = labels | {x[0] for x in spans}
        word = lambda i: t.count(b" ", 0, i)
        score = BASE_SCORE if labels else 0.0
        if spans:
            best = min(e for _, _, _, e in spans)
            score = max(score, 1.0 - 0.1 * best)
        first, last = (word(min(starts)), word(max(starts))) if starts else (None, None)
        told = [(lab, word(a) - 1, t[a:b].decode("utf-8", "replace"), e) for lab, a, b, e in sorted(spans, key=lambda x: x[1:])]
        return n_words, places, first, last, ",".join(sorted(labels)), ",".join(sorted(more)), score, told


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,text:string,edits:int>>"


def scanned(docs: DataFrame) -> DataFrame:
    """Base places, all labels, a score and the fuzzy spans (label, first word, matched words, edits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher()
        span = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("text", pa.string()), ("edits", pa.int32())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = []
            for x in batch.column(1):
                *head, told = searcher.scan(x.as_py())
                rows.append((*head, [{"label": a, "word": b, "text": c, "edits": d} for a, b, c, d in told]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)
