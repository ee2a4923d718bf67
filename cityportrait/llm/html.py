"""HTML extraction by deducing the template that pages of a host share.

Tokens of a page are the starts and ends of its elements, named by their path of block elements, and its text blocks,
named by path and text. Tokens with the same occurrence vector (how often each page of the host has them) form an
equivalence class; Spark finds the classes by an order-free digest of the vector, so no host's pages are gathered in
one task. Classes with enough support and tokens are candidates, besides the root's, which every page has once. Then
all pages are read again as sequences of the classes' tokens:

* ordered: a class's tokens follow one order, again and again, on every page. The order is taken from one page; tokens
  that break it on any page leave the class. A text that leaves the root's with its element, which holds no other
  prose, is a class of the two; others are told apart by their place among the root's tokens, and belong to the
  template at places that several pages have.
* nested: all of a class's occurrences stand at one place of every class around them, and no two classes overlap in
  part. Of two classes that break this the one with more support stays.

The valid classes, nested in the root's, are the template. Texts of the root's class belong to it; so do texts of
other classes whose element is of the same class, so every such element has it (a text that repeats in a few of many
such elements is content, as of near copies). The remaining blocks stand in slots. The template's main
containers are the articles and mains, or else the deepest element that holds all of the slots' prose; text comes from
inside them, without menus, headers, footers, sidebars, notices, adverts, forms and comments. Repeated text inside an
article or main, or between slots, is the article's own (see _without_template). A host with too few pages to deduce
from, and a page that has little of its prose in its host's containers, is read by its own elements.

Cases: null and empty html give an empty text; unclosed and stray tags, and tags cut off at the end, are read as far
as they go; a null url is a host of its own; repeated rows each get a row, and copies of a page on its host count as
one page of the template; a page whose prose is all in the template is read by its own elements; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cityportrait.llm.common import mapped, small_or, written

MIN_PAGES = 5
SUPPORT = 0.5
MOST = 0.5
#: Tokens of a class, an element's start and end being two.
LARGE = 3
#: Pages that make a place of a text that every page has one of the template's.
PLACE_PAGES = 2
MAX_BROADCAST_HOSTS = 20_000
MAX_BROADCAST_CHARS = 32_000_000
MAX_BROADCAST_COPIES = 100_000
SALTS = 16

#: Element names by their role (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br nobr "
                   "math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml object canvas audio video textarea title".split())
#: These hold text only, so without an end tag they run to the end of the page; of the others only the start tag goes.
TO_END = frozenset("script style title textarea".split())
OUTSIDE = frozenset("head nav footer aside form button select dialog menu header".split())
SLOTS = frozenset("p li td tr h1 h2 h3 h4 h5 h6 ul ol table tbody blockquote pre".split())
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
#: Words of class and id values that name what is not the article, and words that may stand beside them in one value (fixed values).
UNWANTED = frozenset(
    "banner promo consent notice popup modal nav navbar navigation menu header footer sidebar aside widget "
    "related share sharing social respond reply replies subscribe signup login search form toolbar pagination pager".split()
)
BESIDE = frozenset("site page main top bottom left right global list section wrapper wrap container box bar block area region group item items inner outer links link buttons icons post posts story stories article articles content "
                   "reading primary secondary mobile desktop".split())
#: Words that name reader comments, and adverts and notices, whatever stands beside them, unless one of ABOUT does (fixed values).
COMMENTS = frozenset("comment comments commentlist commenter disqus".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adsense sponsor sponsored cookie cookies gdpr breadcrumb breadcrumbs newsletter".split())
ABOUT = frozenset("has no with without is not free open closed enabled disabled allow category tag topic term type format author archive".split())
#: Elements whose class and id say nothing about what they hold, and elements of running text.
PLAIN = frozenset("html body main".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption".split())
LONGEST_LABEL = 60
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|$)", re.S)
#: One attribute after the other, so that nothing inside a value is taken for a name.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Kinds of a page's tokens.
START, END, TEXT_BLOCK = 0, 1, 2
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())


def _attributes(text: str) -> dict[str, str]:
    """Names, in lower case, and values; of an attribute given twice the first counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").strip())
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_INVISIBLE.search(attributes.get("style", "")))


def _named_values(attributes: dict[str, str]) -> list[str]:
    return [v for key in ("class", "id") for v in attributes.get(key, "").lower().split()]


def _kind(value: str) -> str:
    """What one class or id value names: comments, an advert, something else beside the article, or nothing known.

    The value is read by its parts between hyphens and underscores. Words of COMMENTS and ADVERTS tell alone; one of
    UNWANTED does if all parts are words of it or of BESIDE: `site-footer` does, `has-sidebar` and `long-form` don't.
    """
    parts = [x for x in re.split("[-_]+", value) if x and not x.isdigit()]
    if not ABOUT.isdisjoint(parts):
        return ""
    if not COMMENTS.isdisjoint(parts):
        return "comments"
    if not ADVERTS.isdisjoint(parts):
        return "advert"
    return "beside" if any(x in UNWANTED for x in parts) and all(x in UNWANTED or x in BESIDE for x in parts) else ""


def _told(name: str, values: list[str]) -> str:
    """What class and id values tell of an element. A paragraph or heading needs all values to tell, so that `intro share` stays."""
    if name in PLAIN or not values:
        return ""
    kinds = [_kind(v) for v in values]
    if name in TEXT and not all(kinds):
        return ""
    return next((k for k in ("comments", "advert", "beside") if k in kinds), "")


def _node(name: str, attributes: str) -> tuple[str, bool, str]:
    """An element's name in a path, whether its text is unwanted for sure, and what its class and id tell."""
    if not attributes or attributes.isspace():
        return name, name in OUTSIDE, ""
    found, label = _attributes(attributes), name
    for key, value in found.items():
        if key in ("class", "id"):
            value = value.lower()
            # a long value is told by its digest; paths are split on /
            told = value if len(value) <= LONGEST_LABEL else xxhash.xxh3_64_hexdigest(value.encode("utf-8", "surrogatepass"))
            label += ("." if key == "class" else "#") + told.replace("%", "%25").replace("/", "%2F")
    sure = name in OUTSIDE or _hidden(found) or found.get("role", "").lower() in ROLES
    return label, sure, _told(name, _named_values(found))


def _muted(attributes: str) -> bool:
    """Whether an inline element is hidden or an advert."""
    if not attributes or attributes.isspace():
        return False
    found = _attributes(attributes)
    return _hidden(found) or any(_kind(v) == "advert" for v in _named_values(found))


def blocks(page: str | None) -> tuple[list[str], list[tuple[str, bool, str, int]], list[tuple[int, int]]]:
    """The paths of a page's root and block elements, its text blocks: (path, unwanted, text, characters in links), and
    its tokens in page order: (START, END or TEXT_BLOCK, number of the element or block)."""
    page = page or ""
    paths: list[str] = [""]
    out: list[tuple[str, bool, str, int]] = []
    order: list[tuple[int, int]] = [(START, 0)]
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]
    told: list[tuple[int, int, str, str]] = []
    parts: list[str] = []
    linked = [0, 0]
    endless: set[str] = set()
    begun: list[tuple[int, int, str, str]] = []
    muted: list[str] = []

    def flush() -> None:
        muted.clear()
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            order.append((TEXT_BLOCK, len(out)))
            out.append((stack[-1][1], stack[-1][2], text, linked[1]))
        linked[1] = 0

    def close(k: int) -> None:
        flush()
        order.extend((END, i) for *_, i in reversed(stack[k:]))
        del stack[k:]
        while begun and begun[-1][0] >= k:
            _, first, name, kind = begun.pop()
            told.append((first, len(out), name, kind))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not muted:
            parts.append(page[at:end])
            linked[1] += (end - at) * (linked[0] > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", m.start()) and not muted:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name, shut = m[2].lower(), bool(m[1])
        if name in RAW:
            if not shut and (name in TO_END or not m[3].endswith("/")):
                over = None if name in endless else re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|$)", re.I).search(page, at)
                if over:
                    at = over.end()
                elif name in TO_END:
                    at = len(page)
                else:
                    endless.add(name)
                if name not in ("object", "svg", "math", "canvas", "audio", "video", "iframe"):
                    parts.append(" " if name != "title" else "")
            continue
        if name in INLINE:
            if muted:
                # the same element may stand inside; a block ends it in any case
                muted.append(name) if name == muted[0] and not shut else muted.pop() if name == muted[0] else None
            elif not shut and name not in VOID and _muted(m[3]):
                muted.append(name)
            if name == "br":
                parts.append("\n")
            elif name == "a":
                linked[0] = 0 if shut else 1
            continue
        flush()
        linked[0] = 0
        if name in VOID:
            continue
        if shut:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if k:
                close(k)
            continue
        while len(stack) > 1 and name in CLOSES.get(stack[-1][0], ()):
            close(len(stack) - 1)
        label, bad, kind = _node(name, m[3])
        if name == "form" and not stack[-1][2]:
            bad = _node("div", m[3])[1]
            kind = kind or "form"
        if kind and not bad and not stack[-1][2]:
            # judged when all of the page is read
            begun.append((len(stack), len(out), name, kind))
        order.append((START, len(paths)))
        stack.append((name, f"{stack[-1][1]}/{label}", bad or stack[-1][2], len(paths)))
        paths.append(stack[-1][1])
    close(1)
    order.append((END, 0))
    _drop_told(out, told)
    return paths, out, order


def _drop_told(out: list[tuple[str, bool, str, int]], told: list[tuple[int, int, str, str]]) -> None:
    """Elements that class, id or being a form tells against are unwanted, unless they are the article after all.

    Comments, and forms whose name tells, stay only as a page's sole prose; an advert's or a notice's name does not make one of what has four fifths
    of the prose, nor another name of what has half of it; an article goes as a comment only. A form stays around
    most of a page's prose, paragraphs and all: some servers put it around whole pages.
    """
    prose = lambda first, end: sum(_chars(bad, text, links) for _, bad, text, links in out[first:end])
    whole = prose(0, len(out))
    for first, end, name, kind in sorted(told, key=lambda x: (x[0], -x[1])):
        own = prose(first, end)
        if kind == "form":
            stays = 2 * own > whole and any(_tag(b[0]) in TEXT for b in out[first:end])
        elif kind == "comments" or name == "form":
            stays = own == whole
        elif name == "article":
            stays = True
        else:
            stays = (5 * own >= 4 * whole) if kind == "advert" else 2 * own > whole
        if not stays:
            out[first:end] = [(path, True, text, links) for path, _, text, links in out[first:end]]


def _chars(bad: bool, text: str, links: int) -> int:
    """Characters of prose in a text block: it is neither unwanted nor mostly links."""
    return 0 if bad or 2 * links > len(text) else len(text)


def _prose(found: list[tuple[str, bool, str, int]]) -> Counter:
    """Characters of prose by path."""
    prose: Counter = Counter()
    for path, bad, text, links in found:
        if n := _chars(bad, text, links):
            prose[path] += n
    return prose


def _above(path: str) -> list[str]:
    """A path and all paths above it, down to the root's empty one."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(len(parts), 0, -1)]


def _held(prose: dict[str, int]) -> Counter:
    """Characters of prose by path, with all below it."""
    held: Counter = Counter()
    for path, n in prose.items():
        for p in _above(path):
            held[p] += n
    return held


def _text_hash(path: str, text: str) -> int:
    """A text block's key: the same text under another path is another block."""
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode()) >> 1 or 1


def _key(path: str, text_hash: int) -> int:
    """A token's key: a text block's hash, or an element's, by its path."""
    return text_hash or xxhash.xxh3_64_intdigest(path.encode()) >> 1 or 1


def _signed(paths: list[str], found: list[tuple[str, bool, str, int]], order: list[tuple[int, int]]) -> list[int]:
    """The keys of a page's tokens in page order; an element's end has its key below 0."""
    named = {p: _key(p, 0) for p in set(paths)}
    return [_text_hash(found[i][0], found[i][2]) if kind == TEXT_BLOCK else named[paths[i]] if kind == START else -named[paths[i]] for kind, i in order]


TOKENS = "host string, path string, text_hash long, pages long, sig long, good long, at long"


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of pages, combined as far as a batch goes: support, digest of the occurrence vector, characters of prose
    (an element's with all below it), and its first place on one page, the same for all tokens with its vector: the
    smallest of a page's digest, 31 bits, and the place there."""
    for batch in batches:
        sums: dict[tuple[str, str, int], list[int]] = {}
        for digest, host, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            paths, found, order = blocks(page)
            times: Counter = Counter()
            first: dict[tuple[str, int], int] = {}
            good: Counter = Counter({(path, 0): n for path, n in _held(_prose(found)).items()})
            for at, (kind, i) in enumerate(order):
                if kind == END:
                    continue
                if kind == START:
                    key = paths[i], 0
                else:
                    path, bad, text, links = found[i]
                    key = path, _text_hash(path, text)
                    good[key] += _chars(bad, text, links)
                times[key] += 1
                first.setdefault(key, at)
            page_bits = (digest & 0x7FFFFFFF) << 32
            for (path, h), n in times.items():
                sig = xxhash.xxh3_64_intdigest(f"{digest}:{n}") >> 1
                s = sums.get((host, path, h))
                if s is None:
                    sums[host, path, h] = [1, sig, good[path, h], page_bits | first[path, h]]
                    continue
                s[0] += 1
                s[1] ^= sig
                s[2] += good[path, h]
                s[3] = min(s[3], page_bits | first[path, h])
        columns = [[k[i] for k in sums] for i in range(3)] + [[v[i] for v in sums.values()] for i in range(4)]
        kinds = [pa.string(), pa.string()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in TOKENS.split(", ")])


def _classes(tokens: list[dict]) -> list[list[dict]]:
    """A host's equivalence classes, each in the order of one page that has it: the root's, then by support and size."""
    by_vector = defaultdict(list)
    for t in tokens:
        by_vector[t["sig"]].append(t)
    root = next(t["sig"] for t in tokens if t["path"] == "" and not t["text_hash"])
    large = [sorted(c, key=lambda t: t["at"]) for sig, c in by_vector.items() if sig == root or sum(1 if t["text_hash"] else 2 for t in c) >= LARGE]
    return sorted(large, key=lambda c: (c[0]["sig"] != root, -c[0]["pages"], -len(c), c[0]["at"]))


def _sequence(members: list[dict]) -> list[int]:
    """A class's signed keys in order: an element ends before the first token outside its path."""
    keys: list[int] = []
    begun: list[tuple[str, int]] = []
    for t in members:
        while begun and not (t["path"].startswith(begun[-1][0] + "/") or t["text_hash"] and t["path"] == begun[-1][0]):
            keys.append(-begun.pop()[1])
        keys.append(_key(t["path"], t["text_hash"]))
        if not t["text_hash"]:
            begun.append((t["path"], keys[-1]))
    return keys + [-key for _, key in reversed(begun)]


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One host's supported tokens a row -> its classes, as lists of signed keys."""
    for batch in batches:
        hosts, tokens = (c.to_pylist() for c in batch.columns)
        classes = [json.dumps([_sequence(c) for c in _classes(t)]) for t in tokens]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(classes, pa.string())], ["_host", "classes"])


class _Numbered:
    """A host's classes with their tokens numbered through, without the tokens that left them."""

    def __init__(self, classes: list[list[int]], left: tuple[int, ...] = ()) -> None:
        self.keys = [key for keys in classes for key in keys]
        self.number = {key: i for i, key in enumerate(self.keys)}
        self.sizes = [len(keys) for keys in classes]
        self.starts = [0, *accumulate(self.sizes)][:-1]
        gone = {abs(self.keys[i]) for i in left}
        self.owner: dict[int, int] = {}
        self.ends: list[tuple[int, int]] = []
        for c, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            kept = [i for i in range(start, start + size) if abs(self.keys[i]) not in gone]
            # an element leaves with both its tokens
            if c and len(kept) < LARGE:
                kept = []
            self.owner.update(dict.fromkeys(kept, c))
            self.ends.append((kept[0], kept[-1]) if kept else (-1, -1))
        self.loose = {i for i in range(self.sizes[0]) if i not in self.owner and self.keys[i] > 0}


@lru_cache(maxsize=64)
def _numbered(classes: str, left: tuple[int, ...] = ()) -> _Numbered:
    return _Numbered(json.loads(classes), left)


def _disordered(ids: tuple[int, ...], known: _Numbered) -> set[int]:
    """The tokens of a page that break their class's order: those outside a longest part in order."""
    times: Counter = Counter()
    places = defaultdict(list)
    for i in ids:
        c = known.owner[i]
        places[c].append((times[i] * known.sizes[c] + i - known.starts[c], i))
        times[i] += 1
    out: set[int] = set()
    for found in places.values():
        if all(a < b for a, b in zip(found, found[1:])):
            continue
        lowest: list[int] = []
        at: list[int] = []
        before: list[int] = []
        for k, (value, _) in enumerate(found):
            n = bisect_left(lowest, value)
            lowest[n : n + 1] = [value]
            before.append(at[n - 1] if n else -1)
            at[n : n + 1] = [k]
        kept, k = set(), at[-1]
        while k >= 0:
            kept.add(k)
            k = before[k]
        out.update(i for k, (_, i) in enumerate(found) if k not in kept)
    return out


SEQUENCES = "host string, ids array<int>, wrong array<int>, pages long"


def _sequence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as sequences of their classes' tokens, equal ones combined as far as a batch goes, and the tokens that break an order."""
    for batch in batches:
        pages: Counter = Counter()
        classes: dict[str, str] = {}
        for host, page, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            number = _numbered(text).number
            pages[host, tuple(number[k] for k in _signed(*blocks(page)) if k in number)] += 1
            classes[host] = text
        wrong = [sorted(_disordered(ids, _numbered(classes[host]))) for host, ids in pages]
        columns = [[k[0] for k in pages], [list(k[1]) for k in pages], wrong, list(pages.values())]
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "ids", "wrong", "pages"])


NESTING = "host string, inner int, outer int, lo int, hi int, times long"
#: Places of a pair of classes that overlap in part.
OVERLAP = (-1, 2**31 - 1)


def _nesting(ids: list[int], known: _Numbered) -> Iterator[tuple[int, int, int, int]]:
    """(class, class around it, its place there twice) of each occurrence; (class, -1, 0, 0) once an occurrence; and
    (-1 - token, number of root tokens before it, 0, 0) of tokens that left the root's class."""
    begun: list[list[int]] = []
    before = 0
    for i in ids:
        c = known.owner.get(i)
        if c is None:
            if i in known.loose:
                yield -1 - i, before, 0, 0
            continue
        before += c == 0
        if i == known.ends[c][0]:
            yield c, -1, 0, 0
            for a, place in begun:
                yield c, a, place, place
            begun.append([c, i])
            continue
        k = next(k for k in range(len(begun) - 1, -1, -1) if begun[k][0] == c)
        for x, _ in begun[k + 1 :]:
            yield x, c, *OVERLAP
        begun[k][1] = i
        if i == known.ends[c][1]:
            del begun[k]


def _nesting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of classes in each other, combined as far as a batch goes: smallest, largest, occurrences."""
    for batch in batches:
        sums: dict[tuple[str, int, int], list[int]] = {}
        for host, ids, pages, classes, left in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for inner, outer, lo, hi in _nesting(ids, _numbered(classes, tuple(sorted(left or ())))):
                s = sums.setdefault((host, inner, outer), [lo, hi, 0])
                s[:] = min(s[0], lo), max(s[1], hi), s[2] + pages
        columns = [[k[i] for k in sums] for i in range(3)] + [[v[i] for v in sums.values()] for i in range(3)]
        kinds = [pa.string()] + [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in NESTING.split(", ")])


def _nested(n: int, pairs: dict[tuple[int, int], tuple[int, int, int]]) -> list[int]:
    """The valid classes of n: each in turn, if it is nested with those before."""
    against = defaultdict(set)
    for (inner, outer), (lo, hi, times) in pairs.items():
        if inner >= 0 and outer >= 0 and (lo != hi or times != pairs[inner, -1][2]):
            against[inner].add(outer)
            against[outer].add(inner)
    valid = {0}
    for c in range(1, n):
        if (c, -1) in pairs and valid.isdisjoint(against[c]):
            valid.add(c)
    return sorted(valid)


def containers(held: dict[str, int]) -> list[str]:
    """The paths of the main containers, by the prose that each element holds with all below it.

    These are the outermost articles and mains, if there is a main or they hold most of the prose; else the deepest
    element that holds all of it.
    """
    whole = held.get("", 0)
    if whole <= 0:
        return [""]
    named = sorted({"/".join(parts[: k + 1]) for path, n in held.items() if n > 0 for parts in [path.split("/")] for k in [_named(parts)] if k})
    if any(_tag(path) == "main" for path in named) or sum(held.get(path, 0) for path in named) >= MOST * whole:
        return named or [""]
    # a paragraph or list item is a slot, not a container
    return [max((path for path, n in held.items() if n >= whole and _tag(path) not in SLOTS), key=lambda x: x.count("/"), default="")]


def _tag(path: str) -> str:
    return path.rpartition("/")[2].split(".")[0].split("#")[0]


def _named(parts: list[str]) -> int:
    """The place of the outermost article or main in a path's parts, 0 without one."""
    return next((k for k, part in enumerate(parts) if _tag(part) in ("article", "main")), 0)


def _template_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One host's supported tokens and what its pages told of their classes a row -> its template: the main containers,
    the hashes of template texts, and, where texts left the root's class, the keys of its tokens and these texts' places."""
    for batch in batches:
        hosts, templates = [], []
        for host, tokens, left, nesting in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            classes = _classes(tokens)
            known = _Numbered([_sequence(c) for c in classes], tuple(left or ()))
            pairs = {(x["inner"], x["outer"]): (x["lo"], x["hi"], x["times"]) for x in nesting}
            # every page with an element has its parent too, so the parent has at least its support: all paths nest
            held = {t["path"]: t["good"] for t in tokens if not t["text_hash"]}
            once = {t["path"]: t["good"] for t in classes[0] if not t["text_hash"]}
            texts: list[int] = []
            places: dict[int, list[int]] = {}

            def take(t: dict, good: int, held: dict = held) -> None:
                # what is left is the slots' prose
                for path in _above(t["path"]):
                    held[path] -= good

            for c in _nested(len(classes), pairs):
                for t in classes[c]:
                    if not t["text_hash"] or known.owner.get(known.number[t["text_hash"]]) is None:
                        continue
                    if not c or known.owner.get(known.number.get(_key(t["path"], 0))) == c:
                        texts.append(t["text_hash"])
                        take(t, t["good"])
            roles = defaultdict(list)
            for (inner, outer), (_, _, times) in pairs.items():
                if inner < 0 and times >= PLACE_PAGES:
                    roles[known.keys[-1 - inner]].append((outer, times))
            for t in classes[0]:
                if not t["text_hash"] or known.number[t["text_hash"]] in known.owner:
                    continue
                if once.get(t["path"]) == t["good"]:
                    texts.append(t["text_hash"])
                    take(t, t["good"])
                elif t["text_hash"] in roles:
                    places[t["text_hash"]] = sorted(place for place, _ in roles[t["text_hash"]])
                    take(t, t["good"] * sum(times for _, times in roles[t["text_hash"]]) // t["pages"])
            root = [known.keys[i] for i, c in known.owner.items() if c == 0] if places else []
            hosts.append(host)
            templates.append(json.dumps([containers(held), sorted(texts), root, places]))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(templates, pa.string())], ["_host", "template"])


@lru_cache(maxsize=64)
def _template(text: str) -> tuple[list[str], frozenset[int], frozenset[int], dict[int, list[int]]]:
    tops, texts, root, places = json.loads(text)
    return tops, frozenset(texts), frozenset(root), {int(h): x for h, x in places.items()}


def _common(page: tuple, texts: frozenset[int], root: frozenset[int], places: dict[int, list[int]]) -> list[bool]:
    """Which of a page's text blocks are the template's: by class, or by their place among the root's tokens."""
    _, found, order = page
    if not places:
        return [_text_hash(b[0], b[2]) in texts for b in found] if texts else [False] * len(found)
    common, before = [], 0
    for (kind, _), key in zip(order, _signed(*page), strict=True):
        if kind == TEXT_BLOCK:
            common.append(key in texts or before in places.get(key, ()))
        before += key in root
    return common


def main_text(page: str | None, template: str | None) -> str:
    """The main text of a page under its host's template; without one, under its own container."""
    whole_page = blocks(page)
    found = whole_page[1]
    tops, *known = _template(template) if template else ([], frozenset(), frozenset(), {})
    inside = lambda path: any(path == t or path.startswith(t + "/") for t in tops)
    left = _without_template(found, _common(whole_page, *known), inside, tops)
    prose = _prose(left)
    if not prose and (whole := _prose(found)):
        # the template holds all of the page's prose, so it tells nothing about this page
        tops, left, prose = [], found, whole
    # a page of another layout has little of its prose in the host's containers
    if not any(inside(p) for p, *_ in left) or sum(n for p, n in prose.items() if inside(p)) < MOST * sum(prose.values()):
        tops = containers(_held(prose))
    return "\n\n".join(text for path, bad, text, _ in left if not bad and inside(path))


def _without_template(found: list, common: list[bool], inside, tops: list[str]) -> list:
    """The text blocks without the template's. An article or main keeps its own repeated text; in a container without
    such a name what repeats on every page stays between slots, as a heading, and goes at the container's edges."""
    if not any(common):
        return found
    named = [t for t in tops if _tag(t) in ("article", "main")]
    slots = [i for i, b in enumerate(found) if not common[i] and not b[1] and inside(b[0])]
    between = lambda i: bool(slots) and slots[0] < i < slots[-1]
    own = lambda i, path: any(path == t or path.startswith(t + "/") for t in named) or (inside(path) and between(i))
    return [b for i, b in enumerate(found) if not common[i] or own(i, b[0])]


def _hosted(pages: DataFrame) -> DataFrame:
    """The pages' page_id, url and html with their host, _h."""
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^.*@", ""))
    return pages.select("page_id", "url", "html").withColumn("_h", host)


def distinct_pages(pages: DataFrame) -> DataFrame:
    """_d, _h and html: every distinct page of a host once. Only one row of each group of copies is moved."""
    p = _hosted(pages).withColumn("_d", F.xxhash64("html"))
    groups = p.groupBy("_h", "_d").agg(F.count(F.lit(1)).alias("_copies"), F.min("page_id").alias("_first")).filter("_copies > 1")
    groups, _ = small_or(written(groups.select(F.col("_h").alias("_gh"), F.col("_d").alias("_gd"), "_first")), MAX_BROADCAST_COPIES)
    same = (F.col("_h") == F.col("_gh")) & (F.col("_d") == F.col("_gd"))
    once = p.join(groups, same, "left_anti").select("_d", "_h", "html")
    # rows with the same page_id too are combined by their key
    first = p.join(groups, same & F.col("page_id").eqNullSafe(F.col("_first"))).select("_d", "_h", "html").dropDuplicates(["_h", "_d"])
    return once.unionByName(first)


def _with_host(rows: DataFrame, known: DataFrame, host: str, salt: str, how: str = "inner") -> DataFrame:
    """Rows with what is known of their host, a written table of one row a host (_host and a text, and arrays)."""
    text = next(c for c in known.columns if c != "_host")
    known, small = small_or(known, MAX_BROADCAST_HOSTS)
    if small and (known.agg(F.sum(F.length(text))).first()[0] or 0) <= MAX_BROADCAST_CHARS:
        return rows.join(known, F.col(host) == F.col("_host"), how)
    # a host with most pages is dealt to SALTS tasks
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(known, (F.col(host) == F.col("_host")) & (F.col("_s") == F.col("_salt")), how)


def templates(pages: DataFrame) -> DataFrame:
    """(_host, template) of every host with enough pages."""
    once = distinct_pages(pages)
    tokens = mapped(once, _token_batches, TOKENS)
    tokens = tokens.groupBy("host", "path", "text_hash").agg(
        F.sum("pages").alias("pages"), F.bit_xor("sig").alias("sig"), F.sum("good").alias("good"), F.min("at").alias("at")
    )
    tokens = written(tokens.filter(f"pages >= {MIN_PAGES}"))
    hosts = tokens.filter("path = '' AND text_hash = 0").select(F.col("host").alias("_h"), F.col("pages").alias("n"))
    # at least half of a host's pages: so a page's tokens bound what a host can have
    able = tokens.join(hosts, F.col("host") == F.col("_h")).filter(F.col("pages") >= SUPPORT * F.col("n"))
    able = written(able.groupBy("host").agg(F.collect_list(F.struct("path", "text_hash", "pages", "sig", "good", "at")).alias("tokens")))
    classes = written(mapped(able, _class_batches, "_host string, classes string"))
    # the pages are parsed once more; after that their sequences of tokens do
    rows = _with_host(once, classes, "_h", "_d").select(F.col("_h").alias("host"), "html", "classes")
    sequences = written(mapped(rows, _sequence_batches, SEQUENCES))
    left = sequences.select(F.col("host").alias("_lh"), F.explode("wrong").alias("id")).groupBy("_lh").agg(F.collect_set("id").alias("left"))
    left = written(left)
    known = written(classes.join(left, F.col("_host") == F.col("_lh"), "left").select("_host", "classes", "left"))
    rows = _with_host(sequences, known, "host", "ids").select("host", "ids", "pages", "classes", "left")
    nesting = mapped(rows, _nesting_batches, NESTING).groupBy("host", "inner", "outer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("times").alias("times"))
    nesting = nesting.groupBy(F.col("host").alias("_nh")).agg(F.collect_list(F.struct("inner", "outer", "lo", "hi", "times")).alias("nesting"))
    per = able.join(nesting, F.col("host") == F.col("_nh")).join(left, F.col("host") == F.col("_lh"), "left")
    return written(mapped(per.select("host", "tokens", "left", "nesting"), _template_batches, "_host string, template string"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    p = _with_host(_hosted(pages), templates(pages), "_h", "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), t.as_py()) for h, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(p.select("page_id", "url", "html", "template"), run, "page_id long, url string, text string, n_chars long")
