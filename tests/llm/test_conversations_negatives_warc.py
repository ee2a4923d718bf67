"""Conversation repair, hard negatives and archives against brute-force versions and odd tables."""

import base64
import gzip
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityportrait.llm import conversations as conv, negatives, warc

SF = "/root/testdata/sf0.001"
NO_HASH = hashlib.sha256(b"").hexdigest()


# --- conversations


def damage(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        own = out[conv_id]
        name = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if h:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by a search over single edits, cheapest and ASCII-least first."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return faults, cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        more = [(2, "I", i, x, f"{r}:") for x, r in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, role, text = rows[i]
            late = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                more += [(2 + late, "R", i + 1, x, f"{r}:{text}") for x, r in (("u", "user"), ("a", "assistant"))] + [(late, "K", i + 1, role[:1], f"{role}:{text}")]
        for c, edit, at, letter, line in more:
            if (state, letter) in step and (edit != "I" or len(audit) < 3 * len(rows) + 3):
                heapq.heappush(heap, (cost + c, audit + edit, at, step[state, letter], (*lines, line)))


def brute(rows):
    out = {}
    for conv_id, own in ({r[0]: [] for r in rows} | damage(rows)).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        if not own:
            out[conv_id] = (0, 0, 0, 0, 0, 0, "", NO_HASH)
            continue
        faults, cost, audit, lines = cheapest(own)
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv_id] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("_h", "place", "there", "sequence", "n", "of", "_key", "late")])


def result(df):
    rows = df.select(*conv.RESULT_NAMES).collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_conversations(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "ultra"]
    texts = ["Yes.", "No!", "Why?", "open", " \t", "", None, "Yes.", "end. \n", "é日。", "a.b"]
    rows = []
    for c in range(120):
        n = rng.randrange(1, 9)
        for t in range(n):
            turn = rng.choice([t, t, t, t + 3, None, 1])
            rows.append((c, turn, rng.choice(roles[:5] if c % 2 else roles), rng.choice(texts)))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (-3, None, None, None), (500, 7, "user", "x" * 300_000 + ".")]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_a_search_over_edits(spark, seed):
    rows = odd_conversations(seed)
    assert result(conv.repair(table(spark, rows))) == brute(rows)


def test_repair_of_a_long_conversation_in_many_blocks(spark):
    rng = random.Random(4)
    rows = [(9, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Turn {t}.", f"Turn {t % 5}.", "open", ""])) for t in range(900)]
    rows += [(9, 40, "user", "same.")] * 60 + [(c, 0, "user", "Hi.") for c in range(40, 60)]
    df = table(spark, rows).repartition(8)
    assert conv.blocks_of(df, 7).filter("conv_id = 9").count() > 100
    assert result(conv.repair(df, 7)) == brute(rows)


def test_repair_without_rows(spark):
    assert result(conv.repair(table(spark, []))) == {}
    # the only row of this conversation is dropped
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(conv.repair(table(spark, [(dropped, 0, "user", "Hi.")]))) == {dropped: (0, 0, 0, 0, 0, 0, "", NO_HASH)}


def test_symbols_share_the_work_and_keep_the_result(spark):
    rng = random.Random(5)
    sequences = ["".join(rng.choice("suaA-") for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["ua" * 300, "-" * 500]
    df = spark.createDataFrame([(s, 1 + i % 3) for i, s in enumerate(sequences)], "sequence string, n long")
    grammar, plain = conv.re_pair(df, least=2).evaluated(), conv.Grammar([], []).evaluated()
    assert len(grammar.rules) > 50 and len(grammar.packed("ua" * 300)) < 20
    for s in sequences:
        assert grammar.matrix(s) == plain.matrix(s)


# --- hard negatives


def scores_by_hand(rows):
    seen, v = set(), []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        key = vec_id, tuple(vector), label
        if key not in seen:
            seen.add(key)
            v.append((vec_id, [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a in v:
        if a[0] % 50:
            continue
        s = sorted((-min(max(sum(x * y for x, y in zip(a[1], b[1], strict=False)), negatives.LOW), negatives.HIGH), b[0], b[2]) for b in v if b[0] != a[0])
        for ps, pid, _ in [x for x in s if x[2] == a[2]][:5]:
            under = [x for x in s if x[2] != a[2] and -50 * ps <= -100 * x[0] <= -95 * ps][:3]
            out += [(a[0], pid, k, x[1], -ps, -x[0]) for k, x in enumerate(under, 1)]
    return sorted(out)


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.select("*", *[F.lit(1).alias(c) for c in ("anchor", "_block", "_share", "positives", "n")])


@pytest.mark.parametrize("scale", [1.0, 2.0**20, 2.0**52, 2.0**90])
def test_negatives_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "BLOCK", 5)
    monkeypatch.setattr(negatives, "SHARE", 60)
    rng = np.random.default_rng(3)
    # coarse components, so that scores tie
    rows = [(i, [float(np.float32(x)) * scale for x in rng.integers(-3, 9, 6) / 8], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(450, [1.0 * scale] * 9, 1), (500, [], 2), (550, None, 1), (600, [None, 1.0], 1), (650, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (750, [1.0] * 6, None)]
    rows += rows[:60] + [(100, [0.5 * scale] * 6, 1)]
    df = negatives.hard_negatives(vectors(spark, rows, "double"))
    got = sorted(tuple(r) for r in df.collect())
    assert got == scores_by_hand(rows) and len(got) >= 15


def test_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0


def test_packed_fields_hold_the_largest_sums():
    rng = np.random.default_rng(6)
    for size in (2, 300, 2**20, 2**25, 2**40):
        a, c = (rng.integers(-size, size + 1, (n, 17)) for n in (5, 23))
        a[0], c[0], c[1] = size, size, -size
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), negatives.LOW), negatives.HIGH) for q in c] for p in a]
        assert negatives.packed_scores(a.astype(np.float64), c.astype(np.float64)).tolist() == want


# --- archives

PAGES = [
    (1, "http://a.example/", "é"), (2, "http://b.example/\r\nx", "é"), (3, None, None), (4, "u", ""), (None, "u", "é"), (None, "u", "lone"), (7, "u", "WARC/1.1\r\n\r\nHTTP"),
    (7, "u", "WARC/1.1\r\n\r\nHTTP"), (-5, "u", "x" * 100_000), (8, "u", "<p>\r\nContent-Length: 3\r\n\r\n"), (9, "u", "é"), (10, "u", "É"),
]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("payload", "sha256", "header", "row", "count", "n")])


def archive_by_hand(rows):
    best = {}
    for page_id, _, html in rows:
        b = (html or "").encode()
        if b not in best or (page_id is not None and (best[b] is None or page_id > best[b])):
            best[b] = page_id
    out, taken = [], set()
    for page_id, _, html in rows:
        b = (html or "").encode()
        first = page_id == best[b] and b not in taken
        taken |= {b} if first else set()
        out.append((str(page_id), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best[b]))
    return sorted(out, key=str)


def read_result(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_archive_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "MAX_BROADCAST_COPIES", bound)
    rows = PAGES + [(100 + i, "u", "copy") for i in range(50)]
    assert read_result(warc.warc(pages(spark, rows))) == archive_by_hand(rows)
    assert warc.warc(pages(spark, [])).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = read_result(warc.warc(pages(spark, PAGES), min_bytes=3))
    assert {r[3] for r in got if r[1] < 3} == {"response"} and sum(r[3] == "revisit" for r in got) == 1


def test_archive_round_trip(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(["a", "b", "a", "é\r\n\r\n", "", "a", "\0\n"])]
    archive = warc.archived(pages(spark, rows))
    assert archive.payloads.count() == 5
    assert sorted(tuple(r) for r in warc.pages_of(archive).collect()) == rows
    one = pages(spark, [(1, "http://b.example/\r\nx", "é")])
    assert warc.pages_of(warc.archived(one)).first().url == "http://b.example/%0D%0Ax"


def test_warc_files_can_be_read_by_their_lengths(spark, tmp_path):
    archive = warc.archived(pages(spark, PAGES))
    warc.files(archive, str(tmp_path / "w"))
    found = []
    for f in Path(tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            block, data = rest[:n], rest[n:]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            body = block.partition(b"\r\n\r\n")[2]
            assert (fields["WARC-Type"] == "revisit") == ("WARC-Refers-To" in fields)
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                assert not body
            found.append(fields["WARC-Type"])
    assert len(found) == len(PAGES) and found.count("response") == len({p[2] or "" for p in PAGES})


def test_a_damaged_payload_is_an_error(spark):
    archive = warc.archived(pages(spark, PAGES))
    broken = warc.Archive(archive.payloads.withColumn("payload", F.concat("payload", F.lit("x").cast("binary"))), archive.headers)
    with pytest.raises(Exception, match="another digest"):
        warc.read_back(broken).collect()
