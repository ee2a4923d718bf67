"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html as entities
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas
import pytest
from pyspark.sql import functions as F

from cityportrait.llm import common, host_rules, html, licenses, lm, media, mixing, neardup, pii, quality, spm, sql

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = [
    (900001, "x a@b.co_x@c.de 1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 é😀 4111 1111-1111 1111 +1 (555) 555-0199 iban GB82 WEST 1234 5698 7654 32 ssn 123-45-6789", "en", "s", 3),
    (900002, None, None, None, None),
    (900003, "", "en", "s", 0),
    (900004, "a1@b.co " * 700 + " 1234567890123" * 10, "en", "s", 0),
    (900005, "9" * 4000, "en", "s", 0),
    (900006, "a b c a b c a b c d", "en", "s", 0),
    (900007, "a b c d e f g h i j k l", "en", None, 0),
    (900008, "A b c d e f g h i j k l m", "en", "s", 0),
    (900009, "Mit License, mit-license CC BY", "en", "s", 0),
    (900009, "Mit License, mit-license CC BY", "en", "s", 0),
    (900010, "  \t\n tab\x0bbed\x0c words\r\nÀ ▁ 日本\n\n same line\n same line\n", "en", "s", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(EXTRA, SCHEMA))
    # columns whose names an operator might use itself
    return d.select("*", *[F.lit(1).alias(c) for c in ("size", "kept", "rep", "key", "n_words", "base_failed", "_id", "row", "score", "x")]).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in re.split(SPACE, t) if w]


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def as_bag(rows):
    return Counter(map(tuple, rows))


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def base_spans(t):
    out = []
    for kind, p in pii.PLAIN.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(docs, texts, empty):
    want = []
    for i, t, _ in texts:
        s = base_spans(t)
        n = Counter(k for k, _, _ in s)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    got = pii.find(docs).collect()
    assert as_bag(r[:6] for r in got) == as_bag(want)
    added = next(r for r in got if r.doc_id == 900001)
    assert added.spans.endswith("iban:101:128,ssn:133:144") and added.top_score == 1.0
    clean = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert clean[900001].text == "x [EMAIL][EMAIL] [IP].[IP] 999.1.1.1 [IP] é😀 [CARD] [PHONE] iban [IBAN] ssn [SSN]"
    assert clean[900001].n_chars == len(clean[900001].text) and clean[900002].text is None and clean[900003].text == ""
    assert all(not base_spans(r.text) for r in clean.values() if r.text and r.doc_id != 900005)
    assert pii.find(empty).count() == 0 and pii.redacted(docs).columns == docs.columns


def rules(t):
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_host_rules(docs, texts, empty, spark):
    got = host_rules.quality(docs).collect()
    assert as_bag(r[:7] for r in got) == as_bag((i, *rules(t)) for i, t, _ in texts)
    assert all(not (r.kept and r.base_failed) for r in got)
    stay = host_rules.kept_documents(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert host_rules.quality(empty).count() == 0
    # a host of junk takes its suspicious documents along, and leaves its clean ones
    good = " ".join(f"word{i}" for i in range(80))
    odd = good.replace(" ", "## ")
    rows = [(i, "bad bad bad", "en", "junk", 0) for i in range(40)] + [(100, good, "en", "junk", 0), (101, odd, "en", "junk", 0), (102, odd, "en", "fine", 0)] + [(200 + i, good, "en", "fine", 0) for i in range(40)]
    kept = {r.doc_id for r in host_rules.quality(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()}
    assert 100 in kept and 101 not in kept and 102 in kept


def brute_kept(rows):
    """The rows (doc_id, text, source) that the rules and the hosts' verdicts keep, with their soft failures."""
    soft, base = {}, {}
    for k, (_, t, _) in enumerate(rows):
        n, chars, symbols, dup, _, base[k] = rules(t)
        lines = sum(bool(words(x)) for x in t.split("\n"))
        mean = chars / max(n, 1)
        s = host_rules.SOFT
        soft[k] = symbols > s["max_symbols_per_word"] * n or dup > s["max_dup_line_share"] * lines or mean < s["min_mean_word"] or mean > s["max_mean_word"]
    hosts = defaultdict(list)
    for k, (_, _, source) in enumerate(rows):
        hosts[source].append(base[k] or soft[k])
    every = [x for own in hosts.values() for x in own]
    m = min(max(sum(every) / len(every), 1e-3), 1 - 1e-3)
    spread = sum(len(x) * (sum(x) / len(x) - sum(every) / len(every)) ** 2 for x in hosts.values())
    able = len(every) - sum(len(x) ** 2 for x in hosts.values()) / len(every) - (len(hosts) - 1)
    within = (spread / (m * (1 - m)) - (len(hosts) - 1)) / able if able > 1e-6 else 0
    if within > 1e-9:
        weight = max(1 / min(within, 1) - 1, host_rules.LEAST_WEIGHT)
        most = min(host_rules.MAX_RATE, m + host_rules.DEVIATIONS * math.sqrt(m * (1 - m) / (weight + 1)))
    else:
        weight, most = 1e12, host_rules.MAX_RATE
    bad = {s for s, x in hosts.items() if (sum(x) + m * weight) / (len(x) + weight) > most}
    return [r for k, r in enumerate(rows) if not base[k] and not (r[2] in bad and soft[k])], len(bad)


def test_host_verdicts_reject_rows(spark):
    """A host that stands out from the others loses its suspicious documents, below the absolute bound too."""
    good = " ".join(f"word{i}" for i in range(80))
    odd = good.replace(" ", "## ")
    rows = [(h * 1000 + i, "bad" if i % 10 == 0 else odd if i % 10 == 1 else good, f"h{h}") for h in range(12) for i in range(100)]
    rows += [(90_000 + i, "bad" if i % 10 < 2 else odd if i % 10 < 4 else good, "worse") for i in range(100)]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    want, bad = brute_kept(rows)
    got = host_rules.quality(d).collect()
    assert bad == 1 and {r.doc_id for r in got if r.kept} == {i for i, _, _ in want}
    assert {r.doc_id for r in got if r.kept == r.base_failed} == {90_000 + i for i in range(100) if i % 10 in (2, 3)}
    assert {r.doc_id for r in host_rules.kept_documents(d).collect()} == {i for i, _, _ in want}
    db = duckdb.connect()
    documents = pandas.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})  # noqa: F841
    kept = db.execute(f"SELECT doc_id FROM ({sql.HOST_RULES}) WHERE kept").fetchall()
    assert {i for i, in kept} == {i for i, _, _ in want}


@pytest.mark.parametrize("per", [1, 3])
def test_hosts_that_do_not_differ_reject_nothing(spark, per):
    """Each host has a document or a few, one in seven odd, as one rate for all would give: every document stays."""
    good = " ".join(f"word{i}" for i in range(80))
    rng = np.random.default_rng(8)
    rows = [(i, good.replace(" ", "## ") if rng.random() < 1 / 7 else good, f"h{i // per}") for i in range(700)]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    assert host_rules.quality(d).filter("kept").count() == 700 and len(brute_kept(rows)[0]) == 700


def test_hosts_of_any_size_that_differ(spark):
    """Bad hosts among small and large ones: verdicts equal brute force, and a host never goes by a single document."""
    good = " ".join(f"word{i}" for i in range(80))
    odd, rng, rows = good.replace(" ", "## "), np.random.default_rng(9), []
    for h in range(150):
        rate = 0.8 if h % 10 == 0 else 0.05
        rows += [(len(rows) + i, odd if rng.random() < rate else good, f"h{h}") for i in range(int(rng.choice([1, 2, 5, 40, 100])))]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    want, bad = brute_kept(rows)
    got = host_rules.quality(d).collect()
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in want} and 5 <= bad <= 20
    sizes = Counter(s for *_, s in rows)
    lost = {rows[r.doc_id][2] for r in got if not r.kept}
    assert lost and all(sizes[s] > 1 for s in lost)


def shingles(t, k=2):
    w = words(lowered(t))
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def brute_components(items):
    sets = dict(items)
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_group(n=60):
    """Copies of a text with a growing number of edits: some link to others only, some to none."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(90)]
    out = []
    for k in range(n):
        w = list(base)
        for j in rng.choice(90, size=k // 4, replace=False):
            w[j] = f"e{k}x{j}" if k % 3 else f"s{j}"
        out.append((1000 + k, " ".join(w), "en", "s", 0))
    return out


def test_neardup(docs, texts, empty, spark):
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(near_group() + [(None, "a b", "en", "s", 0)], SCHEMA))
    items = [(i, shingles(t)) for i, t, _ in texts] + [(r[0], shingles(r[1])) for r in near_group()]
    want = brute_components(items)
    sizes = dict(items)
    got = neardup.near_duplicates(more).collect()
    assert len(got) == more.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sizes[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _, _ in texts if brute_components([(a, shingles(t)) for a, t, _ in texts])[i] == i}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    s = neardup.sketches([a, np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)]), a[:1], a[:3]])
    assert (s != neardup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.1


def brute_targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        goal = {s: 3.0 * size[s] if s in capped else rest * weight[s] / w for s in names}
        over = {s for s in names if goal[s] > 3 * size[s]} - capped
        if not over:
            return size, goal
        capped |= over


def brute_taken(rows, places, goal, size):
    """The schedule, slot by slot. places: hash of each row."""
    plan, total = [], 0.0
    for s in sorted((s for s in size if s is not None)) + [None] * (None in size):
        length = max(1, min(mixing.BLOCK_WORDS, math.floor(goal[s] / mixing.MIN_SLOTS)))
        n = -(-size[s] // length)
        slots = goal[s] * n / size[s] if size[s] else 0.0
        plan.append((s, length, n, total, total + slots))
        total += slots
    times, rank = Counter(), Counter()
    for i in range(math.ceil(total)):
        x = (i * mixing.GOLDEN % 1.0) * total
        s, _, n, _, _ = next(p for p in plan if p[3] <= x < p[4])
        if rank[s] < 3 * n:
            times[s, rank[s] % n] += 1
        rank[s] += 1
    out, at = [], Counter()
    for h, (i, t, s) in sorted(zip(places, rows, strict=True), key=lambda z: (z[0] & (2**64 - 1), z[1][0], len(words(z[1][1])))):
        n, length = len(words(t)), next(p[1] for p in plan if p[0] == s)
        a, b = at[s], at[s] + n
        out.append((i, sum(times[s, k] * (min(b, (k + 1) * length) - max(a, k * length)) for k in range(a // length, (b - 1) // length + 1)) if n else 0))
        at[s] = b
    return out


def test_mixing(docs, texts, empty):
    size, goal = brute_targets(texts)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    got = mixing.mix(docs).collect()
    n = {i: len(words(t)) for i, t, _ in texts}
    taken = Counter()
    for r in got:
        assert r.size == n[r.doc_id] and r.taken <= 3 * r.size and r.source_size == size[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(8, 0.03 * goal[s]) for s in goal)
    assert Counter((r.doc_id, r.taken) for r in got) == Counter(brute_taken(texts, [hashes[i] for i, _, _ in texts], goal, size))
    assert sorted(got, key=repr) == sorted(mixing.mix(docs.repartition(3)).collect(), key=repr)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_quality_held_out(spark, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(d, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
    # neither labels of held-out rows nor other columns matter
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    again = quality.scored(d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), other).collect()
    assert {r.doc_id: round(r.score, 9) for r in got} == {r.doc_id: round(r.score, 9) for r in again}
    assert quality.scored(empty, labels).count() == 0
    assert {r.score for r in quality.scored(d.limit(3), labels.limit(0)).collect()} == {0.5}


def test_quality_scores_equal_brute_force(docs, texts, spark):
    """Shrunk class covariances and log densities by numpy's own routines, from the statistics of each text."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    named = labels.withColumn("x", F.lit(1)).withColumn("text", F.lit("t"))
    got = sorted((r.doc_id, r.score) for r in quality.scored(docs, named).collect())
    assert len(got) == len(texts)
    y = {r.doc_id: r.quality for r in labels.collect()}
    x = {i: np.array(quality.statistics(t)) for i, t, _ in texts}
    rows = [(y[i], quality.statistics(t)) for i, t, _ in texts if i in y and zlib.crc32(str(i).encode()) % 3 != 1]
    parts = [np.array([s for c, s in rows if c == k]) for k in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(cov, parts)) / len(rows)
    density = []
    for c, p in zip(cov, parts):
        s = (1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled
        s = (1 - quality.TO_DIAGONAL) * s + quality.TO_DIAGONAL * np.diag(np.diag(s)) + quality.FLOOR * np.eye(len(s))
        inverse, (_, log_det) = np.linalg.inv(s), np.linalg.slogdet(s)
        density.append(lambda v, m=p.mean(0), a=inverse, d=log_det, n=len(p): math.log(n / len(rows)) - 0.5 * d - 0.5 * (v - m) @ a @ (v - m))
    for i, score in got:
        d = density[0](x[i]) - density[1](x[i])
        assert math.isclose(score, 1 / (1 + math.exp(min(max(d, -500), 500))), rel_tol=1e-5, abs_tol=1e-9)
    # equal texts have equal scores
    by_text = defaultdict(set)
    for i, t, _ in texts:
        by_text[t] |= {round(s, 12) for j, s in got if j == i}
    assert all(len(v) == 1 for v in by_text.values())


def test_lm(docs, texts, empty):
    token = lambda t: [*t.encode().lower().split(), b"\n"]
    train = [token(t) for i, t, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    got = lm.scored(docs).collect()
    texts_by = {i: t for i, t, _ in texts}
    assert len(got) == len(texts)
    for r in got:
        w = token(texts_by[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.scored(empty).count() == 0


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    pairs = rng.poisson(np.exp(rng.normal(0, 1, (30, 30)))).astype(float)
    m = lm.LogBilinear(pairs, dim=8, steps=400)
    s1, s2, whole = (x.astype(float) for x in m.tables())
    p = 10.0 ** (s1[:, None, :] + s2[None, :, :] - whole[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    unigram = np.log10(pairs.sum(0) / pairs.sum())
    assert (pairs * np.log10(p[:, 0])).sum() > (pairs * unigram).sum()
    # tokens that follow the word before last: noise-contrastive steps learn that from drawn noise
    seq = [0, 1]
    for x, u in zip(rng.integers(0, 30, 20_000).tolist(), rng.random(20_000).tolist(), strict=True):
        seq.append((seq[-2] + 1) % 30 if u < 0.7 else x)
    w = np.array(seq)
    h1, h2 = np.concatenate([[0], w[:-1]]), np.concatenate([[0, 0], w[:-2]])
    table = np.bincount(h1 * 30 + w, minlength=900).reshape(30, 30).astype(float)
    m = lm.LogBilinear(table, dim=16, steps=100)

    def held(m):
        s1, s2, whole = m.tables()
        return float((s1[h1, w] + s2[h2, w] - whole[h1, h2]).mean())

    before = held(m)
    squares = [np.full(x.shape, 1e-3) for x in (m.e, m.c1, m.c2, m.b)]
    for _ in range(20):
        m.refine(h2, h1, w, rng, squares)
    assert held(m) > before + 0.2


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    """Shares, their order and the draws follow from the documents: also with several shares, repeated rows and nulls."""
    monkeypatch.setattr(lm, "SHARE_TOKENS", 20_000)
    monkeypatch.setattr(lm, "SHARE_ROWS", 30)
    d = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(EXTRA, SCHEMA))
    runs = []
    for n in (1, 3, 8):
        runs.append({(r.doc_id, r.n_tokens): r.score for r in lm.scored(d.repartition(n, F.rand(n))).collect()})
    for other in runs[1:]:
        assert set(other) == set(runs[0]) and all(math.isclose(other[k], x, rel_tol=1e-6, abs_tol=1e-6) for k, x in runs[0].items())


@pytest.mark.parametrize("most", [1_800, 4])
def test_lm_score_equals_brute_force(spark, monkeypatch, most):
    """Every token's probability by the formula, over all symbols, and its share of its class; also where few words may be symbols."""
    monkeypatch.setattr(lm, "MOST_WORDS", most)
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % (5 + i % 9)}" for j in range(60)) + (" rare%d" % i if i % 3 else ""), "en", "s", 0) for i in range(40)] + [(50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "unseen words only", "en", "s", 0)]
    t = lm.train(spark.createDataFrame(rows, SCHEMA))
    c = {bytes(r.word): r.c for r in t.counts.collect()}
    k, m = t.words, t.model
    able = sorted((w for w, n in c.items() if n >= lm.LEAST_COUNT and w != lm.END), key=lambda w: (-c[w], w))
    assert set(able[:most]) == {w for w, i in k.place.items() if 0 < i <= k.n_words} and 0 < k.n_words < len(c) and (most > 4 or len(able) > 4)
    symbol = lambda w: 0 if w == lm.END else k.place[w] if 0 < k.place.get(w, -1) <= k.n_words else k.word_class(w)
    mass, kinds = Counter(), Counter()
    for w, n in c.items():
        mass[symbol(w)] += n
        kinds[symbol(w)] += 1
    texts = {r[0]: r[1] or "" for r in rows}
    for r in lm.scores(t).collect():
        h1 = h2 = 0
        want = 0.0
        for w in [*lm.tokens(texts[r.doc_id]), lm.END]:
            s = [float((m.e[h1] @ m.c1 + m.e[h2] @ m.c2) @ m.e[x] + m.b[x]) for x in range(k.n_symbols)]
            at = symbol(w)
            want += (s[at] - math.log(sum(map(math.exp, s)))) / math.log(10)
            if at > k.n_words:
                want += math.log10((c.get(w, 0) + 1) / (mass[at] + kinds[at] + 1))
            h1, h2 = at, h1
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-4)


def test_lm_rare_words_reach_their_documents(docs, texts, monkeypatch):
    whole = {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.scored(docs).collect()}
    monkeypatch.setattr(lm, "HEAD", 50)
    assert whole == {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.scored(docs).collect()}


def test_licenses(docs, texts, empty):
    want = []
    for i, t, _ in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        starts, labels = [], set()
        for p, label in licenses.PHRASES.items():
            p = p.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    got = licenses.scanned(docs).collect()
    assert as_bag(r[:6] for r in got) == as_bag(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scanned(empty).count() == 0


@pytest.mark.parametrize("text,label", [("Licenced under the Apach Licence, Version 2", "apache"), ("GNU Generl Publik License", "gpl"), ("redistribution and use in sorce and binary forms", "bsd"), ("Mozila Public License", "mpl"), ("a public licence of the house", "")])
def test_fuzzy_notices(text, label):
    assert licenses.Searcher().scan(text)[5] == label


@pytest.mark.parametrize("text,labels", [
    ("the general public license of the town", ""), ("a general public license", ""), ("new general public license", ""), ("released under the kit license", ""),
    ("licensed under the apple license version", ""), ("gnu lesser general public license", "lgpl"), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd"),
    ("creative commons attribution share alike", "cc-by-sa"), ("Creative Commons Attribution 4.0", "cc-by"), ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("licensed under cc by sa", "cc-by,cc-by-sa"),
])
def test_words_that_name_a_license(text, labels):
    assert licenses.Searcher().scan(text)[5] == labels


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_matches(text, notice, k):
    """{(start, end): least edits} of all stretches of whole words, each key of the notice aligned to a whole word."""
    words = notice.split()
    keys = [i for i, w in enumerate(words) if w in licenses.KEYS]

    def parts(i):
        """Notice text between keys i - 1 and i."""
        lo = keys[i - 1] + 1 if i else 0
        hi = keys[i] if i < len(keys) else len(words)
        t = " ".join(words[lo:hi])
        return (" " + t if lo and t else t) + (" " if i < len(keys) and (keys[i] > 0) else "")

    starts = [m.start() for m in re.finditer(r"(?<![^ ])[^ ]", text)]
    ends = [m.end() for m in re.finditer(r"[^ ](?![^ ])", text)]
    best = {}

    def walk(i, at, used, begin):
        if used > k:
            return
        if i == len(keys):
            for e in ends:
                if e >= at and e > begin and abs(e - at - len(parts(i))) <= k and used + (d := distance(text[at:e], parts(i))) <= k:
                    best[begin, e] = min(used + d, best.get((begin, e), k))
            return
        key = words[keys[i]]
        for a, e in zip(starts, ends):
            if a >= at and abs(a - at - len(parts(i))) <= k and (w := distance(text[a:e], key)) <= (len(key) >= licenses.EDITED_KEY):
                walk(i + 1, e, used + w + distance(text[at:a], parts(i)), begin)

    for a in starts:
        walk(0, a, 0, a)
    return best


def brute_edits(text, notice, k):
    return min(brute_matches(text, notice, k).values(), default=None)


def brute_spans(text, notice, k):
    """Matches of fewest edits, then the first, then the longest, as long as they don't overlap."""
    out = []
    for e, a, b in sorted((e, a, -b) for (a, b), e in brute_matches(text, notice, k).items()):
        if all(-b <= x or a >= y for x, y, _ in out):
            out.append((a, -b, e))
    return sorted(out)


def test_fuzzy_search_equals_brute_force():
    rng = np.random.default_rng(7)
    s = licenses.Searcher()
    notices = list(licenses.NOTICES)
    for _ in range(120):
        notice = list(notices[rng.integers(len(notices))])
        for _ in range(rng.integers(0, 5)):
            k = rng.integers(len(notice))
            notice[k : k + 1] = [[], ["q"], [notice[k], "z"]][rng.integers(3)]
        text = " ".join(["some", "".join(notice).strip(), "and"])
        found = {}
        for label, a, b, e in s.fuzzy(licenses.normal(text)):
            found[label] = min(e, found.get(label, 9))
        want = {}
        plain = licenses.normal(text).decode().strip()
        for n, label in licenses.NOTICES.items():
            e = brute_edits(plain, n, licenses.FEW_EDITS.get(n, licenses.EDITS))
            if e is not None:
                want[label] = min(e, want.get(label, 9))
        assert found == want, text


def test_several_damaged_notices_give_all_spans():
    rng = np.random.default_rng(11)
    s = licenses.Searcher()
    notices = list(licenses.NOTICES)
    for _ in range(60):
        some = [notices[i] for i in rng.integers(len(notices), size=2)]
        pieces = []
        for _ in range(rng.integers(2, 5)):
            notice = list(some[rng.integers(2)])
            for _ in range(rng.integers(0, 4)):
                k = rng.integers(len(notice))
                notice[k : k + 1] = [[], ["q"], [notice[k], "z"], [" "]][rng.integers(4)]
            pieces.append("".join(notice).strip())
        text = ["", " and ", " "][rng.integers(1, 3)].join(pieces)
        joined = licenses.normal(text)
        got = sorted((a, b, e) for label, a, b, e in s.fuzzy(joined))
        plain = joined.decode()
        want = sorted(x for n in licenses.NOTICES for x in brute_spans(plain, n, licenses.FEW_EDITS.get(n, licenses.EDITS)))
        assert got == want, text


@pytest.mark.parametrize("text", ["mozila public license mozilla public license", "released under the mit licence and released under the mit license", "mozilla public license mozilla public license mozila public license"])
def test_notices_next_to_each_other_all_count(text):
    told = licenses.Searcher().scan(text)[-1]
    assert len(told) == text.count("public") + text.count("released") and [t[1] for t in told] == sorted(t[1] for t in told)


def test_all_conditions_of_a_notice_count():
    labels = licenses.Searcher().scan("Creative Commons Attribution " + "non commercial " * 40 + "share alike, nd rules")[5]
    assert labels == "cc-by-nc-nd-sa"
    assert licenses.Searcher().scan("Creative Commons Attribution ncx share alike")[5] == "cc-by"


def test_licenses_of_long_texts():
    row = licenses.Searcher().scan("word " * 400_000 + "GNU General Public License" + " word" * 10)
    assert row[:6] == (400_014, 1, 400_000, 400_000, "gpl", "gpl")


def test_seeds_lose_no_match():
    """Whatever the edits, the windows hold every match that a search of the whole text finds."""
    rng = np.random.default_rng(2)
    s = licenses.Searcher()
    for _ in range(150):
        notice = list(list(licenses.NOTICES)[rng.integers(len(licenses.NOTICES))])
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(len(notice))
            notice[k : k + 1] = [[], ["q"], [notice[k], "z"]][rng.integers(3)]
        t = licenses.normal("some words before " + "".join(notice) + " and after")
        windowed = {x[0] for x in s.fuzzy(t)}
        assert windowed == {label for label, _, k, _, pattern in s.notices if any(sum(m.fuzzy_counts) <= k for m in pattern.finditer(t))}


def brute_areas(pixels, rows, columns):
    """Area averages, weight by weight."""

    def weights(n, k):
        w = np.zeros((k, n))
        for i in range(k):
            lo, hi = n * i / k, n * (i + 1) / k
            for j in range(int(lo), min(n, math.ceil(hi))):
                w[i, j] = max(0.0, min(hi, j + 1) - max(lo, j))
        return w / w.sum(1, keepdims=True)

    return np.einsum("ih,jw,hwc->ijc", weights(pixels.shape[0], rows), weights(pixels.shape[1], columns), pixels, optimize=True)


def test_media(docs, texts, empty):
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    for i, t, _ in texts:
        b = t.encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        n, stored = media.text_image(t)
        pixels = np.frombuffer(p, np.uint8).reshape(-1, 64, 3).astype(float)
        small = brute_areas(pixels, 16, 16)
        tile = np.load(io.BytesIO(r.npy))
        assert tile.shape == (16, 16, 3) and np.abs(tile - small).max() <= 0.5 + 1e-6
        grey = np.round(brute_areas(pixels.mean(2, keepdims=True), 8, 9)[:, :, 0], 6)
        bits = "".join("01"[int(a < b)] for row in grey for a, b in zip(row, row[1:]))
        assert r.feature == f"{int(bits, 2):016x}:{hashlib.sha256(r.npy).hexdigest()[:16]}"
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest() and media.image_text(stored, n) == t
    assert media.digests(empty).count() == 0


def test_images():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (37, 21, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()
    assert (media.decode(b"P5 # note\n3 2 255\n" + bytes(range(6)))[:, :, 0] == np.arange(6).reshape(2, 3)).all()
    assert np.allclose(media.resize(np.kron(a, np.ones((4, 5, 1), np.uint8)), 37, 21), a)
    assert np.isclose(media.resize(a, 8, 9).mean(), a.mean())
    tall = rng.integers(0, 256, (9000, 4, 3), dtype=np.uint8)
    assert np.isclose(media.resize(tall, 16, 16).mean(), tall.mean())
    for bad in (b"", b"GIF89a", b"P6\nx"):
        with pytest.raises((ValueError, KeyError)):
            media.decode(bad)


def test_tiles(spark):
    a = np.arange(8 * 8 * 3, dtype=np.uint8).reshape(8, 8, 3)
    rows = media.tiles(spark.createDataFrame([(1, bytearray(media.encode_ppm(a))), (2, bytearray(b"no")), (3, None)], "doc_id long, media binary"), side=4).collect()
    import io

    assert np.load(io.BytesIO(rows[0].npy)).shape == (4, 4, 3) and len(rows[0].dhash) == 16 and rows[1].npy is None and rows[2].dhash is None


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)


def test_sentencepiece_equals_the_library(docs, texts, empty, library):
    got = {r.doc_id: r for r in spm.encoded(docs).collect()}
    for i, t, _ in texts:
        assert got[i].ids == library.encode(t) and got[i].round_trip and got[i].n_tokens == len(got[i].ids)
    assert spm.encoded(empty).count() == 0
    back = {r.doc_id: r.text for r in spm.decoded(spm.encoded(docs)).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t, _ in texts)


def test_sentencepiece_on_random_texts(library):
    rng = np.random.default_rng(4)
    parts = ["a", "b", "e", "t", "h", "▁", " ", "  ", "\n", "é", "日", "本", "😀", "\x00", "\t", "in", "g", "aa", "the", "1", ".", ",", "..", "x." * 3, "ababab", "==", "--"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)] + ["=" * n for n in range(70)] + [" " * n for n in range(70)] + ["q" * 3000]
    enc = spm.Encoder(spm.Vocabulary.load())
    out = enc.encode(texts)
    assert [x.tolist() for x in out] == library.encode(texts)
    assert [enc.decode(x) for x in out] == library.decode(library.encode(texts))


def test_unigram_relaxing_finds_the_best_path():
    v = spm.Vocabulary(["<unk>", "▁a", "b", "ab", "▁", "a", "▁ab"], [0.0, -1.0, -2.0, -2.5, -1.0, -1.5, -4.0], [], [1, 2, 3, 4, 5, 6], 0, bpe=False)
    assert [v.pieces[i] for i in spm.Encoder(v).encode(["ab"])[0]] == ["▁a", "b"]


def page_text(page):
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", m.group(1))]
    return "\n\n".join(b for b in blocks if b)


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = [(900001, None, None), (900002, "", ""), (900003, "http://x.y/a", '<div>hi &amp; <b>bo</b>ld<br>x<p>A &nbsp; b</div><div class="comments">no</div><form>f</form><article'), (900004, "http://x.y/b", '<body><div id=main><p>One two three<p>Four <script>if(a<b){"</p>"}</script>five</div><div class="sidebar">s</div>')]
    d = pages.unionByName(spark.createDataFrame(more, "page_id long, url string, html string")).withColumn("text", F.lit(1)).withColumn("template", F.lit(2))
    got = {r.page_id: r for r in html.extracted(d).collect()}
    want = {r.page_id: page_text(r.html) for r in pages.collect()}
    assert all(got[i].text == t and got[i].n_chars == len(t) for i, t in want.items())
    assert [got[i].text for i in (900001, 900002, 900003, 900004)] == ["", "", "hi & bold x\n\nA b", "One two three\n\nFour five"]
    assert html.extracted(d.limit(0)).count() == 0


@pytest.mark.parametrize("page,text", [
    ('<article><p title="5" tall">one</p><p>two</article>', "one\n\ntwo"),
    ('<article><p title="a > b">one</p><p class=\'x\'>two &lt;p&gt; &#233;</article>', "one\n\ntwo <p> é"),
    ("<article><p>1 < 2 <b>and</b> 3 > 2<!-- gone --></p><![CDATA[kept]]></article>", "1 < 2 and 3 > 2\n\nkept"),
    ("<article><p>one<nav>menu</nav><div id=cookie-notice>x</div><p>two<style>p{}</style></article><p>after", "one\n\ntwo"),
    ("<main><p>one</main><aside>side</aside><p hidden>no", "one"),
])
def test_odd_pages(page, text):
    assert html.main_text(page, None) == text


def test_html_template_without_semantic_tags(spark):
    """Menus and footers without telling names are found as the text that every page of the host repeats."""
    page = "<div class=c0><div class=c1>Home News About</div><div class=c2><h2>{t}</h2><p>{a}</p><p>{b}</p></div><div class=c3>All rights kept</div></div>"
    rows = [(i, f"http://h.org/{i}", page.format(t=f"Title {i}", a=f"First words of page {i} " * 5, b=f"And more of {i} " * 9)) for i in range(12)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Home" not in t and "rights" not in t and t.startswith(f"Title {i}\n\nFirst") and t.endswith(f"more of {i}") for i, t in got.items())


def extracted_texts(spark, pages):
    rows = [(i, f"http://h.org/{i}", page) for i, page in enumerate(pages)]
    return [r.text for r in sorted(html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


@pytest.mark.parametrize("page", [
    "<div class=c0><ul class=u><li>{a}</li><li>{b}<ol class=sub><li class=s>Deep item</li></ol></li></ul><div class=c3>All rights kept</div></div>",
    "<div class='w-1/2 c0'><div class=c2><p>{a}</p><p>{b}</p><div class=c3>All rights kept</div></div></div>",
])
def test_html_template_of_repeated_parents_and_slashes(spark, page):
    """An element that each page has once may stand below a repeated one, and class values may hold a slash."""
    got = extracted_texts(spark, [page.format(a=f"First words of page {i} " * 5, b=f"And more of {i} " * 9) for i in range(8)])
    assert all(t.startswith("First words") and f"more of {i}" in t and "rights" not in t and "Deep" not in t for i, t in enumerate(got))


COPY = "<html><body><div class=c0>Home News</div><article><h1>One title</h1><p>The only words of this article.</p></article></body></html>"


def test_html_copies_keep_their_article(spark):
    """Copies of a page, by address or as repeated rows, and pages that differ in a tag only are no template."""
    want = "One title\n\nThe only words of this article."
    assert extracted_texts(spark, [COPY] * 7) == [want] * 7
    assert extracted_texts(spark, [COPY.replace("<h1>", f"<h1 data-n={i}>") for i in range(7)]) == [want] * 7
    rows = [(1, "http://h.org/1", COPY)] * 7
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.text for r in html.extracted(df).collect()] == [want] * 7 and html.distinct_pages(df).count() == 1
    # three copies among other pages: repeated rows don't make up the support
    assert html.distinct_pages(spark.createDataFrame(rows + [(2, "http://h.org/2", COPY), (3, "http://g.org/", COPY), (4, None, None), (4, None, None)], df.schema)).count() == 3


def test_html_article_text_equal_to_a_menu_stays(spark):
    page = "<div class=c1>All rights</div><div class=c2><p>{a}</p><p>All rights</p><p>{a} again</p></div>"
    got = extracted_texts(spark, [page.format(a=f"Words of page {i} " * 9) if i else page.format(a="Page 0 " * 9).replace("<p>All rights</p>", "<h2>All rights</h2>") for i in range(8)])
    assert got[0].count("All rights") == 1 and got[0].startswith("Page 0")


@pytest.mark.parametrize("page", [
    "<div class=c1>Home News</div><article><h1>Title {i}</h1><div class=lead>Lead of {i}.</div><div class=content><p>{a}</p><p>{a} again</p></div></article>",
    "<div class=c1>Home News</div><div class=c2><h1>Title {i}</h1><div class=lead>Lead of {i}.</div><div class=content><p>{a}</p><p>{a} again</p></div></div>",
    "<div class=c1>Home News</div><div class=c2 id=post-{i}><h1>Title {i}</h1><p>Lead of {i}.</p><div class=content><p>{a}</p><p>{a} again</p></div></div>",
])
def test_html_title_and_lead_stay(spark, page):
    """What stands beside the element with most of the prose is the article's too."""
    got = extracted_texts(spark, [page.format(i=i, a=f"Words of page {i} " * 20) for i in range(8)])
    assert all(t.startswith(f"Title {i}\n\nLead of {i}.\n\nWords of page {i}") and t.endswith("again") for i, t in enumerate(got))


def test_html_second_layout_with_a_teaser(spark):
    one = "<div class=c1>Home News</div><article><h1>Title {i}</h1><p>{a}</p></article>"
    two = "<div class=c1>Home News</div><article><p>Teaser {i}</p></article><div class=c9><h1>Title {i}</h1><p>{a}</p></div>"
    got = extracted_texts(spark, [(two if i > 7 else one).format(i=i, a=f"Words of page {i} " * 20) for i in range(10)])
    assert all(f"Title {i}\n\nWords of page {i} " in t and "Home" not in t for i, t in enumerate(got))


@pytest.mark.parametrize("page,text", [
    ("<article><p>one<svg class=i /></p><p>two<math/> three</article>", "one\n\ntwo three"),
    ("<article><svg viewBox='0 0 1 1'/><p>one</p><svg><title>no</title></svg><p>two</article>", "one\n\ntwo"),
    ("<article><object data=x/><video src=x/><p>one</p><video src=y></video><p>two</article>", "one\n\ntwo"),
    *[(f"<article><p>one</p><{tag} class=x><p>two</p><p>three</article>", "one\n\ntwo\n\nthree") for tag in "svg math object canvas audio video iframe noscript template".split()],
    ("<article><p>one</p><script>let a = '<p>no</p>'", "one"),
])
def test_unclosed_and_self_closed_elements(page, text):
    assert html.main_text(page, None) == text


@pytest.mark.parametrize("text,want", [
    ("iban DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89 3704 0044 0532 0130 00 12 EUR", ["DE89 3704 0044 0532 0130 00"]),
    ("Yes, DE89370400440532013000 I said", ["DE89370400440532013000"]),
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
    ("\U0001f600 AB12 DE89 3704 0044 0532 0130 00.", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89370400440532013000", ["DE89370400440532013000"]),
    ("MT84MALT011000012345MTLCAST001S", ["MT84MALT011000012345MTLCAST001S"]),
    ("DE89 3704 0044 0532 0130 01 EUR and DE89370400440532013000x", []),
    (None, []),
])
def test_iban_among_capitals(spark, text, want):
    """Words in capitals or numbers next to an iban neither hide it nor belong to it."""
    df = spark.createDataFrame([(1, text, len(text or ""))], "doc_id long, text string, n_chars int")
    row = pii.spans(df).first()
    assert [text[x.s : x.e] for x in row._iban] == want
    clean = pii.redacted(df).first().text
    left = text
    for x in want:
        left = left.replace(x, "[IBAN]")
    assert clean == left


ARTICLE = "<article><p>Hello there my friends</p></article>"


@pytest.mark.parametrize("page,text", [
    (f'<body class="has-sidebar single">{ARTICLE}', "Hello there my friends"), (f'<body class="home search-results">{ARTICLE}', "Hello there my friends"),
    ('<article class="long-form"><p>x y</p></article>', "x y"), ('<form id="aspnetForm"><div><h1>T</h1><p>Body text of it</p></div></form>', "T\n\nBody text of it"),
    ('<article><p class="intro share">Lead</p><p>two</p></article>', "Lead\n\ntwo"), ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
    ('<article><p>one</p><div class="site-footer">f</div><p class="share">s</p><form>Mail <input></form><article class="comment">c</article></article>', "one"),
    ('<article><p>one words</p><form class="search"><p>Search all of this site for anything at all</p></form>', "one words"),
    ("<article><p>Same.</p><p>Same.</p><p>Same.</p></article>", "Same.\n\nSame.\n\nSame."),
])
def test_classes_and_forms_that_hold_the_article(page, text):
    assert html.main_text(page, None) == text


@pytest.mark.parametrize("page,text", [
    ("<section aria-label='A hidden gem'>article</section>", "article"), ("<p title='hidden treasures of the town'>para</p>", "para"), ("<div data-id='nav'>text</div>", "text"),
    ("<article data-role='navigation'>text</article>", "text"), ("<div data-class='nav' data-hidden title=class=nav>text</div>", "text"),
    *[(f"<{tag}>Some words here.</{tag.split()[0]}>", "Some words here.") for tag in ("article class='share'", "div class='content form'", "div class='widget'", "div class='story search'", "div class='ad'", "div class=comments")],
    ("<article class='banner'><p>One of it</p></article><article><p>A longer one is here, with more words</p></article>", "One of it\n\nA longer one is here, with more words"),
    ("<article>a <span hidden>secret</span> b <span class='advert'>x <span>y</span> z</span> c <ins class='adsbygoogle'>y</ins> d <b style='display: none'>e</b></article>", "a b c d"),
    ("<article><p>a <span hidden>open</p><p>b</p></article>", "a\n\nb"), ("<article><p>x <span class='comment'>// code</span></p></article>", "x // code"),
    ("<p class=a class=ads>first</p>", "first"), ("<div HIDDEN>no</div><div Class='Ad-Slot'>no</div><p>yes of course</p>", "yes of course"), ('<p title="5" tall" hidden="">no</p><p>yes', "yes"),
    *[(f"<article><p>words of it</p><div {k}='{c}'>noise</div></article>", "words of it") for k in ("class", "id") for c in "post-comments comment-body commentlist disqus_thread ad-slot google-ads cookie-law-info-bar related-articles".split()],
    *[(f"<article><p>words of it</p><div class='{c}'>more</div></article>", "words of it\n\nmore") for c in "comments-open has-comments no-sidebar category-cookies adhoc shared-values navigate".split()],
    ("<div class=post><p>Short.</p></div><div id=comments>" + "<p>A long comment by a reader.</p>" * 9 + "</div>", "Short."),
    ("<div class=menu>" + "<a href=x>A link of many words</a> " * 9 + "</div><p>Short one.</p>", "Short one."),
])
def test_attributes_and_names_neither_lose_articles_nor_keep_furniture(page, text):
    assert html.main_text(page, None) == text


def test_html_repeated_text_of_the_article_stays(spark):
    """Headings and closing words that all pages have are the article's, in an article; between slots elsewhere."""
    one = "<div class=c1>Home News</div><article><h1>Title {i}</h1><h2>Intro</h2><p>{a}</p><p>Thanks for reading.</p></article>"
    got = extracted_texts(spark, [one.format(i=i, a=f"Words of page {i} " * 9) for i in range(7)])
    assert all(t.startswith(f"Title {i}\n\nIntro\n\nWords") and t.endswith("Thanks for reading.") for i, t in enumerate(got))
    two = "<div class=c1>Home News</div><div class=c2><h1>Title {i}</h1><h2>Intro</h2><p>{a}</p></div>"
    got = extracted_texts(spark, [two.format(i=i, a=f"Words of page {i} " * 9) for i in range(7)])
    assert all(t.startswith(f"Title {i}\n\nIntro\n\nWords") and "Home" not in t for i, t in enumerate(got))


def test_html_texts_of_optional_and_repeated_classes_go(spark):
    """Text that most pages have with its element, once or repeated, is the template's too; in an element of many texts it is content."""
    page = "<div class=c1>Home News</div><div class=c2>{x}<h1>Title {i}</h1><p>{a}</p>{y}</div>"
    notice, again = "<div class=x1><div class=x2>We store small files</div></div>", "<div class=r><div class=s>Read on</div></div>"
    got = extracted_texts(spark, [page.format(x=notice * (i < 6), i=i, a=f"Words of page {i} " * 9, y=again * (i % 3 + 1)) for i in range(10)])
    assert got == [f"Title {i}\n\n" + " ".join([f"Words of page {i}"] * 9) for i in range(10)]
    near = "<p>One of the copies</p><p>Second of them</p><p>Third of them</p>"
    got = extracted_texts(spark, [page.format(x="", i=i, a=f"Words of page {i} " * 9, y=near * (i < 6)) for i in range(10)])
    assert all(("Third of them" in t) == (i < 6) for i, t in enumerate(got))


def test_html_classes_are_ordered_and_nested_on_all_pages(spark):
    page = "<div class=c2>{x}<h1>Title {i}</h1>{y}<p>{a}</p><h2>At last</h2><p>{a}</p>{z}</div>"
    words = [" ".join([f"Words of page {i}"] * 9) for i in range(12)]
    texts = lambda at, text: extracted_texts(spark, [page.format(i=i, a=words[i], **{k: text if at(i) == k else "" for k in "xyz"}) for i in range(12)])
    want = [f"Title {i}\n\n{words[i]}\n\nAt last\n\n{words[i]}" for i in range(12)]
    # a text that every page has, at one of two places: both are the template's, but not a place that only one page has
    assert texts(lambda i: "xz"[i % 2], "<p>Kept in two places</p>") == want
    got = texts(lambda i: "zx"[i == 3], "<p>Kept in two places</p>")
    assert got[3] == "Kept in two places\n\n" + want[3] and got[:3] + got[4:] == want[:3] + want[4:]
    # with an element of its own it is the template's anywhere
    assert texts(lambda i: "zx"[i == 3], "<div class=v>On all pages</div>") == want
    # a class that stands at several places of the root's is not nested in it
    quote = "<div class=q><div class=w>Said before</div></div>"
    assert texts(lambda i: "z" if i < 9 else "", quote) == want
    got = texts(lambda i: ("x" if i < 5 else "z") if i < 9 else "", quote)
    assert all(("Said before" in t) == (i < 9) for i, t in enumerate(got))


def test_html_order_and_nesting_against_all_pairs():
    """What is left of classes is in order on every page, as much as can be; places of classes in each other against their spans."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        classes = [[1, 2, 3, 4, -1], [11, 12, 13], [21, -21, 22]]
        known = html._Numbered(classes)
        ids = [0, *rng.permutation([1, 2, 3]), 4] + [5, 6, 7] * int(rng.integers(0, 3))
        ids = tuple(int(i) for i in ids)
        wrong = html._disordered(ids, known)
        left = [i for i in ids[:5] if i not in wrong]
        best = max(bin(m).count("1") for m in range(32) if (x := [i for k, i in enumerate(ids[:5]) if m >> k & 1]) == sorted(x))
        assert left == sorted(left) and len(left) == best and not wrong & {5, 6, 7}
        # occurrences of three classes, dealt to one another at random
        parts = [[0, 1, 2, 3, 4]] + [[5, 6, 7]] * int(rng.integers(1, 3)) + [[8, 9, 10]]
        spots = [sorted(rng.choice(1000, len(p), replace=False)) for p in parts]
        if len(parts) == 4 and spots[1][-1] >= spots[2][0]:
            continue
        page = sorted((int(s), i, o) for o, (p, at) in enumerate(zip(parts, spots)) for s, i in zip(at, p))
        pairs = {}
        for inner, outer, lo, hi in html._nesting([i for _, i, _ in page], known):
            x = pairs.get((inner, outer), (lo, hi, 0))
            pairs[inner, outer] = min(x[0], lo), max(x[1], hi), x[2] + 1
        order, owner = [o for _, _, o in page], [known.owner[p[0]] for p in parts]
        before = lambda o, x: {order[:k].count(x) for k, y in enumerate(order) if y == o}

        def place(o, x):
            """The tokens of x before o, if o stands inside x; None if it does not, -1 if both overlap in part."""
            n = before(o, x)
            if len(n) > 1:
                return -1 if len(before(x, o)) > 1 else None
            return n.pop() if n <= set(range(1, len(parts[x]))) else None

        def apart(c, d):
            places = [[p for x in range(len(parts)) if owner[x] == d and (p := place(o, x)) is not None] for o in range(len(parts)) if owner[o] == c]
            return all(-1 not in p for p in places) and len(set(map(tuple, places))) == 1

        valid = [0]
        for c in (1, 2):
            if all(apart(c, d) and apart(d, c) for d in valid):
                valid.append(c)
        assert html._nested(3, pairs) == valid


def test_html_long_class_values_are_told_apart(spark):
    long = "k" * 70
    page = "<div class='" + long + "1'><p>Menu of page {i} and more</p></div><div class='" + long + "2'><article><p>{a}</p></article></div>"
    got = extracted_texts(spark, [page.format(i=i, a=f"Words of page {i} " * 9) for i in range(7)])
    assert all(t.startswith(f"Words of page {i}") and "Menu" not in t for i, t in enumerate(got))


def test_html_hosts_beyond_a_broadcast(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, html.extracted(pages).collect()))
    monkeypatch.setattr(html, "MAX_BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, html.extracted(pages).collect())) == want


def test_joins_deal_hot_keys_to_parts(spark, monkeypatch):
    """A key with a third of all rows, and the null key, in an inner and a left join."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    many = common.written(spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 500)).alias("key")))
    few = spark.createDataFrame([("hot", 1), (None, 2), ("k7", 3), ("none", 4)], "key string, v int")
    hot = common.hot_keys(many.groupBy("key").count(), many.count())
    assert {r.key: r._parts for r in hot.collect()} == {"hot": 20, None: 20}
    values = {r.key: r.v for r in few.collect()}
    rows = [(r.id, r.key, values.get(r.key)) for r in many.collect()]
    joined = common.spread_join(many, few, ["key"], ["id"], hot, "left")
    assert joined.columns == ["id", "key", "v"] and as_bag(joined.collect()) == as_bag(rows)
    assert as_bag(common.spread_join(many, few, ["key"], ["id"], hot).collect()) == as_bag(r for r in rows if r[2])


def test_operators_with_hot_keys_and_beyond_broadcasts(docs, spark, monkeypatch):
    bad = spark.createDataFrame([(r.source, r.source is None or i % 2 == 0) for i, r in enumerate(docs.select("source").distinct().collect())], "source string, host_rejected boolean")
    counted = host_rules.written(host_rules.rule_counts(docs.select("doc_id", "text", "source")).drop("text"))
    operators = [
        lambda: mixing.mix(docs), lambda: neardup.near_duplicates(docs),
        lambda: host_rules.judged(counted, bad, most), lambda: neardup.near_duplicates(docs, shingle=5),
    ]
    most = 100
    want = [as_bag(f().collect()) for f in operators]
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_PARTS", 10**9)
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    most = 0
    assert [as_bag(f().collect()) for f in operators] == want


def test_a_large_group_of_near_copies_stays_linear(spark):
    """Copies of which every third is too far from most others: rows out of the join on differences grow with the group."""
    made = []
    for n in (300, 1200):
        rng = np.random.default_rng(n)
        rows = []
        for k in range(n):
            w = [f"w{i}" for i in range(150)]
            for j in rng.choice(150, size=12 if k % 3 == 0 else rng.integers(0, 3), replace=False):
                w[j] = f"e{rng.integers(10**9)}"
            rows.append((k, " ".join(w), "en", "s", 0))
        d = spark.createDataFrame(rows, SCHEMA)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()}
        assert got == brute_components([(i, shingles(t)) for i, t, *_ in rows]) if n == 300 else len(got) == n
        ids = d.select(F.col("doc_id").alias("id"))
        sets = neardup.sets_of(d, neardup.written(ids))
        t = neardup.mapped(d.select("doc_id", "text"), neardup.partial(neardup._sketch_batches, shingle=2, bands=64), neardup.SKETCH_SCHEMA)
        shared = t.select("doc_id", F.explode("bands").alias("key")).withColumn("degree", F.lit(1).cast("long"))
        comps = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(1).alias("component"))
        _, pairs = neardup._between_components(neardup.written(shared), sets, comps, 80)
        made.append(pairs.count())
    assert made[1] <= 8 * made[0] + 400


def test_documents_that_share_many_differences(spark):
    """Pages filled in from one list: each replaces a part of the same places by the same words, and few pairs are close enough."""
    rng, rows = np.random.default_rng(3), []
    base = [f"w{i}" for i in range(200)]
    for k in range(120):
        w = list(base)
        for j in rng.choice(40, size=14, replace=False):
            w[3 * j] = f"e{j}"
        rows.append((k, " ".join(w), "en", "s", 0))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_components([(i, shingles(t)) for i, t, *_ in rows])
    assert got == want and 1 < len(set(want.values())) < 120


def test_rows_of_one_id_with_different_texts_count_once(spark):
    """The first text in order tells the document's links; a rerun on other partitions agrees."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "s", 0), (2, base + " x", "en", "s", 0), (2, "another text " + base[:150], "en", "s", 0), (3, base + " y", "en", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(d.repartition(n)).collect()) for n in (1, 4)]
    assert runs[0] == runs[1] and {c for i, _, c in runs[0] if i != 2} == {1}


def test_neardup_shingle_size_and_percent(spark):
    base = [f"w{i}" for i in range(60)]
    other = [*base]
    for j in (10, 30, 50):
        other[j] = f"x{j}"
    d = spark.createDataFrame([(1, " ".join(base), "en", "s", 0), (2, " ".join(other), "en", "s", 0)], SCHEMA)
    linked = lambda **how: neardup.near_duplicates(d, **how).select("component_id").distinct().count() == 1
    assert neardup.bands_for(80) == 64 and neardup.bands_for(90) == 64 and neardup.bands_for(50) == 256
    # 53 of 65 word pairs are common; of 71 five-word shingles 41
    assert linked() and not linked(shingle=5) and linked(shingle=5, percent=50) and not linked(percent=85)
