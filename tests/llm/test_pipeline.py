"""The pipeline against a brute-force version of its stages."""

import math
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from cityportrait.llm import mixing, spm
from tests.llm.test_operators import base_spans, brute_components, brute_kept, brute_taken, brute_targets, shingles, words

SF = "/root/testdata/sf0.001"


def redact(t):
    from cityportrait.llm import pii

    spans = sorted((a, b, k) for k, a, b in base_spans(t))
    out, at = [], 0
    merged = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
        else:
            merged.append((a, b, k))
    for a, b, k in merged:
        out += [t[at:a], f"[{k.upper()}]"]
        at = b
    assert pii.BASE
    return "".join(out) + t[at:]


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.source) for r in d.collect()]
    rows, _ = brute_kept(rows)
    heads = brute_components([(i, shingles(t, corpus_pipeline.SHINGLE)) for i, t, _ in rows])
    rows = [(i, redact(t), s) for i, t, s in rows if heads[i] == i]
    size, goal = brute_targets(rows)
    ids = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long")
    h = {r.doc_id: (r.h, r.u) for r in ids.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h"), F.xxhash64(F.lit(mixing.SEED + 1), "doc_id").alias("u")).collect()}
    taken = dict(brute_taken(rows, [h[i][0] for i, _, _ in rows], goal, size))
    want = Counter()
    for i, t, _ in rows:
        if taken[i]:
            want[i] += math.floor(taken[i] / len(words(t)) + ((h[i][1] & (2**64 - 1)) >> 11) / float(1 << 53))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == +want
    texts = {i: t for i, t, _ in rows}
    enc = spm.Encoder(spm.Vocabulary.load())
    assert all(r.ids == enc.encode([texts[r.doc_id]])[0].tolist() for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixture", "tokens"]


def test_stages_on_odd_tables(spark):
    """Each stage on an empty table, and on rows without an id or text and repeated rows, with a column more."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, keep string"
    text = " ".join(f"word{i} mail{i}@x.org" for i in range(40))
    rows = [(None, text, "en", "s", 1, "a"), (1, None, "en", None, 0, "b"), (2, text, "en", "s", 1, "c"), (2, text, "en", "s", 1, "c"), (3, "", None, "s", 0, None)]
    for rows_ in ([], rows):
        docs = spark.createDataFrame(rows_, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != "tokens":
                assert out.columns == docs.columns
            if not rows_:
                assert not got
            elif name == "quality_rules":
                assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 2), (False, 2), (True, None)]
            elif name == "near_duplicates":
                assert Counter(r.doc_id for r in got)[None] == 1 and {r.doc_id for r in got} == {None, 1, 2, 3}
            elif name in ("personal_data", "tokens"):
                assert len(got) == len(rows_)
