"""SQL that DuckDB runs for the queries it can express on whole tables."""

from __future__ import annotations

from cityportrait.llm.conversations import DAMAGES, DELETE, INSERT, REROLE
from cityportrait.llm.host_rules import DEVIATIONS, LEAST_WEIGHT, MAX_RATE, MAX_REPEAT_PERCENT, MIN_WORDS, SOFT
from cityportrait.llm.neardup import PERCENT
from cityportrait.llm.negatives import ANCHOR_EVERY, LABELS, LEAST, MOST, MOVED_EVERY, NEGATIVES, POSITIVES, SCALE
from cityportrait.llm.warc import BASE32, MIN_BYTES

_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

HOST_RULES = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
c AS (SELECT doc_id, source, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM c)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE k > 1) GROUP BY 1),
f AS (SELECT c.doc_id, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM c LEFT JOIN r ON c.doc_id = r.doc_id),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        n_symbols > {SOFT["max_symbols_per_word"]} * n_words OR n_dup_lines > {SOFT["max_dup_line_share"]} * n_lines
        OR word_chars / greatest(n_words, 1)::DOUBLE < {SOFT["min_mean_word"]} OR word_chars / greatest(n_words, 1)::DOUBLE > {SOFT["max_mean_word"]} AS soft_failed FROM f),
h AS (SELECT source, count(*) AS n, count_if(base_failed OR soft_failed) AS f FROM j GROUP BY 1),
o AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, least(greatest(sum(f) / sum(n)::DOUBLE, 0.001), 0.999) AS m, sum(f * f / n::DOUBLE) - sum(f)::DOUBLE * sum(f) / sum(n) AS spread, sum(n * n::DOUBLE) AS squares FROM h),
p AS (SELECT m, CASE WHEN n - squares / n - (k - 1) > 1e-6 THEN (spread / (m * (1 - m)) - (k - 1)) / (n - squares / n - (k - 1)) ELSE 0 END AS within FROM o),
q AS (SELECT m, within, CASE WHEN within > 1e-9 THEN greatest(1 / least(within, 1.0) - 1, {LEAST_WEIGHT}) END AS weight FROM p),
b AS (SELECT source, CASE WHEN weight IS NULL THEN m > {MAX_RATE} ELSE (f + m * weight) / (n + weight) > least({MAX_RATE}, m + {DEVIATIONS} * sqrt(m * (1 - m) / (weight + 1))) END AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND soft_failed) AS kept
FROM j JOIN b ON j.source IS NOT DISTINCT FROM b.source
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(t=_LOWERED)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM t),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) + any_value(b.n) AS n FROM u a JOIN u b ON a.e = b.e AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * i >= {PERCENT} * (n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.id, e.y FROM reach JOIN e ON reach.other = e.x),
m AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.id
"""

#: Repair of conversations: the edits' matrices as tables, one row of each conversation a step.
_CRC = """xor(list_reduce(list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
  list_reduce([0, 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

CONVERSATIONS = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(s="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % {DAMAGES} AS h FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS times
    FROM o WHERE h <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end FROM r),
f AS (SELECT *, NOT blank AND k > 1 AS duplicate, NOT blank AND k = 1 AND open_end AS truncated, before || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM m),
step(a, letter, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted(a, b, cost, way) AS (SELECT s, s, 0, '' FROM range(4) t(s) UNION ALL SELECT a, b, {INSERT}, 'I' FROM step WHERE letter <> 's'
    UNION ALL SELECT x.a, y.b, {2 * INSERT}, 'II' FROM step x JOIN step y ON x.b = y.a AND x.letter <> 's' AND y.letter <> 's' AND x.a <> y.b),
own AS (SELECT conv_id, i, s AS a, s AS b, {DELETE} AS cost, 'D' AS way FROM f, range(4) t(s)
    UNION ALL SELECT conv_id, i, a, b, truncated::INT, 'K' FROM f JOIN step ON letter = left(role, 1) AND NOT blank AND NOT duplicate
    UNION ALL SELECT conv_id, i, a, b, {REROLE} + truncated::INT, 'R' FROM f JOIN step ON letter <> 's' AND NOT blank AND NOT duplicate),
moves AS (SELECT conv_id, i, x.a, y.b, min({{'cost': x.cost + y.cost, 'way': x.way || y.way}}) AS best FROM inserted x JOIN own y ON x.b = y.a GROUP BY ALL),
walk(conv_id, i, s, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, {{'cost': 0::BIGINT, 'way': ''}} FROM f
    UNION ALL SELECT w.conv_id, w.i + 1, m.b::BIGINT, min({{'cost': w.best.cost + m.best.cost::BIGINT, 'way': w.best.way || m.best.way}})
    FROM walk w JOIN moves m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1 AND m.a = w.s GROUP BY w.conv_id, w.i, m.b),
n AS (SELECT conv_id, count(*) AS n, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY 1),
e AS (SELECT w.conv_id, min({{'cost': w.best.cost + x.cost, 'way': w.best.way || x.way}}) AS best
    FROM walk w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n JOIN inserted x ON x.a = w.s AND x.b IN (0, 3) GROUP BY 1),
c AS (SELECT conv_id, best.way AS way, unnest(range(1, length(best.way) + 1)) AS p, length(replace(best.way, 'D', '')) % 2 AS odd FROM e),
l AS (SELECT conv_id, way[p] AS edit, p, length(replace(way[1:p], 'I', '')) AS i, length(replace(way[1:p], 'D', '')) - odd AS spot FROM c),
t AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN f.role WHEN spot % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p)) AS sha
    FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE edit <> 'D' GROUP BY 1)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.way, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN n ON q.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN e ON q.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN t ON q.conv_id IS NOT DISTINCT FROM t.conv_id
"""

HARD_NEGATIVES = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
f AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
r AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM f JOIN p USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score)
SELECT * FROM r WHERE rank <= {NEGATIVES}
"""

_FIVE = "('0x' || substr(d, {at}, 5))::BIGINT"
_LETTER = "substr('" + BASE32 + "', (({five} >> {shift}) & 31)::INT + 1, 1)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS of FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    {" || ".join(_LETTER.format(five=_FIVE.format(at=5 * i + 1), shift=15 - 5 * k) for i in range(8) for k in range(4))} AS payload_digest,
    CASE WHEN n >= {MIN_BYTES} AND of <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {MIN_BYTES} AND of <> page_id THEN of END AS refers_to FROM r
"""
