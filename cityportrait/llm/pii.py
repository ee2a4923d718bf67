"""Personal data in DataFrame functions only: patterns propose spans, checksums confirm, context words score.

Spans are in code points, end exclusive. Kinds with a checksum or a fixed form (email, ip, card, phone, iban) are
taken when they pass it; a kind without one (ssn) is taken only if a context word stands before it. Patterns are
written so that Java's engine neither recurses nor rescans a run: possessive runs and a look-behind replace
backtracking, and match the same spans as the plain forms.

Cases: a null or empty text has no spans; repeated rows each get a row; an empty table gives an empty table; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Plain forms (fixed values), as a reader or another engine would write them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What an iban's head may stand for at most: as words may follow it, each part from the head to a word's end is tested.
IBAN, IBAN_CHARS = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 66
#: A cheap test that every match of the kind passes.
TRIGGER = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|tax",
}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS, CONTEXT_CHARS, MIN_SCORE = 0.2, 40, 0.5
BASE = ["email", "ip", "card", "phone"]
BLOCK = 512


def _running(d: str) -> str:
    """Running sums of a bigint array, by blocks, so that long arrays are not copied once per element."""
    n = f"(size({d}) - 1) div {BLOCK}"
    blocks = f"transform(sequence(0, cast({n} AS int)), b -> slice({d}, b * {BLOCK} + 1, {BLOCK}))"
    before = f"aggregate({blocks}, array(0L), (acc, p) -> concat(acc, array(element_at(acc, -1) + aggregate(p, 0L, (s, x) -> s + x))))"
    inner = "slice(aggregate(p, array(z), (acc, x) -> concat(acc, array(element_at(acc, -1) + x))), 2, size(p))"
    return f"flatten(zip_with({blocks}, slice({before}, 1, cast({n} AS int) + 1), (p, z) -> {inner}))"


def _valid(kind: str, s: str) -> str:
    digits = f"regexp_replace({s}, '[^0-9]', '')"
    compact = f"replace({s}, ' ', '')"
    return {
        "email": "true",
        "ip": f"forall(split({s}, '[.]'), p -> length(trim(LEADING '0' FROM p)) < 3 OR (length(trim(LEADING '0' FROM p)) = 3 AND trim(LEADING '0' FROM p) <= '255'))",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits})",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({compact}) BETWEEN 15 AND 34 AND aggregate(split(concat(substr({compact}, 5), substr({compact}, 1, 4)), ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c <= '9' THEN pmod(a * 10 + ascii(c) - 48, 97) ELSE pmod(a * 100 + ascii(c) - 55, 97) END) = 1",
        "ssn": f"substr({s}, 1, 3) NOT IN ('000', '666') AND substr({s}, 1, 1) <> '9' AND substr({s}, 5, 2) <> '00' AND substr({s}, 8) <> '0000'",
    }[kind]


def _iban(text: str, start: str) -> str:
    """The longest valid iban from a head on, null without one."""
    whole = f'split(regexp_extract(substr({text}, cast({start} + 1 AS int), {IBAN_CHARS}), r"{IBAN}", 0), " ")'
    parts = f"transform({whole}, (w, i) -> array_join(slice({whole}, 1, i + 1), ' '))"
    return f"try_element_at(filter({parts}, p -> {_valid('iban', 'p')}), -1)"


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one column per kind, `_<kind>`: array<struct<s, e, score>> of its confirmed spans, in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = {}
    for k, pattern in PATTERNS.items():
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        empty = F.expr("cast(array() AS array<string>)")
        found[f"_m_{k}"] = F.when(F.instr(t, TRIGGER[k]) > 0, hits).otherwise(empty) if k in TRIGGER else hits
    d = df.withColumns(found)
    # the pieces between matches carry the positions
    d = d.withColumns({
        f"_d_{k}": F.when(
            F.size(f"_m_{k}") > 0,
            F.expr(f"transform(slice(split(coalesce({text}, ''), r\"{p}\", -1), 1, size(_m_{k})), (x, i) -> cast(length(x) + coalesce(length(get(_m_{k}, i - 1)), 0) AS bigint))"),
        )
        for k, p in PATTERNS.items()
    })
    text_or = f"coalesce({text}, '')"
    zipped = {k: f"arrays_zip(_m_{k} , {_running(f'_d_{k}')})" for k in PATTERNS}
    valid = {k: f"""filter({zipped[k]}, z -> {_valid(k, f"z['_m_{k}']")})""" for k in PATTERNS}
    valid["iban"] = f"""filter(transform({zipped['iban']}, z -> named_struct('_m_iban', {_iban(text_or, "z['1']")}, '1', z['1'])), z -> z['_m_iban'] IS NOT NULL)"""
    d = d.withColumns({
        f"_{k}": F.coalesce(
            F.expr(f"""transform({valid[k]},
                z -> struct(cast(z['1'] AS bigint) AS s, cast(z['1'] + length(z['_m_{k}']) AS bigint) AS e,
                  least(1D, {BASE_SCORE[k]}D + CASE WHEN lower(substr(coalesce({text}, ''), cast(greatest(1, z['1'] + 1 - {CONTEXT_CHARS}) AS int), cast(least(z['1'], {CONTEXT_CHARS}) AS int))) rlike r"{CONTEXT[k]}" THEN {CONTEXT_BONUS}D ELSE 0D END) AS score))"""),
            F.expr("cast(array() AS array<struct<s:bigint,e:bigint,score:double>>)"),
        )
        for k in PATTERNS
    })
    d = d.withColumn("_ssn", F.filter("_ssn", lambda x: x["score"] >= MIN_SCORE))
    return d.drop(*[f"_m_{k}" for k in PATTERNS], *[f"_d_{k}" for k in PATTERNS])


def _listed(kinds: list[str]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, the digest of the base spans, all spans, and the highest score (null without spans)."""
    d = spans(docs.select("doc_id", "text"))
    return d.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(BASE), 256).alias("base_sha256"),
        _listed(list(PATTERNS)).alias("spans"),
        F.array_max(F.transform(F.concat(*[F.col(f"_{k}") for k in PATTERNS]), lambda x: x["score"])).alias("top_score"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every confirmed span replaced by its kind in brackets, and n_chars to match.

    Overlapping spans of several kinds become one, named after the first.
    """
    d = spans(docs.select(F.struct(*docs.columns).alias("row"), "text"))

    def tagged(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("tag")))

    every = F.concat(*[tagged(k) for k in PATTERNS])
    d = d.withColumn("_every", F.sort_array(every))
    merged = F.expr("""aggregate(_every, cast(array() AS array<struct<s:bigint,e:bigint,tag:string>>), (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.s < element_at(acc, -1).e
             THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s AS s, greatest(element_at(acc, -1).e, x.e) AS e, element_at(acc, -1).tag AS tag)))
             ELSE concat(acc, array(x)) END)""")
    d = d.withColumn("_every", F.when(F.size("_every") > 0, merged))
    clean = F.expr("""concat(array_join(transform(_every, (x, i) -> concat(
          substr(text, cast(coalesce(get(_every, i - 1).e, 0L) + 1 AS int), cast(x.s - coalesce(get(_every, i - 1).e, 0L) AS int)), x.tag)), ''),
        substr(text, cast(element_at(_every, -1).e + 1 AS int)))""")
    found = F.col("_every").isNotNull()
    d = d.withColumn("_text", F.when(found, clean).otherwise(F.col("text")))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("_text").alias(c))
        elif c == "n_chars":
            out.append(F.when(found, F.length("_text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`"))
    return d.select(*out)
