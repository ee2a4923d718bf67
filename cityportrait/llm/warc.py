"""WARC archives whose payloads are stored once, by their digest.

An archive is two tables. `payloads` holds every distinct payload once under its SHA-256. `headers` holds one row a
record: the exact bytes that stand before the payload (the WARC header and the HTTP header) and the payload's address.
Joins put the original records together again; a payload whose bytes don't have the digest that names it is an error.
Of the pages with equal payloads that with the largest page_id is the response; the others are revisits of it, whose
records end with the HTTP header. All of it are SQL functions.

The records are those of WARC 1.1: `files` writes them as plain or gzip text of the format, one file a partition.

Cases: a null html is an empty payload; a null page_id is smaller than all others and written as `null`; a null url
has no WARC-Target-URI; line breaks in a url are written as %0D and %0A; among equal rows one is the response and the
others revisit it; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cityportrait.llm.common import hot_keys, small_or, spread_join, written
from cityportrait.operators.lineage import new_path

#: Smaller payloads are all responses.
MIN_BYTES = 0
#: The tables have no time of capture, so all records have this one.
DATE = "1970-01-01T00:00:00Z"
ID = "urn:x-page"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Base 32 (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAX_BROADCAST_COPIES = 100_000
END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: five hexadecimal digits are four characters."""
    digits = F.sha1(data)
    number = lambda i: F.conv(F.substring(digits, i * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda n, k: F.substring(F.lit(BASE32), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(number(i), k) for i in range(8) for k in range(4)])


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


@dataclass
class Archive:
    """payloads: sha256, payload. headers: page_id, sha256, has_payload, header (bytes)."""

    payloads: DataFrame
    headers: DataFrame


def _described(pages: DataFrame) -> DataFrame:
    """One narrow row a page, written, with a number of its own: what its header needs to know of its payload."""
    p = pages.select("page_id", "url", payload(F.col("html")).alias("payload"))
    d = p.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    return written(d.withColumn("row", F.monotonically_increasing_id()))


def _header() -> Column:
    """The bytes before a record's payload, out of page_id, url, n, sha1, row and the response's of_page and of_row."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    name = lambda page, row: F.concat(F.lit(f"<{ID}:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id", "row")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", name("of_page", "of_row")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    ).cast("binary")


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> Archive:
    """Write the archive of all pages. Payloads are moved only where copies of them meet."""
    d = _described(pages)
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))), -F.col("row"), "page_id", "row"))
    groups = d.groupBy("sha256").agg(F.count("*").alias("count"), best.alias("best")).filter("count > 1")
    groups = written(groups.select("sha256", "count", F.col("best.page_id").alias("of_page"), F.col("best.row").alias("of_row")))
    known, small = small_or(groups.select("sha256", "of_page", "of_row"), MAX_BROADCAST_COPIES)
    if small:
        d = d.join(known, "sha256", "left")
    else:
        d = spread_join(d, known, ["sha256"], ["row"], hot_keys(groups.select("sha256", "count"), d.count()), "left")
    d = d.withColumn("revisit", (F.col("n") >= min_bytes) & F.col("of_row").isNotNull() & (F.col("of_row") != F.col("row")))
    path = new_path(pages.sparkSession, ".warc-headers")
    d.select("page_id", "sha256", (~F.col("revisit")).alias("has_payload"), _header().alias("header")).write.option("compression", "zstd").parquet(path)
    headers = pages.sparkSession.read.parquet(path)

    p = pages.select("page_id", payload(F.col("html")).alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    copies = known.withColumnRenamed("sha256", "_of")
    once = p.join(copies, F.col("sha256") == F.col("_of"), "left_anti")
    # of a group of copies only the rows of the largest page_id are moved
    first = p.join(copies, (F.col("sha256") == F.col("_of")) & F.col("page_id").eqNullSafe(F.col("of_page"))).dropDuplicates(["sha256"])
    stored = once.select("sha256", "payload").unionByName(first.select("sha256", "payload"))
    path = new_path(pages.sparkSession, ".warc-payloads")
    stored.write.option("compression", "zstd").parquet(path)
    return Archive(pages.sparkSession.read.parquet(path), headers)


def verified(payloads: DataFrame) -> DataFrame:
    """The payloads, each proved to have the digest that it is stored under."""
    wrong = F.raise_error(F.concat(F.lit("the payload stored as "), F.col("sha256"), F.lit(" has another digest")))
    return payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong.cast("binary")))


def _with_payloads(headers: DataFrame, about: DataFrame) -> DataFrame:
    """Join what is known of the payloads to the headers; an address that many headers share is joined in parts."""
    hot = hot_keys(headers.groupBy("sha256").count(), headers.count())
    return spread_join(headers, about, ["sha256"], ["header"], hot)


def records(archive: Archive) -> DataFrame:
    """(page_id, record): the original records, header and payload, without the line breaks that end them."""
    full = archive.headers.filter("has_payload")
    whole = _with_payloads(full, verified(archive.payloads)).select("page_id", F.concat("header", "payload").alias("record"))
    return whole.unionByName(archive.headers.filter("NOT has_payload").select("page_id", F.col("header").alias("record")))


def pages_of(archive: Archive) -> DataFrame:
    """(page_id, url, html) back out of the archive, revisits with the payload that they refer to."""
    head = F.decode("header", "UTF-8")
    found = _with_payloads(archive.headers, verified(archive.payloads))
    url = F.regexp_extract(head, r"\r\nWARC-Target-URI: ([^\r\n]*)", 1)
    return found.select("page_id", F.when(head.contains("\r\nWARC-Target-URI: "), url).alias("url"), F.decode("payload", "UTF-8").alias("html"))


def files(archive: Archive, path: str, compression: str = "gzip") -> None:
    """Write the records as WARC files, one a partition."""
    text = records(archive).select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END).option("compression", compression).text(path)


def read_back(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, read from the archive.

    Each stored payload is read and digested once; headers tell the rest. A header whose payload digest or length is
    not the stored payload's is an error.
    """
    about = verified(archive.payloads).select("sha256", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    r = _with_payloads(archive.headers, about)
    head = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    told = F.regexp_extract(head, r"\r\n\r\n(?s:.*)\r\nContent-Length: ([0-9]+)", 1).cast("long")
    page = F.regexp_extract(field("WARC-Refers-To"), rf"<{ID}:(-?[0-9]+|null):", 1)
    equal = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (told == F.col("payload_bytes"))
    wrong = F.raise_error(F.lit("a record's header does not fit its payload")).cast("string")
    return r.select(
        "page_id", "payload_bytes",
        F.when(equal, F.col("payload_digest")).otherwise(wrong).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(page.rlike("[0-9]"), page).cast("long").alias("refers_to"),
    )


def warc(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archive all pages and read the archive back."""
    return read_back(archived(pages, min_bytes))

