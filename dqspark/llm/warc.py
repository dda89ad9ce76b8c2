"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

A response is a row with its record id, target address, date, the HTTP header
block and the payload.  Each gives a ``metadata`` record that refers to it (the
block holds the source's headers, digests and title as ``application/warc-fields``)
and a ``conversion`` record that refers to it (the block is the page's text).
Record ids are made from the source's id, so reruns agree and links hold without
a join.  Everything is done by column functions, row by row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What entities of text stand for; ``&amp;`` comes last so that nothing is decoded twice.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"),
)
#: Elements whose content is no text, and those that end a line.
UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>"
BREAKS = r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"(?s)<[A-Za-z/!?][^>]*>"
#: What matches UNSEEN, told by its first character alone.
UNSEEN_FROM_SIGN = r"(?is)<(?:!--.*?-->|(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>)"
#: Two or more blanks and line ends: the groups keep a line end if there is one, else a blank.
RUNS = r"(?=[ \n][ \n])(?: *(\n)[ \n]*|( ) +)"
DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
TEXT_TYPE = "text/plain; charset=UTF-8"
FIELDS_TYPE = "application/warc-fields"


def plain_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; a line per block; blanks run together."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN_FROM_SIGN, " ")
    for blank in "\r\n\t\f":  # runs of blanks wait for the last step
        out = F.replace(out, F.lit(blank), F.lit(" "))
    out = F.regexp_replace(out, BREAKS, "\n")
    out = F.regexp_replace(out, TAGS, "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, RUNS, "$1$2")
    return F.btrim(out, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A name-based identifier: ``<urn:uuid:...>`` of the digest of the parts."""
    d = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(
        F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">")
    )


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses_from_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` (page_id, url, html) as responses; null html is an empty payload, a null url an empty address."""
    body = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id"),
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
            F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
        ).alias("http_headers"),
        body.alias("payload"),
    )


def _text_length(block: Column) -> Column:
    return F.octet_length(block).cast("long")


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response, ``metadata`` and ``conversion``: the record's fields, its block, its bytes.

    ``responses`` has record_id, target_uri, date, http_headers and payload (text);
    page_id is handed on where it is there.  Nulls in any of them count as
    empty; a response without payload has a conversion with an empty block.
    Rows that repeat give equal records again.  An empty table gives an empty one.
    """
    carried = [c for c in ("page_id",) if c in responses.columns]
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("record_id", "target_uri", "date", "http_headers", "payload")}
    source = responses.select(*carried, *[v.alias(c) for c, v in empty.items()])
    source = source.select(
        "*",
        digest(F.col("payload")).alias("source_payload_digest"),
        digest(F.concat("http_headers", "payload")).alias("source_block_digest"),
        plain_text(F.col("payload")).alias("text"),
        plain_text(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title"),
    )
    crlf = F.lit("\r\n")
    headers = F.regexp_replace(F.regexp_replace("http_headers", r"\r\n\r\n$", ""), r"\r\n", "\r\nhttp-header: ")
    fields = F.concat(
        F.lit("title: "), F.regexp_replace("title", r"\n", " "), crlf,
        F.lit("http-header: "), headers, crlf,
        F.lit("source-payload-digest: "), "source_payload_digest", crlf,
        F.lit("source-block-digest: "), "source_block_digest", crlf,
        F.lit("source-length: "), _text_length(F.col("payload")).cast("string"), crlf,
        F.lit("text-length: "), _text_length(F.col("text")).cast("string"), crlf,
    )
    made = F.explode(
        F.array(
            F.struct(F.lit("metadata").alias("record_type"), F.lit(FIELDS_TYPE).alias("content_type"), fields.alias("block")),
            F.struct(F.lit("conversion").alias("record_type"), F.lit(TEXT_TYPE).alias("content_type"), F.col("text").alias("block")),
        )
    )
    rows = source.select(
        *carried, F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers",
        "source_payload_digest", "source_block_digest", made.alias("r"),
    ).select(*carried, "refers_to", "target_uri", "date", "http_headers", "source_payload_digest", "source_block_digest", "r.*")
    rows = rows.withColumn("record_id", record_id(F.col("record_type"), F.col("refers_to")))
    rows = rows.withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", _text_length(F.col("block")))
    return rows.withColumn("concurrent_to", record_id(F.when(F.col("record_type") == "metadata", F.lit("conversion")).otherwise(F.lit("metadata")), F.col("refers_to")))


def header(records: DataFrame) -> Column:
    """Header block of each record, as it stands in a file."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n"))
    c = F.col
    return F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", c("record_type")), line("WARC-Record-ID", c("record_id")), line("WARC-Refers-To", c("refers_to")),
        line("WARC-Concurrent-To", c("concurrent_to")), line("WARC-Target-URI", c("target_uri")), line("WARC-Date", c("date")),
        line("WARC-Block-Digest", c("block_digest")), line("X-Source-Payload-Digest", c("source_payload_digest")),
        line("Content-Type", c("content_type")), line("Content-Length", c("content_length")), F.lit("\r\n"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """``records`` with ``warc``, the bytes of each record: header, block, two line ends."""
    return records.withColumn("warc", F.encode(F.concat(header(records), F.col("block"), F.lit("\r\n\r\n")), "UTF-8"))
