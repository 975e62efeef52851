"""WARC derivatives: from response records to metadata and plain-text conversion records.

Each response gives one ``metadata`` record (its HTTP headers, title, language and links) and
one ``conversion`` record (its text). Both refer to the response by its record id and carry
the response's address, date and payload digest. Records are rows; they are written as and
read from WARC/1.1 files by Spark's text source.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
PLAIN = "text/plain; charset=utf-8"
FIELDS = "application/warc-fields"
# Content that is not text, elements that end a line, and single passes over what is left.
_HIDDEN = (r"(?is)<(?:!--.*?--|script\b.*?</script\s*|style\b.*?</style\s*"
           r"|noscript\b.*?</noscript\s*|template\b.*?</template\s*|title\b.*?</title\s*)>")
_BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form"
           r"|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)"
           r"\b[^>]*>")
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
# An attribute's value: in double quotes, in single quotes, or without quotes.
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_HREF = r"""(?i)<a\b[^>]*?(?<=[\s"'/])href""" + _VALUE
_LANG = r"""(?i)<html\b[^>]*?(?<=[\s"'/:])lang""" + _VALUE
# Named character references that are met most, and those read as plain text.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©",
    "reg": "®", "middot": "·", "laquo": "«", "raquo": "»", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "bull": "•", "euro": "€", "trade": "™",
}

# All references of HTML, by their first letter.
_ALL_NAMED = {first: {k[:-1]: v for k, v in html5.items() if k[0] == first and k[-1] == ";"}
              for first in sorted({k[0] for k in html5})}


def record_id(kind: Column, *parts: Column) -> Column:
    """A stable ``<urn:uuid:...>`` for what ``kind`` and ``parts`` name."""
    named = F.md5(F.concat_ws("|", kind, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(named, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def decoded(text: Column) -> Column:
    """Character references decoded once, left to right; unknown ones and those without a
    semicolon stay as they are."""
    # A literal, which the optimizer folds into one map.
    every = F.from_json(F.lit(json.dumps(_ALL_NAMED)), "map<string,map<string,string>>")

    def one(cut: Column) -> Column:
        piece, name = cut["piece"], cut["name"]
        rest = F.substr(piece, F.length(name) + 2)
        number = F.when(F.startswith(F.lower(name), F.lit("#x")), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(
            F.substr(name, F.lit(2))).try_cast("int")
        point = F.when((number < 1) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(number)
        letter = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        known = F.try_element_at(F.try_element_at(every, F.substring(name, 1, 1)), name)
        for k, v in NAMED.items():
            known = F.when(name == k, F.lit(v)).otherwise(known)
        value = F.when(F.startswith(name, F.lit("#")), letter).otherwise(known)
        return F.when(name.isNull(), piece).otherwise(
            F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), piece)))

    # The functions of arrays work out an argument anew wherever it is named, so the text is
    # named once, and each name is bound before it is looked up. What leads has no name.
    cut = F.transform(F.split(text, "&"), lambda piece, i: F.struct(
        piece.alias("piece"), F.when(i > 0, F.regexp_extract(piece, _ENTITY, 1)).alias("name")))
    return F.array_join(F.transform(cut, one), "")


def _folded(text: Column) -> Column:
    """White space within lines as one space, blank lines dropped, ends trimmed."""
    # Single blanks, the most of them, are left alone.
    flat = F.regexp_replace(text, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
    return F.btrim(F.regexp_replace(flat, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """What a reader sees: no markup, scripts, styles, comments or title, a line per block."""
    shown = F.regexp_replace(html, _HIDDEN, " ")
    shown = F.regexp_replace(F.regexp_replace(shown, _BREAKS, "\n"), r"<[/!?a-zA-Z][^>]*>", "")
    return _folded(decoded(shown))


def _unquoted(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit("^[\"']")), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def links(html: Column, url: Column) -> Column:
    """Addresses of the ``<a href=...>`` of a page, quoted or not, in order, made absolute."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(
        url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))

    def whole(link: Column) -> Column:
        return (F.when(F.rlike(link, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
                .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
                .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
                .when(F.startswith(link, F.lit("#")) | F.startswith(link, F.lit("?")),
                      F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), link))
                .otherwise(F.concat(folder, link)))

    found = F.regexp_extract_all(html, F.lit(_HREF), F.lit(1))
    return F.transform(F.transform(found, lambda x: decoded(_unquoted(x))), whole)


def responses(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html",
              date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages as response records: ``key``, ids, address, date, HTTP headers, payload."""
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        F.col(key), record_id(F.lit("response"), F.col(key), F.col(url)).alias("record_id"),
        F.coalesce(F.col(url), F.lit("")).alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                 F.octet_length(payload).cast("string")).alias("http_headers"),
        payload.alias("payload"))


def derivatives(response: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response, with all its other columns.

    Needs ``record_id``, ``target_uri``, ``date``, ``http_headers`` and ``payload``; adds or
    replaces ``refers_to``, ``record_type``, ``content_type``, ``block``, ``content_length``,
    ``block_digest``, ``payload_digest`` (the response's) and ``link_count``. An empty payload
    gives an empty text; NULLs read as empty; responses that repeat give records that repeat;
    an empty table gives none.
    """
    made = ("refers_to", "record_type", "content_type", "block", "content_length", "block_digest",
            "payload_digest", "link_count")
    payload, uri = F.coalesce(F.col("payload"), F.lit("")), F.coalesce(F.col("target_uri"), F.lit(""))
    base = response.drop(*made).withColumns({
        "refers_to": F.col("record_id"), "payload_digest": digest(payload), "__links": links(payload, uri)})
    title = _folded(F.regexp_replace(decoded(
        F.regexp_extract(payload, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), r"\n", " "))
    language = _unquoted(F.regexp_extract(payload, _LANG, 1))
    # The response's header lines, each under a name of its own.
    headers = F.filter(F.split(F.coalesce("http_headers", F.lit("")), CRLF), lambda h: h != "")
    lines = F.concat(
        F.transform(headers, lambda h: F.concat(F.lit("source-header: "), h)),
        F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), language)),
        F.transform("__links", lambda x: F.concat(F.lit("outlink: "), x)))
    metadata = F.struct(
        F.lit("metadata").alias("record_type"), F.lit(FIELDS).alias("content_type"),
        F.concat(F.array_join(lines, CRLF), F.lit(CRLF)).alias("block"))
    conversion = F.struct(
        F.lit("conversion").alias("record_type"), F.lit(PLAIN).alias("content_type"),
        plain_text(payload).alias("block"))
    rows = base.withColumn("__record", F.explode(F.array(metadata, conversion)))
    keep = [c for c in response.columns if c not in (*made, "record_id", "payload", "http_headers")]
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], F.col("__record.record_type"),
        record_id(F.col("__record.record_type"), F.col("refers_to")).alias("record_id"),
        "refers_to", F.col("__record.content_type"), F.col("__record.block"),
        F.octet_length("__record.block").cast("bigint").alias("content_length"),
        digest(F.col("__record.block")).alias("block_digest"), "payload_digest",
        F.size("__links").alias("link_count"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derivative records as WARC files, one for each partition."""
    head = F.concat_ws(
        CRLF, F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), "payload_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
    records.select(F.concat(head, F.lit(CRLF * 2), "block").alias("value")).write.option(
        "lineSep", CRLF * 2).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC/1.1 files: ``headers`` (lower-case names), ``block``, ``whole``.

    ``whole`` is false where the block is shorter than its Content-Length, as in a file that
    was cut off or in a record that holds another's first line.
    """
    rows = spark.read.option("lineSep", f"{CRLF * 2}{VERSION}{CRLF}").text(path)
    text = F.regexp_replace("value", r"^WARC/1\.1\r\n", "")
    head = F.substring_index(text, CRLF * 2, 1)
    block = F.substr(text, F.length(head) + 5)
    headers = F.map_from_entries(F.transform(F.split(head, CRLF), lambda h: F.struct(
        F.lower(F.substring_index(h, ":", 1)).alias("key"), F.ltrim(F.substr(h, F.instr(h, ":") + 1)).alias("value"))))
    parts = rows.select(headers.alias("headers"), F.encode(block, "UTF-8").alias("block"))
    size = F.col("headers")["content-length"].try_cast("int")
    return parts.select(
        "headers", F.decode(F.substr("block", F.lit(1), F.coalesce(size, F.lit(0))), "UTF-8").alias("block"),
        F.coalesce(F.octet_length("block") >= size, F.lit(False)).alias("whole"))
