"""WARC derivative builder: metadata and plain-text conversion records from responses.

For each response record two derived records are made: `metadata` (title, language, links
and the source's own headers as JSON) and `conversion` (the page's visible text). Both keep
the response's id in WARC-Refers-To, name each other in WARC-Concurrent-To, carry its target
URI and date, and its payload digest; block digests are of the derived blocks. Digests are
`sha1:` and base32, as WARC writers give them. Ids are made from the digest of the source
id, so that a job run again makes the same records.

One pass without a shuffle: records never meet. Pages are described over Arrow batches, ids,
digests, headers and JSON are DataFrame code.

Defined cases: null html is an empty payload with empty text and no links, pages of any length
are read whole; a null url leaves the target URI header out; equal rows give equal records; an
empty table gives none; text between tags that never close stays; character references are
resolved once, as HTML names them; other columns are carried only when named, under any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.words import rows_of

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(block: Column) -> Column:
    """`sha1:` and the base32 form of block's SHA-1, five hexadecimal digits to four letters."""
    hexed = F.sha1(block.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def record_id(*of: Column) -> Column:
    """A urn:uuid made from the columns' values."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in of]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4], F.lit(">"))


_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
_TAG = re.compile(rf"(?i)(<(?:/?(?:{BLOCKS})\b|!doctype)[^>]*>)|</?[A-Za-z][^>]*>")
_SPACE, _BREAK = re.compile("[ \t\x0B\f\r\xa0]+"), re.compile(" ?\n[ \n]*")
_LINK = re.compile(r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
_TITLE, _LANG = re.compile(r"(?is)<title[^>]*>(.*?)</title>"), re.compile(r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""")


def visible(shown: str) -> str:
    """The text that a reader sees in a page without its hidden parts: a line for each block, references resolved once."""
    text = unescape(_TAG.sub(lambda m: "\n" if m[1] else "", shown))
    return _BREAK.sub("\n", _SPACE.sub(" ", text)).strip(" \n")


def described(html: str) -> tuple[str, str, str | None, list[str]]:
    """(visible text, title, language, links) of a page; comments, scripts and styles have no text or title."""
    shown, lang = _HIDDEN.sub("", html), _LANG.search(html)
    title = _TITLE.search(shown)
    return visible(shown), unescape(title[1]).strip(" ") if title else "", lang[1] if lang else None, [unescape(x.strip("\"'")) for x in _LINK.findall(html)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        at = whole.schema.get_field_index("payload")
        for batch in rows_of(whole, column="payload"):
            found = [described(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_text", "_title", "_lang", "_links"])


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html): record_id, target_uri, date, http (header lines), payload."""
    html = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    return pages.select("page_id", record_id(F.lit("response"), F.col("page_id"), F.col("url"), html).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), html.alias("payload"))


def derive(source: DataFrame, *carry: str) -> DataFrame:
    """Two records for each response (record_id, target_uri, date, http, payload), with the columns named in carry.

    Columns: type, record_id, refers_to, concurrent_to, target_uri, date, content_type,
    content_length, block_digest, payload_digest (the source's), block.
    """
    meta_id, conv_id = (record_id(F.lit(k), F.col("record_id")) for k in ("metadata", "conversion"))
    carried = [F.struct(*carry).alias("_carry")] if carry else []
    rows = source.select(*carried, "record_id", "target_uri", "date", "http", "payload", digest(F.col("payload")).alias("_pd"), meta_id.alias("_m"), conv_id.alias("_c"))
    new = T.StructType.fromDDL("_text string, _title string, _lang string, _links array<string>")
    df = rows.mapInArrow(_describe, T.StructType(rows.schema.fields + new.fields))
    meta = F.to_json(F.struct(
        F.struct(F.col("record_id").alias("WARC-Record-ID"), F.col("target_uri").alias("WARC-Target-URI"), F.col("date").alias("WARC-Date"), F.col("_pd").alias("WARC-Payload-Digest")).alias("warc"),
        F.split("http", "\r\n").alias("http"), F.col("_title").alias("title"), F.col("_lang").alias("lang"), F.col("_links").alias("links"), F.col("_c").alias("conversion")))
    one = lambda kind, own, other, mime, block: F.struct(F.lit(kind).alias("type"), F.col(own).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array(one("metadata", "_m", "_c", "application/json", meta), one("conversion", "_c", "_m", "text/plain; charset=utf-8", F.col("_text")))
    df = df.select(*["_carry"] * bool(carry), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("_pd").alias("payload_digest"), F.explode(both).alias("r"))
    return df.select(
        *["_carry.*"] * bool(carry), "r.type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "payload_digest", "r.block")


def _record(records: DataFrame) -> Column:
    """The text of a record up to the two line ends that close it."""
    header = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))
    names = {
        "WARC-Type": "type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to",
        "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    return F.concat(F.lit(f"{VERSION}\r\n"), *[F.coalesce(header(k, c), F.lit("")) for k, c in names.items() if c in records.columns], F.lit("\r\n"), "block")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files, one a partition."""
    records.select(_record(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of text blocks: headers as a map, the block, and `whole` (its length and digest hold)."""
    raw = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).where("value <> ''")
    head, rest = F.substring_index("value", "\r\n\r\n", 1), F.expr("substring(value, instr(value, '\r\n\r\n') + 4)")
    pairs = F.transform(F.split(head, "\r\n"), lambda x: F.struct(F.lower(F.substring_index(x, ": ", 1)), F.regexp_replace(x, "^[^:]*: ", "")))
    df = raw.select(F.map_from_entries(pairs).alias("headers"), F.regexp_replace(rest, "\r\n\r\n$", "").alias("block"))
    return df.withColumn("whole", (F.octet_length("block") == F.col("headers")["content-length"].cast("int")) & (digest(F.col("block")) == F.col("headers")["warc-block-digest"]))
