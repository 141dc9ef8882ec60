"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CRLF = "\r\n"
_SKIPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(
    r"<(?:/?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|thead|tbody|h[1-6]|article|section|header|footer|nav|aside|"
    r"main|form|blockquote|pre|title|head|body|html|figure|figcaption)\b[^>]*|!doctype[^>]*)>", re.I)
_TAGS = re.compile(r"<(?:/?[a-zA-Z][^>]*|![^>]*|\?[^>]*)>")
_BLANKS = re.compile(r"[^\S\n]+")

DERIVED = (
    "source_id string, record_type string, record_id string, refers_to string, target_uri string, "
    "date string, content_type string, content_length long, block_digest string, problem string, record binary"
)


def record_id(*parts: Column) -> Column:
    """A ``<urn:uuid:...>`` that depends on ``parts`` alone, so a repeated task names records alike."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def responses(pages: DataFrame, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """One WARC/1.1 response record (``record binary``) for every page of (page_id, url, html).

    A null html is an empty payload; a null url leaves WARC-Target-URI out.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(_CRLF * 2)).cast("binary")
    named = pages.select(
        "page_id", "url", payload.alias("payload"), F.concat(http, payload).alias("block"),
        record_id(F.col("page_id"), F.col("url"), F.sha2(payload, 256)).alias("id"))
    uri = F.regexp_replace("url", r"[\r\n]+", "")
    head = F.concat_ws(
        _CRLF, F.lit("WARC/1.1"), F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), "id"), F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2("block", 256)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2("payload", 256)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")), F.lit(_CRLF))
    end = F.lit(_CRLF * 2).cast("binary")
    return named.select("page_id", F.concat(head.cast("binary"), "block", end).alias("record"))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case; the version under '') and block of one record."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(_CRLF)
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {"": lines[0]}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("wrong content length")
    return fields, rest[:-4]


def digest_ok(said: str | None, data: bytes) -> bool:
    """True where no sha256 digest is given, or the given one holds."""
    return not (said or "").startswith("sha256:") or said[7:] == hashlib.sha256(data).hexdigest()


def _without(tags: re.Pattern, put: str, text: str) -> str:
    """Every tag replaced, in linear time: none ends after the last ``>``, and before it each that begins also ends."""
    end = text.rfind(">") + 1
    return tags.sub(put, text[:end]) + text[end:]


def plain_text(page: str) -> str:
    """Visible text: scripts, styles and comments go, blocks end lines, entities are read."""
    text = _without(_TAGS, "", _without(_BREAKS, "\n", _SKIPPED.sub(" ", page)))
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(text).replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


def _urn(*parts: str) -> str:
    h = hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _built(kind: str, rid: str, source: dict[str, str], content_type: str, block: bytes, extra: list[str]) -> dict:
    digest = "sha256:" + hashlib.sha256(block).hexdigest()
    refers = source.get("warc-record-id", "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Refers-To: {refers}"]
    if "warc-target-uri" in source:
        head.append(f"WARC-Target-URI: {source['warc-target-uri']}")
    head += [f"WARC-Date: {source.get('warc-date', '')}", f"WARC-Block-Digest: {digest}", *extra,
             f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return {
        "record_type": kind, "record_id": rid, "refers_to": refers, "target_uri": source.get("warc-target-uri"),
        "date": source.get("warc-date"), "content_type": content_type, "content_length": len(block),
        "block_digest": digest, "record": _CRLF.join(head).encode() + block + b"\r\n\r\n", "problem": None,
    }


def derivatives(record: bytes | None) -> list[dict]:
    """The metadata and conversion records of one response record.

    Metadata (application/warc-fields) links the conversion and keeps the source's
    digests, content type, status line and HTTP headers. A record that is null, no
    response, or broken (header, length or digest) gives one row with a ``problem``
    and no record.
    """
    try:
        if record is None:
            raise ValueError("no record")
        source, block = parse_record(record)
        if source.get("warc-type") != "response":
            raise ValueError("not a response")
        head, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no HTTP header")
        if not digest_ok(source.get("warc-block-digest"), block) or not digest_ok(source.get("warc-payload-digest"), payload):
            raise ValueError("digest mismatch")
    except ValueError as exc:
        return [{"record_type": None, "problem": str(exc)}]
    status, *http = head.decode("utf-8", "replace").split(_CRLF)
    charset = re.search(r"(?i)^content-type:.*charset=\"?([\w-]+)", "\n".join(http), re.M)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    refers = source.get("warc-record-id", "")
    conversion_id, metadata_id = _urn(refers, "conversion"), _urn(refers, "metadata")
    fields = [("conversion-id", conversion_id), ("source-block-digest", source.get("warc-block-digest", "")),
              ("source-payload-digest", source.get("warc-payload-digest", "")),
              ("source-content-type", source.get("content-type", "")), ("http-status", status),
              *(("http-header", line) for line in http)]
    listed = "".join(f"{k}: {v}{_CRLF}" for k, v in fields).encode()
    kept = [f"WARC-Source-Payload-Digest: {source['warc-payload-digest']}"] if "warc-payload-digest" in source else []
    return [
        _built("metadata", metadata_id, source, "application/warc-fields", listed, []),
        _built("conversion", conversion_id, source, "text/plain; charset=utf-8", plain_text(page).encode(),
               [f"WARC-Concurrent-To: {metadata_id}", *kept]),
    ]


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in DERIVED.split(", ")])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for sid, record in zip(batch.column(0), batch.column(1), strict=True):
            made = derivatives(record.as_py())
            rows += [dict.fromkeys(_SCHEMA.names) | row | {"source_id": sid.as_py()} for row in made]
            size += sum(len(row.get("record") or b"") for row in made)
            if size > 8 << 20:  # small batches, whatever the records' sizes
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def derive(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Linked metadata and conversion records for every response record; no shuffle.

    Every row is handled alone: repeated rows give repeated records of equal ids,
    nulls and broken records a row with a ``problem``, an empty table no rows.
    """
    return records.select(F.col(id_col).cast("string").alias("id"), F.col(record_col).alias("record")).mapInArrow(
        _derive, DERIVED)
