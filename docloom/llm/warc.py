"""WARC derivatives: metadata and plain-text conversion records from response records.

A response record is parsed (its WARC header, HTTP header and payload), and two
records are built from it: a metadata record with the source's headers and digests
as ``application/warc-fields``, and a conversion record with the page's plain text.
Both name the response in WARC-Refers-To, carry its target and date, and name each
other in WARC-Concurrent-To; their identifiers are derived from the response's, so a
rerun builds the same records.

Results for odd input: null rows and records of other types give no derivatives; a
record that cannot be read gives one row of type ``error`` with the reason; header
names are matched without case, repeated headers keep all values; a payload of a
charset that isn't known is read as UTF-8 with replacements; an empty payload gives
an empty text; repeated rows give repeated records with the same identifiers.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

VERSION = b"WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_ANY = re.compile(r"<[!?/a-zA-Z][^>]*>")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length is added."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in b" \t" and line and out:  # a folded line goes on with the last value
            out[-1] = (out[-1][0], out[-1][1] + " " + line.decode("utf-8", "replace").strip())
        elif b":" in line:
            k, v = line.split(b":", 1)
            out.append((k.decode("utf-8", "replace").strip(), v.decode("utf-8", "replace").strip()))
    return out


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of a record; raises ValueError with the reason if it can't be read."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    headers = _headers(lines[1:])
    length = get(headers, "Content-Length") or ""
    if not length.isdigit():
        raise ValueError("no content length")
    if len(rest) < int(length):
        raise ValueError(f"{int(length) - len(rest)} bytes are missing")
    return headers, rest[: int(length)]


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of a response; a block without an HTTP header is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.split(b"\r\n")
    return lines[0].decode("latin-1"), _headers(lines[1:]), payload


def is_charset(name: str) -> bool:
    """Whether a name is that of an encoding of text that the web knows (and not of a transformation, nor of one that takes no faults)."""
    try:
        found = codecs.lookup(name).name
        "".encode(found)
    except (LookupError, UnicodeError, ValueError, TypeError):
        return False
    return not re.fullmatch(r"idna|punycode|undefined|mbcs|oem|utf-7|(raw_|raw-)?unicode[-_]escape|rot13|.*[-_]codec", found)


def plain_text(payload: bytes, charset: str | None = None) -> str:
    """The text of a page: a line for each block, blanks collapsed, empty lines left out."""
    if charset is None:
        found = _CHARSET.search(payload[:2048])
        charset = found[1].decode() if found else "utf-8"
    page = payload.decode(charset if is_charset(charset) else "utf-8", "replace")
    # blanks of the page are one blank; what remains of line ends are block ends
    page = _ANY.sub("", _BREAK.sub("\n", _RAW.sub(" ", page).replace("\n", " ").replace("\r", " ")))
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def derive(data: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record, as rows of ``FIELDS``."""
    try:
        headers, block = parse(data)
    except ValueError as error:
        return [dict.fromkeys(FIELDS) | {"type": "error", "reason": str(error)}]
    if (get(headers, "WARC-Type") or "").lower() != "response":
        return []
    source, target, date = (get(headers, f"WARC-{x}") for x in ("Record-ID", "Target-URI", "Date"))
    status, fields, payload = http(block)
    kind = get(fields, "Content-Type") or ""
    charset = _CHARSET.search(kind.encode())
    text = plain_text(payload, charset[1].decode() if charset else None).encode("utf-8", "replace")
    block_digest, payload_digest = get(headers, "WARC-Block-Digest") or digest(block), get(headers, "WARC-Payload-Digest") or digest(payload)
    ids = {t: f"<urn:uuid:{uuid.uuid5(SPACE, f'{t} {source}')}>" for t in ("metadata", "conversion")}
    info = [("source-record-id", source), ("source-status", status), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-length", str(len(payload))), ("text-length", str(len(text)))]
    info += [(f"source-header-{k}", v) for k, v in fields]
    blocks = {"metadata": b"".join(f"{k}: {v or ''}\r\n".encode("utf-8", "replace") for k, v in info), "conversion": text}
    out = []
    for t, content, other in (("metadata", "application/warc-fields", "conversion"), ("conversion", "text/plain; charset=utf-8", "metadata")):
        own = [("WARC-Type", t), ("WARC-Record-ID", ids[t]), ("WARC-Refers-To", source), ("WARC-Concurrent-To", ids[other]), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(blocks[t])), ("Content-Type", content)]
        out.append({"type": t, "record_id": ids[t], "refers_to": source, "target_uri": target, "date": date, "source_payload_digest": payload_digest, "block_digest": digest(blocks[t]), "record": record([x for x in own if x[1]], blocks[t]), "block": blocks[t].decode(), "reason": None})
    return out


FIELDS = ("type", "record_id", "refers_to", "target_uri", "date", "source_payload_digest", "block_digest", "record", "block", "reason")
_ROW = T.StructType([T.StructField(n, T.BinaryType() if n == "record" else T.StringType()) for n in FIELDS])


def derivatives(df: DataFrame, keys: list[str], warc: str = "warc") -> DataFrame:
    """``keys`` and the fields of each derivative of the records in the binary column ``warc``. No shuffle."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_ROW)

    def run(batches):
        for batch in slices(batches, "__warc"):
            at, rows = [], []
            for i, data in enumerate(batch.column(len(keys)).to_pylist()):
                found = derive(data) if data is not None else []
                at += [i] * len(found)
                rows += found
            made = pa.array(rows, kind)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], made], names=[*(f"k{i}" for i in range(len(keys))), "made"])

    schema = T.StructType([*(T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)), T.StructField("made", _ROW)])
    out = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(warc).alias("__warc")).mapInArrow(run, schema)
    # a key that is called like a field has an underscore before its name
    return out.select(*(F.col(f"k{i}").alias(f"_{k}" if k.lower() in FIELDS else k) for i, k in enumerate(keys)), "made.*")


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(key, warc): each page as the response record of a fetch at ``date`` (null pages: empty payload)."""
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches, "page"):
            out = []
            for i, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (p or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                own = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, f'{i} {u}')}>"), ("WARC-Target-URI", u), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
                out.append(record([x for x in own if x[1]], block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "warc"])

    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("warc", T.BinaryType())])
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Both derivatives of every page."""
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), ["page_id"])
    return made.select("page_id", "type", "record_id", "refers_to", "target_uri", "date", "source_payload_digest", "block_digest", F.octet_length("record").cast("long").alias("record_bytes"), F.col("block").alias("content"), "reason")
