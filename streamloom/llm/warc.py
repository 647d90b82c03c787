"""WARC derivatives: metadata and plain-text conversion records from response records.

From each response two records follow: a metadata record with the source's WARC and HTTP headers, title, meta tags and
links as JSON, and a conversion record with the page's plain text. Both name the response by WARC-Refers-To and keep its
target URI, date and payload digest; their ids are uuid5 of the response's id, so a second run gives the same records. Text
is that of the entity: chunked, gzip and deflate codings are undone.

Scale: one pass by Arrow batches, a record at a time, without a shuffle. `read_warc` splits files into records where the
file is read; a file (by custom about 1 GB) is one task.

Defined results: records other than responses are passed over. A response without an HTTP head or with a broken one has status
null and all of its block as payload. Missing headers are null; a digest that is given but does not agree with the payload
gives digest_ok false, and one in an unknown form null (base 32 and hexadecimal digits of SHA-1, SHA-256, SHA-512 and MD5 are known). A response
without a record id has derivatives with ids from its place and content, and an empty WARC-Refers-To. A broken record gives a row of
kind 'error' and the records after it are read. Null html is an empty payload, a null url an empty target. Repeated rows repeat; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as _html
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
#: Bytes of records in a batch that is put out.
BATCH_BYTES = 32 << 20
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|table|tr|td|th|section|article|aside|header|footer|nav|main|form|blockquote|pre|title|dl|dt|dd|figure)\b[^>]*>", re.I)
#: A tag begins with a letter, a slash or a mark; any other "<" is text.
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<[!?][^>]*>")
_BLANK, _LINES = re.compile(r"[ \t\r\f\v]+"), re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length and the block's digest are added. Line breaks in values would break the head and become spaces."""
    lines = [(k, re.sub(r"[\r\n]+", " ", v)) for k, v in headers]
    lines += [("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, names)))}>"


def response(page_id, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url)), ("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    return record(head, http + payload)


def _head(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return first, out


def _unzipped(data: bytes) -> tuple[bytes, bool]:
    """The bytes of gzip members one after another, and whether the last one is whole."""
    out, whole = [], True
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
            out.append(d.flush())
        except zlib.error:
            return b"".join(out), False
        whole, data = d.eof, d.unused_data
    return b"".join(out), whole and not data.strip(b"\0")


def records(data: bytes, broken: list | None = None):
    """(headers, block) of each record in the bytes of a WARC file, gzipped or not.

    After a broken record reading goes on at the next one that can be found; broken gets (offset, reason) for each.
    """
    broken = [] if broken is None else broken
    cut_short = False
    if data[:2] == b"\x1f\x8b":
        data, whole = _unzipped(data)
        cut_short = not whole
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            break
        end = data.find(b"\r\n\r\n", at)
        reason, size = None, 0
        if not data.startswith(b"WARC/", at):
            reason = "no WARC head"
        elif end < 0:
            reason = "the head is cut short"
        else:
            _, headers = _head(data[at:end])
            given = next((v for k, v in headers if k.lower() == "content-length"), "")
            size = int(given) if given.isascii() and given.isdigit() else -1
            reason = "no Content-Length" if size < 0 else "the block is cut short" if end + 4 + size > len(data) else None
        if reason is None:
            yield headers, data[end + 4 : end + 4 + size]
            at = end + 4 + size
            continue
        broken.append((at, reason))
        following = data.find(b"\r\n\r\nWARC/", at + 1)
        if following < 0:
            break
        at = following + 4
    if cut_short:
        broken.append((len(data), "the gzip stream is broken"))


def _dechunked(body: bytes) -> bytes:
    """The body without its chunk sizes; as it is if they do not hold."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return body
        if n < 0 or end + 2 + n > len(body):
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def content(payload: bytes, http: list[tuple[str, str]]) -> bytes:
    """The entity behind the codings that the HTTP head names (chunked, gzip, deflate); as it is where one does not hold or is unknown."""
    given = {k.lower(): v.lower() for k, v in http}
    if "chunked" in given.get("transfer-encoding", ""):
        payload = _dechunked(payload)
    for coding in reversed([c.strip() for c in given.get("content-encoding", "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif coding == "deflate":
                payload = zlib.decompress(payload) if payload[:1] == b"\x78" else zlib.decompress(payload, -15)
        except (OSError, EOFError, zlib.error):
            return payload
    return payload


def digest_agrees(given: str | None, payload: bytes) -> bool | None:
    """Whether a digest (an algorithm and base 32 or hexadecimal digits) is that of payload; None if none is given or its form is unknown."""
    name, mark, value = (given or "").partition(":")
    name = name.lower().replace("-", "")
    if not mark or name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    actual = hashlib.new(name, payload).digest()
    if value.lower() == actual.hex():
        return True
    if value.rstrip("=").upper() == base64.b32encode(actual).decode().rstrip("="):
        return True
    sizes = (2 * len(actual), len(base64.b32encode(actual).rstrip(b"=")))
    return False if len(value.rstrip("=")) in sizes else None


def plain_text(html: str) -> str:
    """All text, a line for each block."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", html)))
    return _LINES.sub("\n", _BLANK.sub(" ", _html.unescape(text))).strip()


def described(html: str) -> dict:
    shown = _DROP.sub(lambda m: m[0][: m[0].find(">") + 1] if (m[1] or "").lower() == "script" else "", html)
    title = _TITLE.search(shown)
    metas = [{k.lower(): _html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(m)} for m in _META.findall(shown)]
    links = [{"tag": t.lower(), "url": _html.unescape(u.strip("\"'"))} for t, u in _LINK.findall(shown)]
    return {"title": _BLANK.sub(" ", _html.unescape(title[1])).strip() if title else None, "metas": metas, "links": links}


def derive(headers: list[tuple[str, str]], block: bytes, place: str = "") -> list[dict] | None:
    """The metadata and the conversion record of a response, with what they hold; None for another record.

    place tells a response that has no record id: its ids are made of it and of what the record holds.
    """
    get = {k.lower(): v for k, v in headers}
    if get.get("warc-type", "").lower() != "response":
        return None
    cut = block.find(b"\r\n\r\n")
    status, http, payload = None, [], block
    if block.startswith(b"HTTP/") and cut >= 0:
        line, http = _head(block[:cut])
        payload = block[cut + 4 :]
        code = line.split(" ")[1:2]
        status = int(code[0]) if code and code[0].isdigit() else None
    given, actual = get.get("warc-payload-digest"), sha1(payload)
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html")
    charset = _CHARSET.search(kind)
    entity = content(payload, http)
    try:
        page = entity.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = entity.decode("utf-8", "replace")
    is_html = "html" in kind.lower()
    source, target, date = get.get("warc-record-id"), get.get("warc-target-uri", ""), get.get("warc-date", DATE)
    about = described(page) if is_html else {"title": None, "metas": [], "links": []}
    text = plain_text(page) if is_html else page
    envelope = {"warc-headers": headers, "http-status": status, "http-headers": http, "payload-digest": given or actual, "payload-length": len(payload), "html": about}
    out = []
    for name, body, mime in (("metadata", json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace"), "application/json"), ("conversion", text.encode("utf-8", "replace"), "text/plain; charset=utf-8")):
        rid = record_id(name, source) if source else record_id(name, place, target, date, actual)
        head = [("WARC-Type", name), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source or ""), ("WARC-Source-Payload-Digest", given or actual), ("Content-Type", mime)]
        out.append({"kind": name, "record_id": rid, "refers_to": source, "target_uri": target, "date": date, "content_type": mime, "content_length": len(body), "block_digest": sha1(body), "payload_digest": given or actual, "digest_ok": digest_agrees(given, payload), "http_status": status, "n_source_headers": len(headers), "n_links": len(about["links"]), "n_chars": len(text), "error": None, "record": record(head, body)})
    return out


_KINDS = {"kind": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "date": pa.string(), "content_type": pa.string(), "content_length": pa.int64(), "block_digest": pa.string(), "payload_digest": pa.string(), "digest_ok": pa.bool_(), "http_status": pa.int32(), "n_source_headers": pa.int32(), "n_links": pa.int32(), "n_chars": pa.int64(), "error": pa.string(), "record": pa.binary()}
DERIVED = "kind string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, digest_ok boolean, http_status int, n_source_headers int, n_links int, n_chars long, error string, record binary"


def derivatives(df: DataFrame, column: str = "record", keep: str = "page_id", with_records: bool = True) -> DataFrame:
    """keep and DERIVED for each response in a binary column that holds one or more records. with_records: also the records' bytes.

    A broken record gives a row of kind 'error' with error and the offset in content_length, and reading goes on after it. If keep has the name
    of one of DERIVED, it is put out as `source_` and that name.
    """
    kind = dict(df.dtypes)[keep]
    names = [n for n in _KINDS if with_records or n != "record"]
    schema = ", ".join(x for x in DERIVED.split(", ") if x.split()[0] in names)
    kept = f"source_{keep}" if keep in _KINDS else keep
    nothing = dict.fromkeys(_KINDS)

    def run(batches):
        for b in batches:
            held = b.column(keep).to_pylist()
            ids, rows, size = [], [], 0

            def batch():
                return pa.RecordBatch.from_arrays([b.column(keep).take(pa.array(ids, pa.int64())), *(pa.array([r[n] for r in rows], _KINDS[n]) for n in names)], names=[kept, *names])  # noqa: B023

            for i, data in enumerate(b.column(column).to_pylist()):
                broken: list = []
                for nth, (headers, block) in enumerate(records(data or b"", broken)):
                    for r in derive(headers, block, f"{held[i]}#{nth}") or ():
                        ids.append(i)
                        rows.append(r)
                        size += len(r["record"])
                    if size > BATCH_BYTES:
                        yield batch()
                        ids, rows, size = [], [], 0
                for offset, reason in broken:
                    ids.append(i)
                    rows.append(nothing | {"kind": "error", "content_length": offset, "error": reason})
            yield batch()

    return df.select(keep, column).mapInArrow(run, f"`{kept}` {kind}, {schema}")


def responses(pages: DataFrame) -> DataFrame:
    """page_id and record: each page as a response record."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for b in batches:
            made = [response(i, u, h) for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path and record (the bytes of a file's records) of WARC files, for `derivatives` with keep='path'."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("record"))
