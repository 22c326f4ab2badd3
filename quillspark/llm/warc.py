"""WARC archives: writing captures, reading them back, and assembling the records
of a transaction (request, response or revisit, metadata) through their
WARC-Concurrent-To identifiers into one nested row per capture.

Archives are written by Spark's own writer, one record after another, and so
land on any file system; a record ends with the two line breaks that the format
asks for, which are the writer's separator.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, Workspace, join_counted, keyed

END = "\r\n\r\n"
#: Payload bytes of one archive file, by the mean of all records; files are read
#: whole by one task, compressed, and unpacked piece by piece.
FILE_BYTES = 32 << 20
#: Records of one archive file at most.
FILE_RECORDS = 1_500
#: Payloads of fewer bytes are never made revisits.
MIN_BYTES = 0
_DATE = "1970-01-01T00:00:00Z"
_SCHEMA = (
    "record_id string, concurrent_to string, type string, uri string, digest string, refers_to string, payload_bytes long, http string, payload binary, intact boolean"
)


def _digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record(kind: str, rid: str, uri: str, extra: list[tuple[str, str]], mime: str, block: str) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), *extra, ("Content-Type", mime), ("Content-Length", str(len(block.encode())))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value or "").strip()


def _records(batches):
    """Rows (row, id, uri, html, revisits, response's id) -> three records each.
    Identifiers are made of the row's number."""
    for batch in batches:
        out, held = [], 0
        for i in range(batch.num_rows):
            row, page, uri, html, refers, other = (batch.column(c)[i].as_py() for c in range(6))
            payload, uri = (html or "").encode(), _clean(uri)
            size = len(payload)
            base = f"urn:capture:{row}"
            host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", uri)
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
            extra = [("WARC-Payload-Digest", f"sha1:{_digest(payload)}")]
            fields = [("payload-bytes", size), ("page-id", page), ("refers-to-page-id", other)]
            if refers is not None:
                extra += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:capture:{refers}:main>")]
            main = f"{base}:main"
            tie = [("WARC-Concurrent-To", f"<{main}>")]
            get = f"GET {uri} HTTP/1.1\r\nHost: {host[1] if host else ''}\r\n\r\n"
            out += [
                _record("response" if refers is None else "revisit", main, uri, extra, "application/http; msgtype=response", http + ((html or "") if refers is None else "")),
                _record("request", f"{base}:request", uri, tie, "application/http; msgtype=request", get),
                _record("metadata", f"{base}:metadata", uri, tie, "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)),
            ]
            held += size
            if held > 8 << 20:
                yield pa.record_batch([pa.array(out, pa.string())], ["value"])
                out, held = [], 0
        yield pa.record_batch([pa.array(out, pa.string())], ["value"])


def write(pages: DataFrame, path: str, ws: Workspace, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write request, response (or revisit) and metadata of every row.

    Of payloads that are equal (same SHA-256 and size) and have ``min_bytes`` bytes
    at least, the one with the smallest id is the response and the others revisit
    it.  Null payloads count as empty; rows that repeat or lack an id are captures of
    their own, null ids rank last; an empty table gives an archive without records;
    only the three columns are read.
    """
    pages = keyed(pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), F.col(html_col).alias("html")), ws, "id")
    body = F.coalesce("html", F.lit(""))
    told = ws.keep(pages.select(F.col(ROW).alias("row"), "id", F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("sha")), "described")
    first = told.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.min(F.struct("row", "id")).alias("first"), F.count("*").alias("n"))
    # unique payloads refer to nothing: only shared ones travel
    first = ws.keep(first.where("n > 1").select("sha", "bytes", "first"), "first")
    revisits = join_counted(told, first, ["sha", "bytes"]).where("row <> first.row")
    revisits = ws.keep(revisits.select(F.col("row").alias(ROW), F.col("first.row").alias("refers"), F.col("first.id").alias("other")), "revisits")
    rows = join_counted(pages, revisits, ROW, "left").select(F.col(ROW).alias("row"), "id", "uri", "html", "refers", "other")
    mean = told.agg(F.avg("bytes")).first()[0] or 0
    records = 3 * max(1, min(FILE_RECORDS // 3, int(FILE_BYTES / (mean + 1))))
    rows.mapInArrow(_records, "value string").write.option("lineSep", END).option("maxRecordsPerFile", records).option("compression", "gzip").mode("overwrite").text(path)


def _inflated(data: bytes):
    """Pieces of an archive file, unpacked if it is made of gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    z = zlib.decompressobj(31)
    for at in range(0, len(data), 256 << 10):
        rest = data[at : at + (256 << 10)]
        while rest:
            yield z.decompress(rest)
            rest = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)


def parse(pieces):
    """Records of an unpacked archive (bytes, or an iterable of pieces of it) as
    ``(headers, block)``; headers have lower-case names.  One record is held at a
    time.  What is no WARC record, or ends within one, raises ValueError."""
    held, more, at = bytearray(), iter([pieces] if isinstance(pieces, bytes) else pieces), 0

    def fill(n: int) -> bool:
        nonlocal at
        while len(held) - at < n:
            new = next(more, None)
            if new is None:
                return False
            if at:
                del held[:at]
                at = 0
            held.extend(new)
        return True

    while fill(1):
        if fill(5) and held[at : at + 5] != b"WARC/" or len(held) - at < 5:
            raise ValueError("no WARC record where one should begin")
        end = held.find(b"\r\n\r\n", at)
        while end < 0:
            if not fill(len(held) - at + 1):
                raise ValueError("the archive ends within a record's headers")
            end = held.find(b"\r\n\r\n", at)
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", "x"))
        at, whole = end + 4, size + 4
        if not fill(whole):
            raise ValueError("the archive ends within a record")
        yield headers, bytes(held[at : at + size])
        at += whole


def _parsed(batches):
    names = ["record_id", "concurrent_to", "type", "uri", "digest", "refers_to", "payload_bytes", "http", "payload", "intact"]
    kinds = (pa.string(),) * 6 + (pa.int64(), pa.string(), pa.binary(), pa.bool_())
    strip = lambda v: v.strip("<>") if v else None
    for batch in batches:
        for content in batch.column(0):
            out, held = tuple([] for _ in names), 0
            for head, block in parse(_inflated(content.as_py())):
                kind = head["warc-type"]
                http, payload = (block.partition(b"\r\n\r\n")[::2]) if kind in ("response", "revisit", "request") else (b"", block)
                length = re.search(r"(?im)^content-length: *(\d+)", http.decode("latin-1"))
                digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                size, intact = int(length[1]) if length else len(payload), None
                if kind == "response" and digest:
                    intact = size == len(payload) and digest == _digest(payload)
                row = (strip(head.get("warc-record-id")), strip(head.get("warc-concurrent-to")), kind, head.get("warc-target-uri"), digest, strip(head.get("warc-refers-to")), size, http.decode("utf-8", "replace"), payload, intact)
                for col, v in zip(out, row):
                    col.append(v)
                held += len(payload)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out, held = tuple([] for _ in names), 0
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``.  ``intact`` tells whether the
    payload of a response has the size and the digest that its headers state; it is
    null where there is no payload to check.  Malformed files raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(_parsed, _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``main`` (the response or revisit), ``request``
    and ``metadata``, which name the main record as concurrent.

    A capture has a few records, so its group is bounded; missing parts are
    null, records whose main record is missing form a row without ``main``, and
    the last of several parts of one kind in digest and payload order stays.
    """
    part = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), F.col("rec")))
    rec = F.struct("record_id", "type", "uri", "digest", "refers_to", "payload_bytes", "http", "payload", "intact")
    rows = records.withColumn("capture", F.coalesce("concurrent_to", "record_id")).withColumn("rec", rec)
    return rows.groupBy("capture").agg(part("response", "revisit").alias("main"), part("request").alias("request"), part("metadata").alias("metadata"))
