"""WARC writing, reading and segment reassembly.

``write`` makes one record a page: of pages with equal payloads (of at least ``least`` bytes) that with the largest
page_id is a response, the others are revisits of it; smaller payloads are all responses. Payloads travel in chunked
transfer framing. A block longer than SEGMENT bytes is cut: a first segment and continuation records, which name the
first one's record identifier as their origin, their segment number, and, the last one, the total length. Archives are
gzip files written by Spark's own committer, in the folder given.

``read`` parses archives with a stream parser and puts segments together again: continuation records are grouped by
origin identifier, ordered by segment number, held against the total length, and their chunked framing decoded. Only
segmented records are shuffled.

Cases: null html is an empty payload; null page_id is allowed (a page with a number is preferred as the response);
repeated rows each get a record of their own; records whose header, length, numbering or framing is broken give the status
``broken`` and no payload (what follows an unreadable header in its file is one broken record); columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .io import durable

SEGMENT, CHUNK, RECORDS_PER_FILE = 16_384, 4096, 20_000
END, DATE = b"\r\n\r\n", "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[a : a + CHUNK]), payload[a : a + CHUNK]) for a in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk not closed")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page_id: int | None, url: str, html: str, refers: int | None, refers_url: str | None, revisit: bool, serial: int) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end each."""
    payload = html.encode()
    name = f"<urn:page:{'' if page_id is None else page_id}:{serial}>"
    clean = lambda u: "".join(c for c in u if c > " ")
    uri = clean(url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page", "" if page_id is None else page_id), ("X-Payload-Length", len(payload))]
    if revisit:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", clean(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-Page", refers)]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *more], b"")
        return
    block = _HTTP + frame(payload)
    parts = [block[a : a + SEGMENT] for a in range(0, len(block), SEGMENT)]
    for k, part in enumerate(parts, 1):
        own = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("Content-Type", "application/http; msgtype=response")] if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", name)]
        if len(parts) > 1:
            own.append(("WARC-Segment-Number", k))
            if k == len(parts):
                own.append(("WARC-Segment-Total-Length", len(block)))
        yield _record([*own, *common], part)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of a plain or gzip archive; no fields where a header is broken."""
    while archive[:2] == b"\x1f\x8b":
        out, rest = [], archive
        while rest:
            d = zlib.decompressobj(31)
            out.append(d.decompress(rest))
            rest = d.unused_data
        archive = b"".join(out)
    at = 0
    while at < len(archive):
        head = archive.find(END, at)
        lines = archive[at : max(head, at)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdecimal():
            yield {}, archive[at:]
            return
        n = int(fields["content-length"])
        yield fields, archive[head + 4 : head + 4 + n]
        at = head + 4 + n + len(END)


def payload_of(block: bytes) -> bytes | None:
    """The payload of a whole HTTP response block; None if its framing is broken."""
    try:
        return unframe(block[block.index(END) + 4 :])
    except ValueError:
        return None


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    ship(pages.sparkSession)
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("long", F.octet_length("html") >= least)
    # One row a payload that occurs more than once: the others can only be responses.
    twin = p.where("long").groupBy(F.col("sha").alias("k")).agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1").select("k", F.col("top.page_id").alias("first"), F.col("top.url").alias("first_url"))
    p = p.join(twin, (F.col("sha") == F.col("k")) & F.col("long"), "left")
    revisit = F.col("k").isNotNull() & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.select("page_id", "url", "html", "first", "first_url", revisit.alias("revisit"), F.monotonically_increasing_id().alias("serial"))

    def run(batches):
        for rb in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                for r in records(*row):
                    out.append(r)
                    size += len(r)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = p.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_PARSED = "page_id long, record_type string, refers_to long, origin string, segment int, total long, stated string, stated_bytes long, block binary, payload_bytes long, payload_digest string, status string"


def _readable(h: dict[str, str]) -> bool:
    """Whether a record has the fields that its kind needs, numbers where numbers belong."""
    whole = lambda k: h.get(k, "0").removeprefix("-").isdecimal()
    needs = {"warc-type", "warc-record-id", "x-page", "warc-payload-digest", "x-payload-length"} | ({"x-refers-page"} if h.get("warc-type") == "revisit" else set())
    return needs <= h.keys() and all(whole(k) for k in ("x-payload-length", "warc-segment-number", "warc-segment-total-length", "x-refers-page")) and (not h["x-page"] or whole("x-page"))


def _parsed(batches):
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in _PARSED.split(", ")]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for rb in batches:
        for archive in rb.column(0):
            rows = []
            for h, block in parse(archive.as_py()):
                if not _readable(h):
                    rows.append((None, h.get("warc-type"), None, None, 0, None, None, None, None, None, None, "broken"))
                    continue
                page = int(h["x-page"]) if h["x-page"] else None
                stated, stated_n = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                kind, number = h["warc-type"], int(h.get("warc-segment-number", 0))
                if kind == "revisit":
                    rows.append((page, kind, int(h["x-refers-page"]), None, 0, None, stated, stated_n, None, stated_n, stated, "ok"))
                elif number:
                    rows.append((page, "response", None, h.get("warc-segment-origin-id", h["warc-record-id"]), number, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, stated, stated_n, block, None, None, None))
                else:
                    got = payload_of(block)
                    rows.append((page, "response", None, None, 0, None, stated, stated_n, None, None if got is None else len(got), None if got is None else digest(got), "broken" if got is None or digest(got) != stated else "ok"))
                if len(rows) >= 2000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)


def assemble(parts: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of (segment number, total length or None, bytes) records; None if one is missing or the length differs."""
    parts = sorted(parts, key=lambda p: p[0])
    total = next((t for _, t, _ in parts if t is not None and t == t), None)
    block = b"".join(b for _, _, b in parts)
    if [n for n, _, _ in parts] != list(range(1, len(parts) + 1)) or total is None or int(total) != len(block):
        return None
    return block


_OUT = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, status string"


def _reassembled(f: pd.DataFrame) -> pd.DataFrame:
    block = assemble(list(zip(f.segment.tolist(), [None if pd.isna(t) else int(t) for t in f.total], f.block.tolist(), strict=True)))
    got = None if block is None else payload_of(block)
    ok = got is not None and digest(got) == f.stated.iloc[0]
    row = (f.page_id.iloc[0], "response", None, None if got is None else len(got), None if got is None else digest(got), "ok" if ok else "broken")
    out = pd.DataFrame([row], columns=[x.split()[0] for x in _OUT.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and status of every page in the archives."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = durable(files.mapInArrow(_parsed, _PARSED), "warc-parsed")
    names = [x.split()[0] for x in _OUT.split(", ")]
    whole = parsed.where("origin is null").select(*names)
    pieces = parsed.where("origin is not null").select("page_id", "origin", "segment", "total", "stated", "block")
    return whole.unionByName(pieces.groupBy("origin").applyInPandas(_reassembled, _OUT))
