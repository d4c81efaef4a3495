"""WARC archives: writing with chunked framing and segments, reading back with reassembly.

A page becomes an HTTP response whose body uses chunked transfer framing. Blocks above ``SEGMENT`` bytes are
cut: the first part is the response record, the others are continuation records that name it as their
origin; the last carries the total length. The reader groups parts by origin, orders them by number, checks
that none is missing and that the lengths add up, and takes the chunk framing off.

Files are written by Spark's text sink, whose line separator is the four bytes that end a WARC record, and
read by its binary source; a file holds at most ``RECORDS`` records, so at most RECORDS * SEGMENT bytes.

Equal payloads of at least ``REVISIT_BYTES`` are stored once, with the page of the largest id; the others are
revisit records. Nulls: null html is an empty payload; a null page_id is always a response and never referred
to. A row repeated with its id is archived again: as a revisit of the first if its payload is large, else as a
response. Empty tables give empty archives. Other columns than the named ones are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortry.llm.common import keep, scratch

SEGMENT = 32 * 1024
CHUNK = 8 * 1024
RECORDS = 2048
REVISIT_BYTES = 1000
_PER_BATCH = 256
#: Line end, record end and field names of the format.
EOL, END = b"\r\n", "\r\n\r\n"
_HTTP = EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Transfer-Encoding: chunked", b"", b""])
_PARSED = "record_id string, page_id long, kind string, digest string, refers string, number int, total long, block binary, payload_bytes long, found string, status string"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for lo in range(0, len(payload), size):
        piece = payload[lo : lo + size]
        parts += [b"%x" % len(piece), EOL, piece, EOL]
    return b"".join([*parts, b"0", EOL, EOL])


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(EOL, at)
        if line < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != EOL:
            raise ValueError("chunk shorter than announced")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, found, body = block.partition(EOL + EOL)
    if not found:
        raise ValueError("no end of the HTTP header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its final four bytes, which the file sink adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))])]
    return "\r\n".join(lines).encode() + EOL + EOL + block


def records_of(page_id, url, payload: bytes, digest: str, nth: int, winner, segment: int = SEGMENT) -> list[bytes]:
    """All records of one page; ``winner`` is the record id a revisit refers to, None for a response."""
    own = f"<urn:page:{'' if page_id is None else page_id}:{digest}:{nth}>"
    target = " ".join((url or f"urn:page:{page_id}").split())
    about = [("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if winner is not None:
        return [record([("WARC-Type", "revisit"), *about, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", winner)], _HTTP)]
    block = _HTTP + chunked(payload)
    kind = [("WARC-Type", "response"), *about, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [record(kind, block)]
    out = []
    for k, lo in enumerate(range(0, len(block), segment), 1):
        part = block[lo : lo + segment]
        if k == 1:
            fields = [*kind, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k)]
        if lo + segment >= len(block):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record(fields, part))
    return out


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record set per page as gzipped archives into ``folder``."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    small = keep(rows.select("page_id", "digest", F.octet_length("payload").alias("n")), "payloads")
    shared = small.where((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    winners = keep(shared.select(F.col("digest").alias("d"), "winner"), "winners")
    if small.groupBy("page_id", "digest").count().where("count > 1").limit(1).count():
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    joined = rows.join(winners, F.col("digest") == F.col("d"), "left")

    @F.pandas_udf("array<binary>")
    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for p in parts:
            out = []
            for i, u, b, d, n, w in zip(p["page_id"], p["url"], p["payload"], p["digest"], p["nth"], p["winner"], strict=True):
                i, w = (None if pd.isna(x) else int(x) for x in (i, w))
                first = w is None or i is None or (i == w and n == 1)
                out.append(records_of(i, None if pd.isna(u) else u, bytes(b), d, int(n), None if first else f"<urn:page:{w}:{d}:1>"))
            yield pd.Series(out)

    made = joined.select(F.explode(build(F.struct("page_id", "url", "payload", "digest", "nth", "winner"))).alias("record"))
    made.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of a gzipped or plain archive."""
    raw = io.BytesIO(content)
    with gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw as file:
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("a record must start with its version")
            fields = {}
            while (line := file.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            yield fields, file.read(int(fields["content-length"]))


def _whole(block: bytes) -> tuple[int | None, str | None, str]:
    try:
        payload = payload_of(block)
    except ValueError as error:
        return None, None, str(error)
    return len(payload), hashlib.sha1(payload).hexdigest(), "ok"


def _records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    rows: list[tuple] = []
    for frame in parts:
        for content in frame["content"]:
            for fields, block in parse(content):
                own, number = fields["warc-record-id"], fields.get("warc-segment-number")
                page = own.split(":")[2]
                total = fields.get("warc-segment-total-length")
                kind = fields["warc-type"]
                size, found, status = (None, None, "ok") if number or kind != "response" else _whole(block)
                rows.append((fields.get("warc-segment-origin-id", own), int(page) if page else None, kind, fields.get("warc-payload-digest", "").partition(":")[2] or None, fields.get("warc-refers-to"), int(number) if number else None, int(total) if total else None, block if number else None, size, found, status))
                if len(rows) >= _PER_BATCH:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "number": "Int32", "total": "Int64", "payload_bytes": "Int64"})
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "number": "Int32", "total": "Int64", "payload_bytes": "Int64"})


def _assemble(segments: pd.Series, total: pd.Series) -> pd.DataFrame:
    out = []
    for parts, length in zip(segments, total, strict=True):
        if parts is None or not len(parts):
            out.append((None, None, None))
            continue
        by_number = {int(p["number"]): bytes(p["block"]) for p in parts}
        block = b"".join(by_number[k] for k in sorted(by_number))
        if sorted(by_number) != list(range(1, len(by_number) + 1)) or pd.isna(length):
            out.append((None, None, "segment missing"))
        elif len(block) != int(length):
            out.append((None, None, "total length differs"))
        else:
            out.append(_whole(block))
    return pd.DataFrame(out, columns=["payload_bytes", "found", "status"]).astype({"payload_bytes": "Int64"})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored response or revisit.

    page_id, payload_bytes, payload_digest, record_type, refers_to, segments, status. ``status`` is ok, or
    says what is broken; then payload_bytes is null. A record's segments meet in one list, which is one
    payload long.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    parts = files.mapInPandas(_records, _PARSED)
    piece = F.when(F.col("number").isNotNull(), F.struct("number", "block"))
    # one row is the head of its record: the unsegmented one, or segment one
    head = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c)))
    grouped = parts.groupBy("record_id").agg(*[head(c).alias(c) for c in ("page_id", "kind", "digest", "refers", "payload_bytes", "found", "status")], F.max("total").alias("total"), F.collect_list(piece).alias("pieces"))
    assemble = F.pandas_udf(_assemble, "payload_bytes long, found string, status string")
    built = grouped.withColumn("b", assemble("pieces", "total"))
    whole = built.select(
        "record_id", "page_id", F.col("kind").alias("record_type"), F.col("digest").alias("payload_digest"), "refers",
        F.coalesce("b.payload_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("b.found", "found").alias("found"),
        F.coalesce("b.status", "status", F.lit("head missing")).alias("status"), F.greatest(F.size("pieces"), F.lit(1)).alias("segments"),
    )
    stored = keep(whole, "records")
    refers_page = F.when(F.col("refers").isNotNull(), F.split_part("refers", F.lit(":"), F.lit(3)).cast("bigint"))
    plain = stored.where(F.col("record_type").isNull() | (F.col("record_type") != "revisit"))
    broken = F.when((F.col("status") == "ok") & (F.col("found") != F.col("payload_digest")), F.lit("digest differs")).otherwise(F.col("status"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "status"]
    responses = plain.withColumns({"status": broken, "refers_to": F.lit(None).cast("bigint")}).select(*columns)
    targets = plain.select(F.col("record_id").alias("t"), F.col("payload_bytes").alias("bytes_there"), F.col("found").alias("found_there"))
    again = stored.where("record_type = 'revisit'").drop("payload_bytes", "status").join(targets, F.col("refers") == F.col("t"), "left")
    state = F.when(F.col("t").isNull(), F.lit("target missing")).when(F.col("found_there") != F.col("payload_digest"), F.lit("digest differs")).otherwise(F.lit("ok"))
    revisits = again.withColumns({"payload_bytes": F.col("bytes_there"), "refers_to": refers_page, "status": state}).select(*columns)
    return responses.union(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)
