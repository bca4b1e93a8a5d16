"""WARC archives: writing pages, reading them back, and reassembling segmented records.

Pages become ``response`` records whose block is an HTTP message in chunked transfer framing. A block over ``segment_bytes`` is
split: the first record has segment number 1, the others are ``continuation`` records that name their origin, and the last has
the total length. Of large equal payloads one is stored, the others are ``revisit`` records that refer to it. Archives are written
by Spark's text writer with the blank lines that end a record as line separator, and gzip, so they can be on any file system.

Reading parses records as the files are unpacked, without holding a file's text. Whole records are decoded where they are;
segments are grouped by origin, put in order of their numbers, held against the total length and then decoded. Every payload is held
against its SHA-1, and a revisit against the record that it refers to.

Defined results: a null page is the empty payload; null page ids rank below all others; of rows that repeat a page id and a
payload one is the response; an empty table gives archives without pages and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, scratch_path, table, whole_text

END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK = 8192
SEGMENT = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(data), size):
        part = data[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        out.append(data[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the blank lines at its end."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def record_name(page_id, digest: str, more: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{more}')}>"


def page_records(page_id: int | None, url: str | None, html: bytes, first: tuple | None, number: int, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page. ``first``: the page id of the stored page that has the same payload, in a tuple."""
    digest = hashlib.sha1(html).hexdigest()
    uri = "".join(c for c in url or "urn:page" if c.isprintable())
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", _sha1(html)), ("X-Page-Id", page_id)]
    if first is not None:
        name = record_name(page_id, digest, f"revisit {number}")
        refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(first[0], digest))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *refers, ("Content-Type", "application/http; msgtype=response")], HTTP)
        return
    block = HTTP + chunked(html)
    name = record_name(page_id, digest)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    split = len(parts) > 1
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    yield _record([*head, ("WARC-Segment-Number", 1 if split else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        more = [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)]
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_name(page_id, digest, f"segment {k}")), ("WARC-Target-URI", uri), ("WARC-Date", DATE), *more], part)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of an archive, gzipped or not, unpacked bit by bit."""
    if data[:2] == b"\x1f\x8b":
        def pieces() -> Iterator[bytes]:
            rest = data
            while rest:  # members follow one another
                unpack = zlib.decompressobj(31)
                while not unpack.eof:
                    got = unpack.decompress(rest, 1 << 20)
                    rest = unpack.unconsumed_tail or unpack.unused_data
                    yield got
                    if not got and not rest and not unpack.eof:
                        raise ValueError("the archive is cut")
    else:
        def pieces() -> Iterator[bytes]:
            yield data
    buffer, at = b"", 0
    source = pieces()
    while True:
        head = buffer.find(b"\r\n\r\n", at)
        fields: dict[str, str] = {}
        need = -1
        if head >= 0:
            for line in buffer[at:head].decode().split("\r\n")[1:]:
                k, _, v = line.partition(":")
                fields[k.strip().lower()] = v.strip()
            need = head + 4 + int(fields["content-length"])
        if head < 0 or need + 4 > len(buffer):
            got = next(source, None)
            if got is not None:
                buffer, at = buffer[at:] + got, 0
                continue
            if buffer[at:].strip():
                raise ValueError("the archive ends within a record")
            return
        if not buffer.startswith(b"WARC/", at) or buffer[need : need + 4] != b"\r\n\r\n":
            raise ValueError("a record has no proper head or end")
        yield fields, buffer[head + 4 : need]
        at = need + 4


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, segment: int = SEGMENT, per_file: int = 4000) -> None:
    """Write every page. Of payloads of ``least`` bytes and more that are equal, the largest page id has the response."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), whole_text(html_col).cast("binary").alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= least
    first = (
        rows.where(large).groupBy("digest").agg(F.max(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("key"), F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"))
    )
    # Small payloads are never revisits: their key is their own, so that no partition gets all of them.
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string"))))
    planned = keyed.join(first, "key", "left").select("id", "url", "html", "row", "first_id", "first_row")

    def run(batches):
        yield pa.record_batch([pa.array([_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")], pa.binary())], names=["record"])
        for batch in batches:
            out = []
            for key, url, html, row, first_id, first_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += page_records(key, url, html, None if first_row is None or first_row == row else (first_id,), row, segment)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    records = planned.mapInArrow(run, "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    )


_PARSED = "type string, name string, page_id long, digest string, refers string, origin string, number int, total long, block binary, n_bytes long"


def parse_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record. ``block`` is left for segments only; whole payloads are decoded, checked and measured here."""

    def run(batches):
        names = [x.split()[0] for x in _PARSED.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for f, block in read_records(data.as_py()):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    digest = base64.b32decode(f["warc-payload-digest"][5:]).hex() if "warc-payload-digest" in f else None
                    number, n = int(f["warc-segment-number"]) if "warc-segment-number" in f else None, None
                    if kind == "response" and number is None:
                        n = measured(block, digest)
                    keep = block if number is not None else None
                    page = int(f["x-page-id"]) if "x-page-id" in f else None
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if number is not None else None)
                    rows.append((kind, f["warc-record-id"], page, digest, f.get("warc-refers-to"), origin, number, total, keep, n))
                    size += len(keep or b"") + 300
                    if size > 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _PARSED)


def measured(block: bytes, digest: str) -> int:
    payload = http_payload(block)
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return len(payload)


def reassembled(records: DataFrame) -> DataFrame:
    """The records that segments make up, with their lengths. A group is one payload's segments."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        if pdf["number"].tolist() != list(range(1, len(pdf) + 1)):
            raise ValueError("a segment is missing or doubled")
        block = b"".join(pdf["block"])
        if pdf["total"].iloc[-1] != len(block):
            raise ValueError("segments do not add up to the total length")
        head = pdf.iloc[:1].drop(columns=["block"]).copy()
        head["n_bytes"] = measured(block, head["digest"].iloc[0])
        return head[["name", "page_id", "digest", "n_bytes"]]

    schema = "name string, page_id long, digest string, n_bytes long"
    return records.where("number is not null").groupBy("origin").applyInPandas(join, schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every page in the archives."""
    records = materialise(parse_archives(spark, path), "records")
    whole = records.where("type = 'response' and number is null").select("name", "page_id", "digest", "n_bytes")
    stored = materialise(whole.unionByName(reassembled(records)), "responses")
    revisits = records.where("type = 'revisit'").select("page_id", "digest", "refers")
    target = stored.select(F.col("name").alias("refers"), F.col("page_id").alias("refers_to"), F.col("digest").alias("target_digest"), F.col("n_bytes"))
    wrong = F.raise_error(F.lit("a revisit has no record with its payload"))
    followed = revisits.join(target, "refers", "left").select(
        "page_id", F.when(F.col("digest") == F.col("target_digest"), F.col("n_bytes")).otherwise(wrong.cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to",
    )
    return stored.select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).unionByName(followed)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, max(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
