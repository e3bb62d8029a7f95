"""WARC archives of page captures: writing with revisit records, reading, transaction assembly.

`write_archive` gives every row three records: a response (or a revisit, if a capture with an equal
payload of at least `least` bytes and a larger id exists), its request and a metadata record, the
latter two tied to the first by WARC-Concurrent-To. Spark's text writer puts the records into
gzipped files of `per_file` captures, so any store that Spark can write to will do. `read_records`
parses such files record by record, and `assemble` joins request, response and metadata records
through the concurrent-to identifiers into one nested row per capture.

Defined results: a null payload is an empty one. A null id counts as smaller than every other: with
an equal payload it revisits the largest id; if no equal payload has an id, all are responses. Rows
that share the largest id and the payload are all responses. A null url gives no Target-URI header.
Line breaks inside a url become blanks. An empty table gives an archive without records. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PER_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"
_RECORD = "type string, record_id string, concurrent_to string, uri string, date string, digest string, payload_bytes long, payload_sha1 string, page_id string, payload binary"


def base32_of(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: four times ten hex digits, eight letters each."""
    letters = []
    for i in range(4):
        v = F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 10).cast("long")
        letters += [F.lit(BASE32).substr(F.shiftright(v, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*letters)


def _record(kind: str, record_id: Column, block: Column, headers: list[tuple[str, Column]], content_type: str) -> Column:
    """One record without the two line ends behind it; a header with a null value is left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, per_file: int = PER_FILE) -> None:
    """Write the captures of all rows to `path`; rows with payloads seen under a larger id become revisits."""
    rows = pages.select(F.col(page_id).alias("id"), F.regexp_replace(F.col(url), r"[\r\n]", " ").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # only ids and digests are grouped and joined; payloads move once, by id and digest
    seen = rows.filter(F.octet_length("html") >= least).select("id", "sha")
    tops = seen.groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    again = seen.join(tops, "sha").filter(F.col("id").isNull() & F.col("top").isNotNull() | (F.col("id") < F.col("top"))).select("id", "sha").distinct().withColumn("again", F.lit(True))
    known = rows.join(again, rows["id"].eqNullSafe(again["id"]) & (rows["sha"] == again["sha"]), "left").select(rows["*"], "again")

    run = uuid.uuid4().hex
    known = known.withColumn("row", F.monotonically_increasing_id())

    def urn(part: str) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(run), "row", F.lit(part)))
        return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])

    digest = F.concat(F.lit("sha1:"), base32_of(F.col("sha")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    to = [("WARC-Target-URI", F.col("url"))]
    response = _record("response", urn("capture"), F.concat(head, "html"), [*to, ("WARC-Payload-Digest", digest)], "application/http;msgtype=response")
    revisit = _record("revisit", urn("capture"), head, [*to, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))], "application/http;msgtype=response")
    request = _record("request", urn("request"), F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), [*to, ("WARC-Concurrent-To", urn("capture"))], "application/http;msgtype=request")
    metadata = _record("metadata", urn("metadata"), F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), [*to, ("WARC-Concurrent-To", urn("capture"))], "application/warc-fields")
    records = known.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * per_file).text(path)


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names; of repeated ones the first) and block of each record of one file."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content.startswith(b"\x1f\x8b") else io.BytesIO(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers.setdefault(name.decode().strip().lower(), value.decode("utf-8", "replace").strip())
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, page, payload = headers.get("warc-type"), None, None
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "response":
        payload = block
    elif kind == "metadata":
        page = next((x[8:].strip().decode() for x in block.split(b"\r\n") if x.startswith(b"page-id:")), None)
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
    return (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"),
            (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None, len(payload) if kind == "response" else None, own, page, payload if payloads else None)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under `path`; `payload_sha1` is computed from what was read."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for headers, block in _parse(content.as_py()):
                    held.append(_row(headers, block, payloads))
                    size += len(block)
                    if size > 8 << 20 or len(held) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return files.mapInArrow(task, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (response or revisit), request, metadata records.

    The records of a transaction share a key: the identifier that those with a concurrent-to header
    name, the own identifier for the record they name. Requests and metadata without a capture go.
    """
    keyed = records.withColumn("key", F.coalesce("concurrent_to", "record_id"))
    of = lambda *cols: F.struct(*cols)
    capture = F.when(F.col("type").isin("response", "revisit"), of("type", "record_id", "uri", "date", "digest", "payload_bytes", "payload_sha1", "payload"))
    request = F.when(F.col("type") == "request", of("record_id", "uri", "date"))
    metadata = F.when(F.col("type") == "metadata", of("record_id", "page_id"))
    return keyed.groupBy("key").agg(F.max(capture).alias("capture"), F.max(request).alias("request"), F.max(metadata).alias("metadata")).filter("capture IS NOT NULL")
