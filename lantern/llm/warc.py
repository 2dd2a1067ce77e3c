"""WARC: writes captures as request, response (or revisit) and metadata records and assembles them again.

Records are gzip members of their own. Reading parses every archive as a stream, then joins the three records of a
transaction through their concurrent-to identifiers into one nested row for each capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import Files, fresh_dir, partitions, small_batches, written

#: Equal payloads of at least so many bytes are stored once and revisited.
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 14
ROLL = 128 << 20
MANIFEST = "file string, n_records long, n_bytes long"
RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(head.encode() + block + b"\r\n\r\n") + c.flush()


def _line(text: str | None) -> str:
    """A header value: line ends would break the header."""
    return " ".join((text or "").split())


def capture(uid: str, page_id: int | None, url: str | None, payload: bytes, digest: str, target: int | None) -> list[bytes]:
    """The three records of a capture; target: the page that a revisit refers to, None for a response."""
    uri, main = _line(url), f"<urn:lantern:{uid}:main>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    page = [] if page_id is None else [("Lantern-Page", str(page_id))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    first = [("WARC-Record-ID", main), *common, *page, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if target is None:
        out = [_record([("WARC-Type", "response"), *first], http + payload)]
    else:
        out = [_record([("WARC-Type", "revisit"), *first, ("WARC-Profile", PROFILE), ("Lantern-Refers-To-Page", str(target))], http)]
    try:
        host = urlsplit(uri).netloc
    except ValueError:
        host = ""
    ask = f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    out.append(_record([("WARC-Type", "request"), ("WARC-Record-ID", f"<urn:lantern:{uid}:request>"), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], ask))
    out.append(_record([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<urn:lantern:{uid}:metadata>"), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], f"payload-bytes: {len(payload)}\r\n".encode()))
    return out


def plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, target: the response's page for a revisit, else null.

    The largest page id of equal payloads is the response; rows that repeat it are responses as well, and a null
    id is a revisit if the payload has an id at all. Only digests that occur twice are joined back; that join has one
    row a digest on its right, and Spark splits its hot keys.
    """
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    top = p.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "top")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.join(top, "digest", "left").select("page_id", "url", "html", F.when(revisit, F.col("top")).alias("target"))


def write(planned: DataFrame, directory: str) -> DataFrame:
    """Writes archives (.warc.gz) and returns their manifest; only files in the manifest count.

    Each task attempt writes files under names of its own, in pieces of about ROLL bytes.
    """
    small_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, task = Files(directory), TaskContext.get()
        stem, n, at, made, records, f = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0, 0, 0, None

        def close():
            f.close()
            files.publish(name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([at], pa.int64())], names=["file", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, html, target in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if f is None:
                    name, at, records = f"{stem}-{n:04d}.warc.gz", 0, 0
                    f, n = files.create(name), n + 1
                payload = html.encode()
                data = b"".join(capture(f"{stem}:{made}", page_id, url, payload, _base32(hashlib.sha1(payload).digest()), target))
                f.write(data)
                at, made, records = at + len(data), made + 1, records + 3
                if at >= ROLL:
                    yield close()
                    f = None
        if f is not None:
            yield close()

    return planned.mapInArrow(run, MANIFEST)


def members(f) -> Iterator[bytes]:
    """The uncompressed members of a gzip stream, one at a time."""
    rest = b""
    while True:
        rest = rest or f.read(CHUNK)
        if not rest:
            return
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not rest and not (rest := f.read(CHUNK)):
                raise EOFError("the archive ends within a record")
            parts.append(d.decompress(rest))
            rest = d.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; the block is as long as its header says."""
    at = record.index(b"\r\n\r\n") + 4
    lines = record[: at - 4].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, record[at : at + int(headers["content-length"])]


def _row(record: bytes, with_payload: bool) -> tuple:
    h, block = parse(record)
    kind, size, digest, payload = h["warc-type"], None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest, payload = len(body), _base32(hashlib.sha1(body).digest()), body
            if h.get("warc-payload-digest") not in (None, f"sha1:{digest}"):
                raise ValueError(f"{h['warc-record-id']}: the payload does not have its digest")
        else:
            size = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length"), None)
            digest = h["warc-payload-digest"].removeprefix("sha1:")
    number = lambda k: int(h[k]) if k in h else None
    return (h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), number("lantern-page"), number("lantern-refers-to-page"), size, digest, payload if with_payload else None)


def records(spark: SparkSession, directory: str, names: list[str], with_payload: bool = False) -> DataFrame:
    """A row for each record of the named archives."""
    kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.string(), pa.binary()]
    columns = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(directory)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with files.open(name) as f:
                    for record in members(f):
                        rows.append(_row(record, with_payload))
                        if len(rows) == (64 if with_payload else 2048):
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.createDataFrame([(n,) for n in names], "file string")
    return files.repartition(max(1, min(len(names), partitions(spark)))).mapInArrow(run, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row for each capture: its main record with the request and metadata records concurrent to it."""
    main = rows.filter("record_type in ('response', 'revisit')")
    ask = rows.filter("record_type = 'request'").select(F.col("concurrent_to").alias("_q"), F.struct("record_id", "target_uri").alias("request"))
    more = rows.filter("record_type = 'metadata'").select(F.col("concurrent_to").alias("_m"), F.struct("record_id", "target_uri").alias("metadata"))
    joined = main.join(ask, main["record_id"] == F.col("_q"), "left").join(more, main["record_id"] == F.col("_m"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "request", "metadata", F.struct("record_id", "target_uri", "payload").alias("main"))


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads the captures back. Null html counts as empty."""
    spark = pages.sparkSession
    directory = fresh_dir(spark, "warc")
    names = [r.file for r in write(plan(pages, min_bytes), directory).select("file").collect()]  # a row for each archive
    rows = written(records(spark, directory, names).drop("payload"), "warc-records").withColumn("payload", F.lit(None).cast("binary"))
    return assemble(rows)
