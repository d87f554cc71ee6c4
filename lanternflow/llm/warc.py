"""WARC archives: writing captures, reading records, and assembling transactions.

Writing: each page row becomes three records, a request, a response or revisit, and a metadata record,
one after the other in one file. Which payloads are repeated is found on digests and lengths alone; payloads meet the
list of revisits only where a bitmap says that they may be on it. Each record is a gzip member of its own, and members
are gathered in blocks, so files are bounded by bytes. A block is a row for Spark's text writer, so any file system
will do: the line separator that it puts after a row is the byte that every block ends with.

Reading: a file's members are unzipped one after the other, and records are cut by Content-Length. A record that ends
early, or whose payload is not what its digest says, is listed with its problem. The records of a capture are then
joined through their concurrent-to identifiers, whichever of them names the other, into one nested row a capture.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm.shared import hot_join, materialise, scratch_path, small_batches, split_by_bitmap

CRLF = b"\r\n"
#: Payloads below this size are always written out.
REVISIT_BYTES = 100
#: Bytes of a block, and blocks of a file.
BLOCK_BYTES, BLOCKS_PER_FILE = 1 << 21, 8
_DATE = b"2024-01-01T00:00:00Z"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names of captures are made in this name space.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:capture")

RECORD = "record_id string, warc_type string, concurrent_to array<string>, target_uri string, page_id long, payload_digest string, refers_to string, refers_to_page long, http_length long, block_bytes long, payload_bytes long, payload_sha256 string, problem string, payload binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
_FIELDS = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in RECORD.split(", "))])


def record_id(page_id: int | None, url: str | None, digest: str, kind: str) -> bytes:
    """The identifier of a record: the same page, address and payload always give the same one."""
    name = "\n".join(("" if page_id is None else str(page_id), url or "", digest, kind))
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>".encode()


def _record(block: list[bytes], *headers: tuple[bytes, bytes | None]) -> bytes:
    """A record as a gzip member; headers whose value is None are left out."""
    lines = [b"WARC/1.1", *(name + b": " + value for name, value in headers if value is not None), b"Content-Length: %d" % sum(map(len, block))]
    packed = zlib.compressobj(4, zlib.DEFLATED, 31)
    parts = [packed.compress(x) for x in (CRLF.join(lines), CRLF * 2, *block, CRLF * 2)]
    return b"".join([*parts, packed.flush()])


def _uri(text: str) -> bytes:
    """White space and control characters would end a header line."""
    return re.sub(r"[\x00-\x20\x7F]", "%20", text).encode()


def _capture(page_id: int | None, url: str | None, html: str | None, digest: str, head: int | None, head_url: str | None) -> Iterator[bytes]:
    payload = (html or "").encode()
    target = None if url is None else _uri(url)
    main = record_id(page_id, url, digest, "main")
    shared = ((b"WARC-Date", _DATE), (b"WARC-Target-URI", target))
    host = re.search(r"://([^/?#]*)", url or "")
    yield _record(
        [b"GET / HTTP/1.1", CRLF, b"Host: ", _uri(host[1]) if host else b"", CRLF * 2],
        (b"WARC-Type", b"request"), (b"WARC-Record-ID", record_id(page_id, url, digest, "request")), (b"WARC-Concurrent-To", main), *shared,
        (b"Content-Type", b"application/http; msgtype=request"),
    )
    again = head is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    yield _record(
        [http] if again else [http, payload],
        (b"WARC-Type", b"revisit" if again else b"response"), (b"WARC-Record-ID", main), *shared,
        (b"X-Page-Id", None if page_id is None else b"%d" % page_id),
        (b"WARC-Payload-Digest", b"sha256:" + digest.encode()),
        (b"WARC-Profile", _PROFILE if again else None),
        (b"WARC-Refers-To", record_id(head, head_url, digest, "main") if again else None),
        (b"X-Refers-To-Page-Id", b"%d" % head if again else None),
        (b"Content-Type", b"application/http; msgtype=response"),
    )
    yield _record(
        [b"payload-length: %d" % len(payload), CRLF],
        (b"WARC-Type", b"metadata"), (b"WARC-Record-ID", record_id(page_id, url, digest, "metadata")), (b"WARC-Concurrent-To", main), *shared,
        (b"Content-Type", b"application/warc-fields"),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures as blocks without their last byte. That byte is 0: it is the top one of a small member's length."""
    held: list[bytes] = []
    size = 0

    def block() -> pa.RecordBatch:
        data = b"".join(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

    for batch in small_batches(batches, 2):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            for member in _capture(*row):
                held.append(member)
                size += len(member)
            if size >= BLOCK_BYTES:
                yield block()
                size = 0
    if held:
        yield block()


def classify(pages: DataFrame) -> DataFrame:
    """Of the pages (page_id, url, digest, n) those that are revisits: page_id, digest, head and head_url of the smallest page_id with their payload."""
    ids = materialise(pages.filter(F.col("n") >= REVISIT_BYTES).select("page_id", "url", "digest"), "digests")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    heads = ids.groupBy("digest").agg(first.alias("head"), F.count("*").alias("c"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("nameless"))
    heads = materialise(heads.filter("head is not null and (last != head.page_id or nameless > 0)").select("digest", "head", "c"), "heads")
    found = hot_join(ids.select("page_id", "digest"), heads, "digest", "c").filter("not (page_id <=> head.page_id)")
    return materialise(found.select("page_id", "digest", F.col("head.page_id").alias("head"), F.col("head.url").alias("head_url")).distinct(), "revisits")


def write_warc(pages: DataFrame, path: str, blocks_per_file: int = BLOCKS_PER_FILE) -> None:
    """Writes three records for each row of pages (page_id, url, html) below path.

    A null html is an empty payload, a null url an absent target. Rows that repeat a page_id are captures of
    their own; rows that repeat page_id, url and html have equal records. Rows that repeat the smallest page_id with its
    payload are all responses. A null page_id comes after all others.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    again = classify(full.withColumn("n", F.octet_length("html")))
    key = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest")
    near, other = split_by_bitmap(full, key, materialise(again.select(key.alias("k")), "places"))
    marked = near.alias("p").join(again.alias("a"), (F.col("p.page_id").eqNullSafe(F.col("a.page_id"))) & (F.col("p.digest") == F.col("a.digest")), "left").select("p.*", "head", "head_url")
    rows = marked.unionByName(other.withColumns({"head": F.lit(None).cast("long"), "head_url": F.lit(None).cast("string")}))
    blocks = rows.mapInArrow(_blocks, "value binary").select(F.col("value").cast("string").alias("value"))
    blocks.write.option("lineSep", "\0").option("maxRecordsPerFile", blocks_per_file).option("compression", "none").text(path)


def unzipped(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a file, piece by piece: those of its gzip members, or its own. A member that breaks off gives what there is."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + step]) for k in range(0, len(view), step))
        return
    at = 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            part = view[at : at + step]
            try:
                out = member.decompress(part)
            except zlib.error:
                return
            at += len(part) - len(member.unused_data)
            if out:
                yield out


def cut_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes, str | None]]:
    """Headers (a list of values for each name), block and problem of each record. What follows a broken record is not read."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while held[:2] == CRLF or (len(held) < 2 and fill(2)):
            if held[:2] != CRLF:
                break
            del held[:2]
        if not held:
            return
        end = held.find(CRLF * 2)
        while end < 0 and fill(len(held) + 1):
            end = held.find(CRLF * 2)
        lines = bytes(held[: end if end >= 0 else len(held)]).decode("utf-8", "replace").split("\r\n")
        headers: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = headers.get("content-length", [""])[0]
        if end < 0 or not lines[0].startswith("WARC/") or not length.isdigit():
            yield headers, b"", "truncated" if end < 0 else "no record"
            return
        del held[: end + 4]
        whole = fill(int(length))
        yield headers, bytes(held[: int(length)]), None if whole else "truncated"
        if not whole:
            return
        del held[: int(length)]


def whole_number(text: str | None) -> int | None:
    """A whole number of 64 bits."""
    value = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return value if value is not None and -(2**63) <= value < 2**63 else None


def parse_record(headers: dict[str, list[str]], block: bytes, problem: str | None, keep_payload: bool) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    number = lambda name: whole_number(one(name))
    kind = (one("warc-type") or "").lower()
    http_length = payload = None
    if kind in ("response", "revisit", "resource"):
        body = block
        if kind != "resource" and block.startswith(b"HTTP/"):
            head, _, body = block.partition(CRLF * 2)
            found = re.search(rb"(?im)^content-length:\s*(\d{1,18})", head)
            http_length = int(found[1]) if found else None
        payload = None if kind == "revisit" else body
    said = one("warc-payload-digest") or ""
    digest = said.removeprefix("sha256:") if said.startswith("sha256:") else None
    found_digest = None if payload is None else hashlib.sha256(payload).hexdigest()
    if not problem and digest and found_digest and re.fullmatch("[0-9a-f]{64}", digest) and digest != found_digest:
        problem = "digest"
    return (
        one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-target-uri"), number("x-page-id"), digest, one("warc-refers-to"),
        number("x-refers-to-page-id"), http_length, len(block), None if payload is None else len(payload), found_digest, problem, payload if keep_payload else None,
    )


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row for each record below path; without keep_payload its bytes stay where they were read.

    problem is null, or says that the record ends early (truncated), that no record begins where one should (no record), or
    that its payload has another SHA-256 than it says (digest).
    """

    def rows(records: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records), _FIELDS)], schema=_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple] = []
                size = 0
                for record in cut_records(unzipped(content.as_py())):
                    held.append(parse_record(*record, keep_payload))
                    size += 1000 + (len(record[1]) if keep_payload else 0)
                    if size > 1 << 22:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response, revisit or resource, with the request and metadata records concurrent to it.

    records: read once, so written by then. A request or metadata record may name several records, and a capture may name
    them. Records with a problem, and requests and metadata without a capture, are left out; of several requests or metadata
    records of a capture the one with the smallest identifier is taken, and one that is missing is null. Captures with
    equal records have a row each.
    """
    sound = records.filter("problem is null and record_id is not null")
    main = F.col("warc_type").isin("response", "revisit", "resource")
    fields = [c for c in records.columns if c not in ("record_id", "concurrent_to", "problem")]
    mains = sound.filter(main)
    other = sound.filter(F.col("warc_type").isin("request", "metadata"))
    named = mains.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")).distinct()
    links = other.select(F.explode("concurrent_to").alias("capture_id"), "record_id", "target_uri", "block_bytes", "warc_type")
    links = links.unionByName(other.join(named, "record_id").select("capture_id", "record_id", "target_uri", "block_bytes", "warc_type"))
    detail = F.struct("record_id", "target_uri", "block_bytes")
    part = lambda kind: F.min(F.when(F.col("warc_type") == kind, detail)).alias(kind)
    none = lambda kind: F.lit(None).cast("struct<record_id:string,target_uri:string,block_bytes:bigint>").alias(kind)
    rows = mains.groupBy(F.col("record_id").alias("capture_id")).agg(F.any_value(F.struct(*fields)).alias("capture"), F.count("*").alias("n"))
    rows = rows.select("capture_id", "capture", "n", none("request"), none("metadata"))
    beside = links.groupBy("capture_id").agg(part("request"), part("metadata"))
    beside = beside.select("capture_id", F.lit(None).cast(rows.schema["capture"].dataType).alias("capture"), F.lit(0).cast("long").alias("n"), "request", "metadata")
    whole = rows.unionByName(beside).groupBy("capture_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("capture", "request", "metadata")), F.sum("n").alias("n"))
    whole = whole.filter("capture is not null").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return whole.select(F.col("capture_id").alias("record_id"), "capture", "request", "metadata")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of pages, after writing and reading archives."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    captures = assemble(materialise(read_warc(spark, path, keep_payload=False).drop("payload"), "records"))
    return captures.select(
        "capture.page_id",
        F.coalesce("capture.payload_bytes", "capture.http_length").alias("payload_bytes"),
        F.coalesce("capture.payload_sha256", "capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"),
        F.col("capture.refers_to_page").alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"),
        F.col("metadata").isNotNull().alias("has_metadata"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS head FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> head THEN head END AS refers_to,
       true AS has_request, true AS has_metadata
FROM r
"""
