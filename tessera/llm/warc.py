"""WARC archives: writing with deduplication, and reading with reassembly.

Writing: each row becomes an HTTP response in chunked transfer framing. Of rows
with equal payloads the one with the smallest id is the response, others are
`revisit` records that refer to it. Blocks above segment_bytes are written as a
first segment and continuation records (WARC 1.1, record segmentation). Each
task writes one archive of gzip members to the shared folder, under a name of
its partition, first as a file of its own attempt; a task that runs again
replaces its archive whole. A record's identifier is made of the page id, the
digest and the place of the row (archive and number), so no two are equal
whatever ids the rows have.

Reading: the files are dealt over tasks and parsed once, record by record, into
a table. Records without segments are decoded where they are read. Segments are
grouped by the identifier of their origin in Spark, ordered by segment number,
checked for gaps and against the total length, joined, and decoded. Only segments
and revisits move between tasks; a revisit finds its payload by the digest.

Defined results: a null payload is empty. Rows with the same id and payload, if
that id is the smallest, are all responses, else all revisits; a null id counts
as larger than all others, and rows that have only null ids are all responses.
Repeated ids with different payloads are different records. A very long payload
is as many segments as it needs; the row is held whole by one task. An empty
table gives no archive and no record. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, store, table, text_bytes, written

SEGMENT_BYTES = 8 * 1024
CHUNK_BYTES = 4 * 1024
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises on broken framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _clean(value: str | None) -> str:
    return " ".join((value or "").split())


def records(page_id, url: str | None, payload: bytes, first, first_url: str | None, segment_bytes: int, place: str) -> Iterator[bytes]:
    """The records of one row; first: the page id of the response it revisits;
    place: of the row among all rows."""
    digest = digest_of(payload)
    rid = record_id("page", page_id, digest, place)
    key = "" if page_id is None else str(page_id)
    common = [("WARC-Record-ID", rid), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("X-Page-ID", key), ("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To-Target-URI", _clean(first_url)), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page-ID", str(first))], http)
        return
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(pieces) else []
        own = ("WARC-Record-ID", record_id(rid, k))
        yield _record([("WARC-Type", "continuation"), own, ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k)), *more], piece)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write archives of pages to folder; a table (path, n_records, n_bytes)."""
    files, to = store(folder)
    files.create_dir(to, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_bytes(payload_col).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # Which row is the response: a partial aggregation on digests, then a join whose other side has one row per digest.
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL").drop("c")
    revisit = ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.join(first, "sha", "left").select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("first"), F.when(revisit, F.col("first_url")).alias("first_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        k = task.partitionId()
        files, to = store(folder)
        name = f"part-{k:06d}.warc.gz"
        tmp = f"{to}/{name}.{task.taskAttemptId()}.tmp"
        out, rows, n = None, 0, 0
        for b in batches:
            if out is None and b.num_rows:
                out = files.open_output_stream(tmp, compression=None)
            for row in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                rows += 1
                for rec in records(*row, segment_bytes, f"{k}.{rows}"):
                    out.write(gzip.compress(rec, 3, mtime=0))
                    n += 1
        if out is None:
            return
        size = out.tell()
        out.close()
        files.move(tmp, f"{to}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    return written(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def parse(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; field names in lower case."""
    files, at = store(path)
    with files.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
        while True:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record where one should begin: {line[:40]!r}")
            fields: dict[str, str] = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = line.decode().partition(":")
                fields[k.strip().lower()] = v.strip()
            n = int(fields["content-length"])
            block = f.read(n)
            if len(block) != n:
                raise ValueError(f"{path}: a record is cut off")
            yield fields, block


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_ROW = "page_id long, url string, rid string, record_type string, digest string, refers_page long, seg int, total long, payload_bytes long, block binary"
_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("rid", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_page", pa.int64()), ("seg", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("block", pa.binary())]


def checked(block: bytes, digest: str) -> bytes:
    """The payload of a block, whose digest must be the one given."""
    payload = payload_of(block)
    if digest_of(payload) != digest:
        raise ValueError("a payload differs from its digest")
    return payload


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record; origin id in rid for continuations. block: the
    decoded payload of a whole response, the raw piece of a segmented one, null
    for a revisit."""
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x: int(x) if x else None
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                for f, block in parse(path):
                    kind, seg = f["warc-type"], whole(f.get("warc-segment-number"))
                    rid = f["warc-segment-origin-id"] if kind == "continuation" else f["warc-record-id"]
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "revisit":
                        block = None
                    elif seg is None:
                        block = checked(block, digest)
                    length = len(block) if kind == "response" and seg is None else None
                    rows.append((whole(f.get("x-page-id")), f.get("warc-target-uri"), rid, kind, digest, whole(f.get("x-refers-to-page-id")), seg, whole(f.get("warc-segment-total-length")), length, block))
                    size += len(block or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, _ROW)


_WHOLE = "rid string, page_id long, url string, digest string, payload_bytes long, block binary"


def reassembled(segments: DataFrame) -> DataFrame:
    """(rid, page_id, url, digest, payload_bytes, block) of segmented records,
    from rows of read_records with seg; block is the decoded payload. A group is
    one record, so it is as large as a record may be."""
    whole = segments.groupBy("rid").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("digest").alias("digest"), F.array_sort(F.collect_list(F.struct("seg", "block"))).alias("s"), F.max("total").alias("total")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = []
            for rid, digest, s, total in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if [x["seg"] for x in s] != list(range(1, len(s) + 1)):
                    raise ValueError(f"{rid}: segments are missing or doubled")
                block = b"".join(x["block"] for x in s)
                if len(block) != total:
                    raise ValueError(f"{rid}: {len(block)} bytes instead of {total}")
                payloads.append(checked(block, digest))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(map(len, payloads), pa.int64()), pa.array(payloads, pa.binary())], names=["rid", "page_id", "url", "digest", "payload_bytes", "block"])

    return whole.mapInArrow(run, _WHOLE)


def read(manifest: DataFrame) -> DataFrame:
    """One row per page: page_id, url, payload (null for revisits, whose
    payload is that of refers_to), payload_bytes, payload_digest, record_type,
    refers_to. Digests are checked against the decoded payloads."""
    recs = written(read_records(manifest), "warc-records", "zstd")
    whole = written(reassembled(recs.where("seg IS NOT NULL")), "warc-whole", "zstd")
    responses = recs.where("seg IS NULL AND record_type = 'response'").select(*whole.columns).unionByName(whole)
    out = responses.select("page_id", "url", F.col("block").alias("payload"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    lengths = responses.groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    visits = recs.where("record_type = 'revisit'").drop("payload_bytes").join(lengths, "digest", "left")
    again = visits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_page").alias("refers_to"))
    return out.unionByName(again)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), folder)
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
