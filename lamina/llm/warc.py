"""WARC archives: writing pages as records, and reading them back with
segmented records put together again.

A page is a ``response`` record whose block is an HTTP message with a chunked
body. A block longer than ``segment_bytes`` is split: the first segment is the
record itself, the others are ``continuation`` records that name it as their
origin and carry their number; the last carries the total length. Pages whose
payload equals that of a page with a smaller id are ``revisit`` records without
a body. Each record is a gzip member of its own; a task closes an archive once
it is over ``archive_bytes`` and opens the next, so segments of one record may
lie in different archives. Only archives that the manifest names count.

Reading gives complete records as they are. Segments are grouped by origin,
ordered by number, checked against the total length and joined; then chunks are
decoded and the payload is checked against its digest. A group is one page.

A null or empty html is a payload of 0 bytes. Among equal payloads the smallest
page_id is the response; rows that repeat it with its payload are responses
too, and a null page_id revisits unless all are null. A null url stays out of
the record. An empty table gives no archives and no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import file_system, scratch

SEGMENT_BYTES, ARCHIVE_BYTES, CHUNK_BYTES = 16 << 10, 64 << 20, 4 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_RECORD = "page_id long, url string, type string, record_id string, origin_id string, segment int, total long, digest string, refers_to long, block binary"
_RESULT = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for k in range(0, len(payload), size) if (p := payload[k : k + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, block: bytes, record_id: str, fields: dict[str, object]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {_DATE}", f"Content-Length: {len(block)}"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id, url, html, refers_to, segment_bytes: int) -> Iterator[bytes]:
    payload = (html or "").encode()
    digest = digest_of(payload)
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_OID, f"{i} {digest}")
    url = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    fields = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Page-ID": page_id}
    if refers_to is not None:
        head = _HEAD.replace(b"Transfer-Encoding: chunked\r\n", b"")
        yield record("revisit", head, str(uuid.uuid4()), fields | {
            "WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:uuid:{name(refers_to)}>", "Refers-To-Page-ID": refers_to, "Content-Type": "application/http; msgtype=response"})
        return
    block, own = _HEAD + chunked(payload), str(name(page_id))
    fields["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment_bytes:
        yield record("response", block, own, fields)
        return
    last = (len(block) - 1) // segment_bytes
    for k in range(last + 1):
        part, more = block[k * segment_bytes : (k + 1) * segment_bytes], {"WARC-Segment-Number": k + 1}
        if k == last:
            more["WARC-Segment-Total-Length"] = len(block)
        if k == 0:
            yield record("response", part, own, fields | more)
        else:
            yield record("continuation", part, str(uuid.uuid4()), more | {"WARC-Segment-Origin-ID": f"<urn:uuid:{own}>", "WARC-Target-URI": url})


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id``, ``url``, ``html`` rows; returns the manifest of archives.
    Payloads of at least ``least_bytes`` are written once."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        out, names, sizes = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                for rec in page_records(*row, segment_bytes):
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        sizes.append(0)
                        out = store.open_output_stream(f"{root}/{names[-1]}", compression=None)
                    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                    sizes[-1] += out.write(gz.compress(rec) + gz.flush())
                    if sizes[-1] >= archive_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"folder": pa.array([folder] * len(names), pa.string()), "name": pa.array(names, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    again = rows.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    known = rows.join(again.select("sha", "first"), "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    made = known.mapInArrow(write, "folder string, name string, bytes long")
    path = f"{folder}/manifest"
    made.write.parquet(path)  # once: the archives that count
    return spark.read.schema(made.schema).parquet(path)


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data, gz, out = b"", zlib.decompressobj(31), []
    while data or (data := source.read(1 << 20)):
        out.append(gz.decompress(data))
        data = gz.unused_data
        if gz.eof:
            yield b"".join(out)
            gz, out = zlib.decompressobj(31), []


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("record cut short")
    return fields, block


def read_records(manifest: DataFrame, segmented: bool | None = None) -> DataFrame:
    """The records of the archives: those in segments, those that are whole, or all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in _RECORD.split(", ")])
        number = lambda f, k: int(f[k]) if k in f else None
        for batch in batches:
            for archive in batch.to_pylist():
                store, root = file_system(archive["folder"])
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{archive['name']}", compression=None) as source:
                    for raw in members(source):
                        f, block = parsed(raw)
                        if segmented is not None and segmented != ("WARC-Segment-Number" in f):
                            continue
                        rows.append({
                            "page_id": number(f, "Page-ID"), "url": f.get("WARC-Target-URI"), "type": f["WARC-Type"], "record_id": f["WARC-Record-ID"],
                            "origin_id": f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), "segment": number(f, "WARC-Segment-Number"),
                            "total": number(f, "WARC-Segment-Total-Length"), "digest": f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                            "refers_to": number(f, "Refers-To-Page-ID"), "block": block})
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.repartition(max(1, manifest.count()), "name")
    return files.mapInArrow(read, _RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """Segmented records with their whole block. Segments that occur twice (rows
    written twice) count once, and the record comes back as often as its first one."""
    first = F.col("segment") == 1
    of = lambda c: F.max(F.when(first, F.col(c))).alias(c)
    g = segments.groupBy("origin_id").agg(
        *[of(c) for c in ("page_id", "url", "type", "digest")], F.count(F.when(first, 1)).cast("int").alias("copies"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("s"))
    block = F.aggregate("s.block", F.lit(b""), lambda a, x: F.concat(a, x))
    g = g.withColumn("block", block)
    numbers = F.expr("s.segment") == F.sequence(F.lit(1), F.size("s"))
    sound = numbers & (F.octet_length("block") == F.col("total")) & (F.col("copies") > 0)
    checked = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments don't add up: "), F.col("origin_id"))).cast("binary"))
    g = g.withColumn("block", checked).where(F.col("block").isNotNull())
    return g.select(F.explode(F.array_repeat(F.struct("page_id", "url", "type", "digest", F.lit(None).cast("long").alias("refers_to"), "block"), F.col("copies"))).alias("r")).select("r.*")


def _payloads(whole: DataFrame, with_html: bool) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts, digests = [], [], batch.column("digest").to_pylist()
            for kind, block, digest in zip(batch.column("type").to_pylist(), batch.column("block").to_pylist(), digests):
                payload = payload_of(block) if kind == "response" else None
                if payload is not None and digest_of(payload) != digest:
                    raise ValueError(f"payload doesn't match its digest {digest}")
                sizes.append(None if payload is None else len(payload))
                texts.append(payload.decode() if with_html and payload is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("type"), pa.array(sizes, pa.int64()), batch.column("digest"), batch.column("refers_to"), pa.array(texts, pa.string())],
                ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"])

    return whole.select("page_id", "url", "type", "digest", "refers_to", "block").mapInArrow(decode, _RESULT)


def read_archives(spark: SparkSession, manifest: DataFrame, with_html: bool = True) -> DataFrame:
    """Pages as they were written: ids, urls, record types, sizes and digests of
    the full payload, the page a revisit refers to, and with ``with_html`` the
    html of responses."""
    single, split = read_records(manifest, False), reassembled(read_records(manifest, True))
    columns = ["page_id", "url", "type", "digest", "refers_to", "block"]
    found = _payloads(single.select(*columns).union(split.select(*columns)), with_html)
    responses = _payloads(single.where("type = 'response'").select(*columns).union(split.select(*columns)), False).select(
        F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes")).distinct()
    same = (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest"))
    visits = found.where("record_type = 'revisit'").join(responses, same, "left").withColumn("payload_bytes", F.col("r_bytes")).select(*found.columns)
    return found.where("record_type <> 'revisit'").union(visits)
