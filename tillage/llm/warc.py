"""WARC: archives written by tasks, read back record by record, and segmented records put together again.

Writing: a response record per row, its payload in chunked transfer framing behind HTTP headers, in segments where the
block is long (the first is the response, the others are continuations that name it as their origin, the last states
the total length). Of rows with equal payloads of some size, the one with the largest id is the response and the others
are revisits without a payload, which name it by its record id, address and date. A record's id follows from its page,
address and payload, and where a task has such a record already or the page has no id, from its place in the task, so a
task that runs again gives the same ids and no id is that of more records than there are tasks. Each record is a gzip member; a task writes files of
a bounded size under names of its own, and only the files that successful tasks report are read.

Reading: any WARC/1.0 or 1.1 file, plain or gzip. Continuations meet their origin in a grouping by its identifier, are
put in the order of their segment numbers, and must be all there and have the stated total length. The payload is the
block of a response behind its HTTP headers, chunked framing decoded. A malformed archive is an error.

Null payloads count as empty, null urls as "". Every row gives one record; an empty table gives no files. Rows without an
id are responses, or revisit the response of equal payload that has one. Rows of equal id and payload are all responses
or all revisits; equal rows come back as often as they were written. A page id that is no whole number is an error. A very long payload is many
segments, with memory in proportion to it. Only id, url and payload are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
from collections.abc import Iterator

import hashlib
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, written

#: Bytes of payload from which equal ones are written once.
REVISIT_BYTES = 1000
#: Bytes of a record's block beyond which it is segmented, of an archive file, and of a chunk.
SEGMENT_BYTES = 32 << 10
FILE_BYTES = 32 << 20
CHUNK_BYTES = 8 << 10
#: Payloads of more than one row in so many are dealt with apart.
HOT = 10_000
#: What a revisit record's profile is called.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked framing breaks off")
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def segments(headers: list[tuple[str, str]], block: bytes, own: str, most: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record of a block, or its first segment and continuations. headers[0] is the type; `own` is the record's id."""
    if len(block) <= most:
        yield record([*headers, ("WARC-Record-ID", own)], block)
        return
    parts = [block[i : i + most] for i in range(0, len(block), most)]
    yield record([*headers, ("WARC-Record-ID", own), ("WARC-Segment-Number", "1")], parts[0])
    shared = [h for h in headers[1:] if h[0] in ("WARC-Date", "WARC-Target-URI")]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}#{k}')}>"
        yield record([("WARC-Type", "continuation"), *shared, ("WARC-Record-ID", name), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *total], part)


def record_id(page_id: int | None, url: str, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}{place}')}>"


def page_records(page_id: int | None, url: str, payload: bytes, response: tuple[int, str] | None, date: str, most: int, known: set[str], place: str) -> Iterator[bytes]:
    """The records of one page: `response` is the page that it revisits, id and url, or None; `known` are the ids that the task has
    given already, `place` is where in the task it is."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = record_id(page_id, url, digest)
    if page_id is None or own in known:
        own = record_id(page_id, url, digest, f" {place}")
    known.add(own)
    headers = [("WARC-Type", "response" if response is None else "revisit"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if response is None:
        yield from segments(headers, http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload), own, most)
    else:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(*response, digest)), ("WARC-Refers-To-Target-URI", response[1]), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(response[0]))]
        yield record([*headers, ("WARC-Record-ID", own)], http + b"Content-Length: %d\r\n\r\n" % len(payload))


def _origins(pages: DataFrame, least: int) -> DataFrame:
    """pages with `_response`: id and url of the row of the largest id (then url) among those of equal payload, where the payload
    is long enough. Shorter ones pass around the join."""
    long = F.octet_length("payload") >= least
    sized = pages.filter(long).withColumn("_key", F.unhex(F.sha2("payload", 256)))
    # One row for each payload, from what each task has summed up; a payload of a third of all rows is one row here.
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    most = written(sized.groupBy("_key").agg(F.max(known).alias("_response"), F.count("*").alias("_n")), "warc-payloads")
    # Payloads of more than one row in HOT, which HOT at most can be, meet their rows where these are; the rows go on by a key
    # of their own, so that no task of the join has all of them.
    total = most.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    several = most.filter("_n > 1")
    hot = several.filter(F.col("_n") * HOT > total).select("_key", F.col("_response").alias("_hot"), F.lit(True).alias("_is_hot"))
    met = sized.join(F.broadcast(hot), "_key", "left")
    alone = F.unhex(F.sha2(F.concat_ws(" ", F.coalesce("page_id", F.monotonically_increasing_id()).cast("string"), "url"), 256))
    met = met.withColumn("_key", F.when(F.col("_is_hot"), alone).otherwise(F.col("_key"))).join(several.drop("_n"), "_key", "left")
    met = met.withColumn("_response", F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_response"))).drop("_key", "_hot", "_is_hot")
    return met.unionByName(pages.filter(~long).withColumn("_response", F.lit(None).cast(most.schema["_response"].dataType)))


def write(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write every row as a record in a folder that all executors share (a new one by default); the list of files: path, n_records."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = _origins(source, least).select("page_id", "url", "payload", F.col("_response.page_id"), F.col("_response.url").alias("response_url"))
    rows = rows.toDF("page_id", "url", "payload", "response", "response_url")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = fs.FileSystem.from_uri(folder)
        files.create_dir(where, recursive=True)
        attempt, task = uuid.uuid4(), TaskContext.get().partitionId()
        name, out, size, n, nth, row = "", None, 0, 0, 0, 0
        known: set[str] = set()
        for batch in batches:
            for page_id, address, payload, response, at in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    name = f"pages-{attempt.hex}-{nth:05d}.warc.gz"
                    out, size, n, nth = files.open_output_stream(f"{where}/{name}", compression=None), 0, 0, nth + 1
                origin = None if response is None or response == page_id else (response, at)
                row += 1
                for one in page_records(page_id, address, payload, origin, date, segment_bytes, known, f"{task}.{row}"):
                    size += out.write(member := gzip.compress(one, 4, mtime=0)) or len(member)
                n += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "n_records"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return written(rows.mapInArrow(save, "path string, n_records long"), "warc-list")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive (not compressed): headers by lower-case name, and the block."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, mark, value = line.decode("utf-8", "replace").partition(":")
            if not mark:
                raise ValueError(f"not a header: {line[:40]!r}")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record breaks off")
        yield headers, block


RECORDS = "record_id string, record_type string, url string, payload_digest string, page_id long, refers_to long, origin string, segment int, total_length long, block binary"


def records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Every record of the archives in files.path, segments apart."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw:
                    head = raw.read(1 << 20)
                    rest = io.BufferedReader(_Joined(head, raw), 1 << 20)
                    stream = gzip.GzipFile(fileobj=rest) if head[:2] == b"\x1f\x8b" else rest
                    for h, block in parse(stream):
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        segment = number("warc-segment-number")
                        origin = h.get("warc-segment-origin-id") or (h.get("warc-record-id") if segment else None)
                        rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest"), number("x-page-id"), number("x-refers-to-page-id"), origin, segment, number("warc-segment-total-length"), block))
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=names)

    return files.select("path").repartition(n).mapInArrow(load, RECORDS)


_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a stream."""

    def __init__(self, head: bytes, rest: pa.NativeFile):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        if self.head:
            part, self.head = self.head[: len(into)], self.head[len(into) :]
        else:
            part = self.rest.read(len(into))
        into[: len(part)] = part
        return len(part)


def reassembled(parts: DataFrame) -> DataFrame:
    """Records as a whole: `block` of those without segments, and the segments of the others, grouped by their origin, as
    `parts` with the stated `total`. A group is one record: as large as the record's block, times the archives' copies of it, of
    which there is one for each task at most in those written here."""
    names = [c for c in parts.columns if c not in ("origin", "segment", "total_length")]
    piece = "array<struct<segment:int,block:binary>>"
    whole = parts.filter("segment is null").select(*names, F.lit(None).cast(piece).alias("parts"), F.lit(None).cast("long").alias("total"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = parts.filter("segment is not null").groupBy("origin").agg(
        *[first(c) for c in names if c != "block"], F.lit(None).cast("binary").alias("block"), F.collect_list(F.struct("segment", "block")).alias("parts"), F.max("total_length").alias("total")
    )
    return whole.unionByName(groups.select(*names, "parts", "total"))


def joined(parts: list[dict], total: int | None, origin: str) -> tuple[bytes, int]:
    """The block of a record from its segments in any order, and how often it is there; missing, unlike or too long ones are an error."""
    by_number: dict[int, list[bytes]] = {}
    for p in parts:
        by_number.setdefault(p["segment"], []).append(p["block"])
    numbers = sorted(by_number)
    copies = len(by_number.get(1, ()))
    block = b"".join(by_number[k][0] for k in numbers)
    if numbers != list(range(1, len(numbers) + 1)) or len(block) != total or any(len(own) != copies or any(x != own[0] for x in own) for own in by_number.values()):
        raise ValueError(f"segments are missing or too long: {origin}")
    return block, copies


PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _http(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def pages(whole: DataFrame, with_payload: bool = True) -> DataFrame:
    """Of whole records, the responses and revisits: page_id, url, payload_bytes, payload_digest (hexadecimal), record_type,
    refers_to and the payload (null for revisits). A payload that doesn't have the digest of its record is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block, copies = (r["block"], 1) if r["parts"] is None else joined(r["parts"], r["total"], r["record_id"])
                headers, body = _http(block)
                stated = base64.b32decode((r["payload_digest"] or "").partition(":")[2]).hex() or None
                if r["record_type"] == "revisit":
                    rows += [(r["page_id"], r["url"], int(headers.get(b"content-length", b"0")), stated, "revisit", r["refers_to"], None)] * copies
                    continue
                payload = unchunked(body) if headers.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                digest = hashlib.sha1(payload).hexdigest()
                if stated not in (None, digest):
                    raise ValueError(f"the payload of {r['record_id']} doesn't have the digest stated")
                rows += [(r["page_id"], r["url"], len(payload), digest, "response", None, payload if with_payload else None)] * copies
            columns = zip(*rows) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split(" ")[0] for c in PAGES.split(", ")])

    kept = whole.filter(F.col("record_type").isin("response", "revisit"))
    return kept.select("record_id", "record_type", "url", "payload_digest", "page_id", "refers_to", "block", "parts", "total").mapInArrow(run, PAGES)


def read(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The pages of the archives in files.path."""
    return pages(reassembled(records(spark, files)), with_payload)
