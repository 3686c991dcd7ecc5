"""WARC archives: writing one record per page, and reading archives by byte ranges.

Writing: pages of equal payload (at least SMALL bytes) are found by digest; the one of least page_id becomes a response
record, the others revisit it. Each task writes one archive of gzip members, one member per record, into a new folder
below the session's shared one, under a name of its own attempt; the archives that count are those that the tasks which
ended well report, so a lost or repeated task leaves nothing wrong behind.

Reading: an archive is split into byte ranges. The task of a range scans for the gzip magic, takes a place for a member if
what it inflates to begins with a WARC version line and a whole header, and owns the records that begin inside the range;
the last one is read beyond the range's end. Behind a record the next one follows without a scan. Ranges of any
size give the same records. Payloads are checked against their digests.

Null html is an empty payload. Pages without id are left out; repeated ids give a record each, and those that share the
response's id are responses as well. Other columns are not read. An empty table gives no archive and no rows."""
from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from voxtable.functions.stage import root, stage

from .common import table

SMALL, RANGE, LEVEL = 100, 4 << 20, 4
_CHUNK = 1 << 16
_MAGIC = b"\x1f\x8b\x08"


def _open(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url if "://" in url else f"file://{url}") if not url.startswith("file:/") else (pafs.LocalFileSystem(), "/" + url.removeprefix("file:").lstrip("/"))


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record before compression. A revisit has the length and digest of its payload, but not the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + (payload if refers_to is None else b"")
    clean = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        fs, place = _open(path)
        out, size, records = None, 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(place, compression=None)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = z.compress(record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)) + z.flush()
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "bytes", "records"])
    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the (written) list of archives (path, bytes, records)."""
    folder = folder or f"{root(pages.sparkSession)}/warc-{uuid.uuid4().hex[:8]}"
    plain = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    told = plain.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("large", F.octet_length("html") >= SMALL)
    first = stage(told.where("large").groupBy("digest").agg(F.min("page_id").alias("first")), "first")
    joined = told.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.expr("if(large and first <> page_id, first, null)").alias("refers_to"))
    return stage(joined.mapInArrow(_writer(folder), "path string, bytes bigint, records bigint"), "archives")


class _Source:
    """A file's bytes, read in chunks from some place on."""

    def __init__(self, path: str, size: int):
        fs, place = _open(path)
        self.file, self.size, self.at, self.held = fs.open_input_file(place), size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        """n bytes from start on, or what there is."""
        if not self.at <= start <= start + n <= self.at + len(self.held):
            self.at = start
            self.held = self.file.read_at(max(0, min(max(n, _CHUNK), self.size - start)), start)
        return self.held[start - self.at:start - self.at + n]


def _member(source: _Source, start: int) -> tuple[bytes, int] | None:
    """The inflated record at a place and where it ends; None if no record begins there."""
    z, out, at = zlib.decompressobj(31), [], start
    known = False
    while not z.eof:
        raw = source.read(at, min(_CHUNK, source.size - at))
        if not raw:
            return None
        try:
            out.append(z.decompress(raw))
        except zlib.error:
            return None
        at += len(raw)
        if not known:
            begin = b"".join(out)
            if not begin.startswith(b"WARC/1."[:len(begin)]):
                return None
            known = len(begin) >= 7
    whole = b"".join(out)
    return (whole, at - len(z.unused_data)) if known and b"\r\n\r\n" in whole else None


def parse_record(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda s: int(s.removeprefix("<urn:page:").removesuffix(">")) if s else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "record_type": kind,
            "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


def records_of(path: str, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records that begin in a byte range of an archive."""
    source, at = _Source(path, size), start
    while at < end:
        window = source.read(at, min(_CHUNK, size - at))
        k = 0 if window.startswith(_MAGIC) else window.find(_MAGIC)
        if k < 0:
            at += max(1, len(window) - 2)
            continue
        at += k
        if at >= end:
            return
        found = _member(source, at)
        if found is None:
            at += 1
            continue
        yield found[0]
        at = found[1]


def _reader(payloads: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for raw in records_of(path, size, start, end):
                    rows.append(parse_record(raw))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
    return run


def read_archives(archives: DataFrame, size: int = RANGE, payloads: bool = False) -> DataFrame:
    """The records of archives (path, bytes): (page_id, payload_bytes, payload_digest, record_type, refers_to), with
    url and payload (null for revisits) if wanted."""
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {size}L)")).alias("start"))
    ranges = ranges.select("path", "bytes", "start", F.least(F.col("start") + size, "bytes").alias("end"))
    # A few ranges per task; each row stands for megabytes.
    tasks = max(1, min(ranges.count(), 20_000))
    out = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * payloads
    return ranges.repartition(tasks).mapInArrow(_reader(payloads), out)


def op3_warc(spark, folder: str) -> DataFrame:
    return read_archives(write_archives(table(spark, folder, "pages")))
