"""WARC archives (operator 6): a writer of gzipped records with revisits, and a splittable reader.

Writing: each task writes its records, one gzip member each, to a file of its own in the shared
folder; the name holds a fresh id, so that a repeated task never touches another's file, and only
the files of tasks that ended well come into the manifest, a table that Spark commits.

Reading: archives are cut into byte ranges. A task looks in its range for gzip's magic bytes, takes
a place for a member if the start of what it decodes is a WARC header, and owns the records that
start in its range, whose ends may lie beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import fresh_path, join_small, materialize, wanted

LEAST_BYTES = 1000
SPLIT_BYTES, TASK_BYTES = 8 << 20, 64 << 20
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
DATE = "2020-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One member: a response with its payload, or a revisit that names the response and keeps only the HTTP head."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'urn:page:unknown')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """To ``pages`` (page_id, url, html) add payload and refers_to: the largest page_id with an equal payload of ``least_bytes`` or more, null for that page itself."""
    pages = pages.withColumn("payload", F.coalesce(F.encode("html", "utf-8"), F.lit(b""))).withColumn("digest", F.sha1("payload"))
    repeated = pages.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
    leaders = materialize(repeated.filter("n > 1 and leader is not null").select("digest", "leader"), "warc-leaders")
    joined = join_small(pages, leaders, ["digest"], "left", spread=F.col("page_id"))
    return joined.withColumn("refers_to", F.when(~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader"))).drop("leader", "digest")


def write_warc(pages: DataFrame, folder: str, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``, which all executors reach; returns the manifest (path, length, records).

    A null html is an empty payload, a null url a placeholder; rows that repeat a page_id are
    records like others. Other columns are ignored. An empty table gives an empty manifest.
    """
    pages = with_revisits(wanted(pages, {"page_id": "long", "url": "string", "html": "string"}), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, written, records, path = None, 0, 0, f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "refers_to")], strict=True):
                if stream is None:
                    where, name = _open(path)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = where.open_output_stream(name, compression=None)
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                stream.write(member)
                written, records = written + len(member), records + 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [written], "records": [records]})

    manifest = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, length long, records long")
    return materialize(manifest, "warc-manifest")


class _Window:
    """A file's bytes from some place on, read in pieces as they are asked for."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.path, self.file, self.at, self.held = path, where.open_input_file(name), 0, b""
        self.size = self.file.size()

    def bytes_at(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(max(n, _READ), at) if at < self.size else b""
        return self.held[at - self.at : at - self.at + n]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member at ``at`` and where it ends, or None if no WARC record begins there; an error if one does, but breaks off or doesn't hold what its checksum says."""
    squeezed = zlib.decompressobj(31)
    parts, place, seen = [], at, 0
    while not squeezed.eof:
        piece = window.bytes_at(place, 1 << 12 if place == at else 1 << 16)
        try:
            if not piece:
                raise zlib.error("the file ends in it")
            parts.append(squeezed.decompress(piece))
        except zlib.error as e:
            if _begins(window, at):
                raise ValueError(f"the record at {at} of {window.path} is damaged: {e}") from e
            return None
        place, seen = place + len(piece), seen + len(parts[-1])
        if seen >= 5 and not parts[0].startswith(b"WARC/") and not b"".join(parts).startswith(b"WARC/"):
            return None
    whole = b"".join(parts)
    return (whole, place - len(squeezed.unused_data)) if whole.startswith(b"WARC/") else None


def _begins(window: _Window, at: int) -> bool:
    """Whether a member at ``at`` begins like a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(window.bytes_at(at, 1 << 12), 5) == b"WARC/"
    except zlib.error:
        return False


def _scan(path: str, start: int, end: int) -> Iterator[bytes]:
    """The decoded records of ``path`` whose members start from ``start`` on and before ``end``.

    A file begins with a record, and one follows on the other: where none does, something is damaged,
    which is an error. The task that owns a record also looks whether the next one begins.
    """
    window, at = _Window(path), start
    due = 0 if start == 0 else None  # where a record has to begin
    while at < end:
        piece = window.bytes_at(at, min(_READ, end - at + len(MAGIC) - 1))
        found = piece.find(MAGIC)
        if due == at and found != 0:
            raise ValueError(f"no record begins at {at} of {path}")
        if found < 0 or at + found >= end:
            at += max(1, len(piece) - len(MAGIC) + 1)
            continue
        at += found
        got = _member(window, at)
        if got is None and due == at:
            raise ValueError(f"no record begins at {at} of {path}")
        if got is None:
            at += 1
        else:
            yield got[0]
            at = due = got[1]
    if due is not None and end <= due < window.size and not _begins(window, due):
        raise ValueError(f"no record begins at {due} of {path}")


def _parse(whole: bytes) -> dict:
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, cut, payload = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"-", block)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    return {
        "record_id": fields.get("warc-record-id"),
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"),
        "payload": payload,
        "payload_bytes": int(length[1]) if length and fields.get("warc-type") == "revisit" else len(payload),
        "declared_digest": base64.b32decode(digest).hex() if digest else None,
        "payload_digest": base64.b32decode(digest).hex() if digest and fields.get("warc-type") == "revisit" else hashlib.sha1(payload).hexdigest(),
    }


RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("declared_digest", pa.string()), ("payload_digest", pa.string())])


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that Spark finds under ``path``; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_warc(files: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``files`` (path, length): id, type, URI, refers_to_id, payload, payload_bytes and digests.

    payload_bytes and payload_digest are of the full payload: what a response holds, what a revisit
    declares. A response's declared digest is there to compare. Ranges are dealt in turn over tasks: one
    for each TASK_BYTES of all files, but, where there are as many ranges, four for each core at
    least. One record is held at a time. No files give no rows; empty files give none. A record that
    breaks off or fails its checksum, and bytes between records, are an error.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    there = files.filter("length > 0")
    whole = there.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.ceil(F.col("length") / split_bytes)), F.lit(0)).alias("ranges")).first()
    tasks = max(1, -(-whole.bytes // TASK_BYTES), min(int(whole.ranges), 4 * files.sparkSession.sparkContext.defaultParallelism))
    # the number is stated, as ranges are tiny rows that would else be put together for a few tasks
    ranges = there.select("path", "length", F.explode(starts).alias("start")).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out, size = [], 0
                for whole in _scan(path, start, min(length, start + split_bytes)):
                    out.append(_parse(whole))
                    size += len(whole)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, RECORD)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, RECORD)

    return ranges.mapInArrow(run, "record_id string, record_type string, target_uri string, refers_to_id string, payload binary, payload_bytes long, declared_digest string, payload_digest string")


def round_trip(pages: DataFrame, *, least_bytes: int = LEAST_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back: a row for each page."""
    folder = fresh_path(pages.sparkSession, "warc")
    records = read_warc(write_warc(pages, folder, least_bytes=least_bytes), split_bytes=split_bytes)
    found = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return records.select(found("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", found("refers_to_id").alias("refers_to"))
