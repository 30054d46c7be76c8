"""WARC archives: a writer with revisit records and a splittable reader.

Writing: each task streams its pages into gzip members, one record each, in
files of its own in the shared folder. A task that is run again writes new
files; only the files in the written manifest count, so lost executors and
repeated attempts leave no doubles. Of records with equal payloads of at least
``least`` bytes, the one with the smallest page_id is a response and the others
are revisits without the payload.

Reading: files are cut into byte ranges. A task scans its range for the gzip
magic, accepts a candidate only if it inflates to a WARC header, and then follows
member by member. It owns the records that start inside its range and reads past
the end for the last one.

Edge cases: null html is an empty payload, which counts as a payload of 0 bytes;
rows repeated with the smallest page_id are responses too; a null page_id is
larger than any other, and if all are null all are responses; a null url leaves
the target out; an empty table gives empty archives and an empty table; extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, small_batches, written

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 16
FILE_BYTES = 256 << 20
DATE = "2026-01-01T00:00:00Z"
_URN = "urn:page:"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 3) -> bytes:
    """One gzip member; a revisit if ``refers_to`` is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_URN}{'null' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
    return _member(headers, http if refers_to is not None else http + payload, level)


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null: a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_bytes"))
    # Written, the repeated payloads have a known size: small ones are broadcast, others join in a shuffle that splits crowded keys.
    firsts = written(keyed.where(F.col("_bytes") >= least).groupBy("_sha1", "_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "payloads")
    joined = keyed.join(firsts, ["_sha1", "_bytes"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all pages; the manifest: path and size of each archive."""
    small_batches(pages.sparkSession)
    folder = fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, made = None, "", 0, []
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True)
            for page_id, url, html, refers_to in rows:
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    size = out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", 3))
                size += out.write(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
                if size >= file_bytes:
                    out.close()
                    made.append((name, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, size))
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{n}" for n, _ in made], pa.string()), "size": pa.array([s for _, s in made], pa.int64())})

    return written(marked(pages, least).mapInArrow(run, "path string, size long"), "manifest")


@dataclass
class Member:
    start: int
    data: bytes


class Scanner:
    """Members that start in a byte range of a file."""

    def __init__(self, source: pa.NativeFile, start: int, end: int) -> None:
        self.source, self.start, self.end = source, start, end
        self.at, self.held = start, b""

    def _bytes(self, at: int, n: int) -> bytes:
        """n bytes from ``at``, fewer at the end of the file; reads go forward in chunks."""
        if not self.at <= at <= self.at + len(self.held):
            self.at, self.held = at, b""
        if at > self.at:
            self.held, self.at = self.held[at - self.at :], at
        while len(self.held) < n:
            more = self.source.read_at(max(CHUNK, n), self.at + len(self.held))
            if not more:
                break
            self.held += more
        return self.held[:n]

    def _inflated(self, at: int) -> tuple[bytes, int] | None:
        """The member at ``at`` and where the next begins, if it is a record."""
        unpack = zlib.decompressobj(31)
        parts, next_at = [], at
        try:
            while not unpack.eof:
                piece = self._bytes(next_at, CHUNK)
                if not piece:
                    return None
                parts.append(unpack.decompress(piece))
                next_at += len(piece) - len(unpack.unused_data)
                if len(parts) == 1 and not parts[0].startswith(b"WARC/"):
                    return None
        except zlib.error:
            return None
        return b"".join(parts), next_at

    def __iter__(self) -> Iterator[Member]:
        at = self.start
        while at < self.end:
            window = self._bytes(at, CHUNK)
            if len(window) < len(MAGIC):
                return
            found = window.find(MAGIC)
            if found < 0:
                at += len(window) - len(MAGIC) + 1
                continue
            at += found
            if at >= self.end:
                return
            got = self._inflated(at)
            if got is None:
                at += 1
                continue
            yield Member(at, got[0])
            at = got[1]


def parsed(member: bytes) -> dict | None:
    """A response or revisit as a row, else None."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    kind = fields.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if x and (m := re.search(rf"{_URN}(-?\d+)>", x)) else None
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != declared:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    else:
        size, digest = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1]), declared
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "target_uri": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload.decode("utf-8", "replace") if kind == "response" else None,
    }


_ROW = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 32 << 20, payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path, size); ``payload`` adds the text of responses."""
    total = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    starts = manifest.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = starts.repartition(int(total), "path", "start")
    schema = _ROW if payload else _ROW.remove(len(_ROW) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = file_system(path)
                with fs.open_input_file(at) as source:
                    rows, size = [], 0
                    for member in Scanner(source, start, start + split_bytes):
                        if row := parsed(member.data):
                            rows.append(row)
                            size += len(member.data) if payload else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * payload
    return ranges.mapInArrow(run, kinds)
