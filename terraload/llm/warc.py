"""WARC archives: one gzip member for each record, written by tasks and read in byte ranges.

The reader is splittable. A task gets a byte range, looks for the gzip magic in it, and takes a
place for the start of a record only if decoding there gives a WARC header. From the first such place on it
follows member after member, and owns each record that starts inside its range, reading past the
range's end where the last one does. A broken member is passed over to the next valid start.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from terraload.llm.scratch import Scratch, bounded_batches
from terraload.sources.files import open_input, publish_file

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 16 << 20
_READ = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, record_id string, refers_to_id string"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    """The page of a record id written here; other archives' ids have none."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", name or "")
    return int(found[1]) if found and -1 << 63 <= int(found[1]) < 1 << 63 else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record as a gzip member; a revisit holds the HTTP header but no payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=%-._~"))
    if refers_to is None:
        body += payload
    else:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + packer.flush()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        size = count = 0
        with publish_file(path) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    member = record(page_id, url, (html or "").encode(), refers_to, date)
                    out.write(member)
                    size, count = size + len(member), count + 1
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})
    return run


def write_warc(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, folder: str | None = None,
               date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` (``page_id, url, html``); ``path, bytes, records`` of the files.

    Of records with equal payloads of at least ``least_bytes``, that with the largest ``page_id`` is a
    response (all of them, if rows repeat it), and the others revisit it. A null html is an empty
    payload; a null ``page_id`` is never referred to, and payloads that only such rows have are
    responses. Payloads are compared by SHA-1 and length.
    """
    bounded_batches(pages.sparkSession, rows=2000)
    folder = folder or scratch.path("files")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                        F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    owners = (rows.where(F.col("size") >= least_bytes).groupBy("digest", "size")
              .agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 AND owner IS NOT NULL").drop("n"))
    owners = scratch.keep(owners, "owners")
    marked = rows.join(owners, ["digest", "size"], "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))
    return scratch.keep(marked.mapInArrow(_write(folder, date), "path string, bytes long, records long"), "written")


class _Window:
    """Bytes of a file from a place on, read as needed. What is read is appended, never copied as a whole."""

    def __init__(self, handle, start: int):
        self.handle, self.base, self.data = handle, start, bytearray()
        handle.seek(start)

    def fill(self) -> bool:
        more = self.handle.read(_READ)
        self.data += more
        return bool(more)

    def drop_before(self, place: int) -> None:
        del self.data[:place - self.base]
        self.base = place


def _member(window: _Window, place: int) -> tuple[bytes, int] | None:
    """The content of the member at a place and its end; None if none with a WARC header is whole there."""
    unpacker = zlib.decompressobj(31)
    out: list[bytes] = []
    at, head = place - window.base, b""
    try:
        while not unpacker.eof:
            if at >= len(window.data) and not window.fill():
                return None
            part = bytes(window.data[at:at + _READ])
            piece = unpacker.decompress(part)
            at += len(part)
            out.append(piece)
            if len(head) < 7:
                head += piece[:7]
                if not b"WARC/1.".startswith(head[:7]):
                    return None
    except zlib.error:
        return None
    return b"".join(out), window.base + at - len(unpacker.unused_data)


def members(handle, start: int, end: int) -> Iterator[bytes]:
    """Contents of the valid members that start in ``start:end``."""
    window, place = _Window(handle, start), start
    while place < end:
        while (found := window.data.find(MAGIC, place - window.base)) < 0:
            place = max(place, window.base + len(window.data) - len(MAGIC) + 1)
            if place >= end or not window.fill():
                return
        place = window.base + found
        if place >= end:
            return
        window.drop_before(place)
        got = _member(window, place)
        if got is None:
            place += 1
        else:
            yield got[0]
            place = got[1]


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, in lower case, and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = _number(headers.get("content-length"))
    return headers, rest if size is None else rest[:size]


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch("[0-9]{1,18}", text.strip()) else None


def _fields(content: bytes) -> tuple | None:
    headers, block = parse(content)
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    # Other protocols' blocks are payload as a whole.
    http, _, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").lower().startswith("application/http") else (b"", b"", block)
    if kind == "response":
        size, digest = len(payload), payload_digest(payload)
    else:
        sizes = [line.partition(b":")[2].decode("latin-1") for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, digest, payload = _number(sizes[0]) if sizes else None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, b""
    name, refers_to = headers.get("warc-record-id"), headers.get("warc-refers-to")
    return _page(name), size, digest, kind, _page(refers_to), headers.get("warc-target-uri"), payload, name, refers_to


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                       ("record_id", pa.string()), ("refers_to_id", pa.string())])
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            rows, size = [], 0
            with open_input(path) as handle:
                for content in members(handle, start, end):
                    if (fields := _fields(content)) is not None:
                        rows.append(fields)
                        size += len(content)
                    if size >= _READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of files given as ``path, bytes``: ids, payload sizes and digests, types, and payloads.

    A response's digest is taken from the payload that was read, a revisit's from its header; a
    revisit's payload is empty. ``record_id`` and ``refers_to_id`` are the ids as the archive has them; ``page_id`` and
    ``refers_to`` are null where these are not ids written here. What a revisit's header does not tell is null. Records of
    other types are left out.
    """
    spark: SparkSession = files.sparkSession
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.where("bytes > 0").select("path", "bytes", begin)
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + range_bytes).alias("end"))
    ranges = ranges.repartition(max(8, spark.sparkContext.defaultParallelism))
    return ranges.mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and read all records back, in byte ranges."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, scratch, least_bytes))
