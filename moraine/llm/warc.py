"""Operator 9: WARC archives, written one gzip member a record and read back by byte range.

Writing: records with equal payloads are grouped by digest; the one with the
smallest page_id is a response, the others are revisits that refer to it. Each
task writes one archive under a name of its own and renames it when it is whole.
Reading: archives are cut in byte ranges; a task scans its range for the gzip
magic, validates each candidate by decoding a WARC header, and owns the records
that start in its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import delete_at_end, map_texts, qualified, release, scratch, table

#: Bytes of a range that one task reads, bytes fetched at once, and bytes of a member looked at to find a header.
RANGE, FETCH, PROBE = 8 << 20, 1 << 20, 4096
#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
#: Revisits up to which their list is broadcast; otherwise payloads are shuffled to it.
BROADCAST_REVISITS = 1_000_000
_MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to=None, revisit: bool = False, place: str = "") -> bytes:
    """One record as a gzip member; a revisit has the length and digest of its payload but not the payload.

    ``place``, its archive and number there, makes the record's id its own also
    where page_ids repeat or are null; a revisit names the page that it refers to.
    """
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{place} {page_id}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filesystem(path: str):
    from pyarrow import fs

    # Hadoop writes file:/ where others write file:///.
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload (UTF-8 bytes of html; null: empty), revisit and refers_to.

    Of records with equal payloads those with the smallest page_id are
    responses. The minimum is taken with partial aggregates, so a payload that
    a third of the pages share is no single task's work.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    narrow = rows.where(F.length("payload") >= min_bytes).select("page_id", F.unhex(F.sha1("payload")).alias("sha"))
    first = narrow.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 and refers_to is not null").select("sha", "refers_to")
    again = narrow.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to").distinct()
    if again.count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.unhex(F.sha1("payload")) == F.col("again_sha"))
    rows = rows.join(again, same, "left")
    return rows.select("page_id", "url", "payload", F.col("again_sha").isNotNull().alias("revisit"), "refers_to")


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives to a shared folder; path, bytes and records of each archive, in a written table.

    A folder without a scheme is one of Spark's default file system.
    """
    folder = qualified(pages.sparkSession, folder)
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(f"{root}/warc", recursive=True)
        name, size, n, out = uuid.uuid4().hex, 0, 0, None
        for batch in batches:
            for page_id, url, payload, revisit, refers in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    out = system.open_output_stream(f"{root}/warc/.{name}")
                member = record(page_id, url, payload, refers, revisit, f"{name}/{n}")
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            system.move(f"{root}/warc/.{name}", f"{root}/warc/{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/warc/{name}.warc.gz"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], schema=schema)
        release()

    # An attempt that is lost leaves a file that the table of archives doesn't name.
    ddl = "path string, bytes bigint, records bigint"
    map_texts(with_revisits(pages, min_bytes), run, ddl).write.parquet(f"{folder}/archives")
    return pages.sparkSession.read.schema(ddl).parquet(f"{folder}/archives")


def parse(data: bytes) -> dict | None:
    """The headers and block of a whole record, or None if it is none."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers | {"block": rest[: int(headers.get("content-length", 0))]}


class _Window:
    """Bytes of a file from a moving position, fetched piece by piece."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.base, self.data = file, size, at, b""

    def upto(self, end: int) -> None:
        """Makes bytes before ``end`` of the file present, as far as it goes."""
        end = min(end, self.size)
        have = self.base + len(self.data)
        if have < end:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, min(FETCH, self.size - have)))

    def forget(self, before: int) -> None:
        if before - self.base > FETCH:
            self.data, self.base = self.data[before - self.base :], before


class DamagedArchive(ValueError):
    """An archive whose members don't follow one another without a gap."""


def _member(window: _Window, at: int, size: int) -> tuple[dict, int] | None:
    """The record whose member starts at ``at`` and the member's end, or None if none does."""
    window.upto(at + PROBE)
    try:
        head = zlib.decompressobj(31).decompress(window.data[at - window.base : at - window.base + PROBE], 8)
        if not head.startswith(b"WARC/1."):
            return None
        unpack, parts, here = zlib.decompressobj(31), [], at
        while not unpack.eof and here < size:
            window.upto(here + FETCH)
            piece = window.data[here - window.base : here - window.base + FETCH]
            parts.append(unpack.decompress(piece))
            here += len(piece) - len(unpack.unused_data)
    except zlib.error:
        return None
    made = parse(b"".join(parts)) if unpack.eof else None
    return None if made is None else (made, here)


def read_range(file, size: int, start: int, end: int, strict: bool = True) -> Iterator[dict]:
    """The records whose member starts in [start, end).

    The first is searched for; each next one has to start where the last ends,
    and where the range ends a member has to start or the file to end. So the
    ranges of a file together see each gap, also one that a damaged member
    leaves: a DamagedArchive, or with ``strict`` off skipped.
    """
    window, at, due = _Window(file, size, start), start, start == 0
    while at < min(end, size):
        window.forget(at)
        found = _member(window, at, size)
        if found is not None:
            yield found[0]
            at, due = found[1], True
            continue
        if due and strict:
            raise DamagedArchive(f"no whole record starts at byte {at}")
        due = False
        while True:  # the next magic
            at += 1
            window.forget(at)
            window.upto(at + FETCH)
            place = window.data.find(_MAGIC, at - window.base)
            if place >= 0:
                at = window.base + place
                break
            if window.base + len(window.data) >= size:
                return
            at = window.base + len(window.data) - len(_MAGIC)  # it may lie across the end of what is present
    if due and strict and at < size and _member(window, at, size) is None:
        raise DamagedArchive(f"no whole record starts at byte {at}")


def read(archives: DataFrame, range_bytes: int = RANGE, strict: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and html of every record.

    html is null for revisits; their length and digest are those of the full
    payload, from the record's headers. Those of responses come from the bytes
    that were read, and a response whose header disagrees is an error, as is a
    damaged or lost record unless ``strict`` is off.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = archives.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, where = _filesystem(path)
                rows: list[tuple] = []
                with system.open_input_file(where) as file:
                    for r in read_range(file, size, start, start + range_bytes, strict):
                        page = r.get("x-page-id")
                        sha = r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response":
                            payload = r["block"].partition(b"\r\n\r\n")[2]
                            if digest(payload) != sha:
                                raise ValueError(f"the payload of page {page} in {path} isn't what its digest says")
                            row = (len(payload), sha, "response", None, r["warc-target-uri"], payload.decode())
                        else:
                            row = (int(r["x-payload-length"]), sha, "revisit", int(r["x-refers-to-page-id"]), r["warc-target-uri"], None)
                        rows.append((None if page is None else int(page), *row))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, html string"
    return ranges.repartition(max(1, min(ranges.count(), 10_000)), "path", "start").mapInArrow(run, ddl)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A row for each row of pages, as read back from archives in the shared folder.

    Null html counts as empty, null urls are empty, a null page_id stays null
    and ranks last. Of equal payloads with the same smallest page_id all are
    responses, so repeated rows keep a row each. Pages of any length are written
    whole. An empty table gives no rows; columns but page_id, url and html are
    not read. The archives are deleted when the session's file systems close.
    """
    folder = scratch(pages.sparkSession, "warc")
    archives = write(pages, folder, min_bytes)
    delete_at_end(pages.sparkSession, folder)
    return read(archives)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as x from pages),
f as (select payload, min(page_id) as first_id from p group by payload)
select page_id, cast(strlen(p.payload) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(x, cast(1 + 10 * (i // 8) as integer), 10) as bigint) >> cast(35 - 5 * (i % 8) as integer)) & 31 as integer) + 1, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from p join f using (payload)"""
