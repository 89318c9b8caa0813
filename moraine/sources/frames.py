"""Binary entries and the segments of a write-ahead log.

A frame is the payload's length (8 bytes), a checksum of it (4) and the payload:
time (16), key length (8), key, a tag (1 if live) and, if live, value length (8)
and value; integers are little-endian. A segment is a file ``segment-N`` of
frames, padded with zeros once it is full.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Entry = tuple[int, bytes, bytes | None]  # time, key, value or None for a delete
SEGMENT = re.compile(r"segment-(\d+)$")


def checksum(payload: bytes) -> int:
    return zlib.crc32(payload) ^ 0xFFFFFFFF


def encode(ts: int, key: bytes, value: bytes | None) -> bytes:
    live = b"\0" if value is None else b"\1" + struct.pack("<Q", len(value)) + value
    payload = ts.to_bytes(16, "little") + struct.pack("<Q", len(key)) + key + live
    return struct.pack("<QI", len(payload), checksum(payload)) + payload


def decode(data: bytes, torn: bool = False) -> Iterator[Entry]:
    """The entries of a segment up to its padding; a damaged one is an error.

    With ``torn`` a frame that the end of the data cuts off ends it: what a
    crash in the middle of a write leaves.
    """
    at = 0
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<Q", data, at)
        if size == 0:
            return
        payload = data[at + 12 : at + 12 + size]
        if torn and at + 12 + size > len(data):
            return
        if len(payload) < size or checksum(payload) != struct.unpack_from("<I", data, at + 8)[0]:
            raise ValueError(f"a damaged entry at byte {at}")
        (n,) = struct.unpack_from("<Q", payload, 16)
        end = 24 + n
        if end + 1 > size:
            raise ValueError(f"a damaged entry at byte {at}")
        value = None
        if payload[end]:
            (m,) = struct.unpack_from("<Q", payload, end + 1)
            value = payload[end + 9 : end + 9 + m]
            end += 8 + m
        if end + 1 != size:
            raise ValueError(f"an entry at byte {at} has bytes left over")
        yield int.from_bytes(payload[:16], "little"), payload[24 : 24 + n], value
        at += 12 + size


def segments(entries: Iterable[Entry], segment_bytes: int) -> Iterator[bytes]:
    """Entries packed into segments; one that doesn't fit opens the next, one that fits none is an error."""
    now = b""
    for entry in entries:
        frame = encode(*entry)
        if len(frame) > segment_bytes:
            raise ValueError(f"an entry of {len(frame)} bytes fits no segment")
        if len(now) + len(frame) > segment_bytes:
            yield now.ljust(segment_bytes, b"\0")
            now = b""
        now += frame
    if now:
        yield now.ljust(segment_bytes, b"\0")


class SegmentGap(ValueError):
    """A log whose segments aren't numbered without gaps."""


class WriteAheadLog:
    """The segments of a folder, appended to by one writer.

    Opening finds the segments, which have to be numbered without gaps, and goes
    on in the last one. An entry that doesn't fit opens the next segment. Each
    entry is handed to the file system before ``append`` returns.
    """

    def __init__(self, folder: str, segment_bytes: int):
        self.system, self.root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder if ":" in folder else os.path.abspath(folder)))
        self.segment_bytes = segment_bytes
        self.system.create_dir(self.root, recursive=True)
        found = self.segments()
        if found and found != list(range(found[0], found[-1] + 1)):
            raise SegmentGap(f"segments {found} of {folder} aren't without gaps")
        self.index = found[-1] if found else 0
        self.used = len(self._read(self.index)) if found else 0
        if found:  # what a crash has torn off goes
            whole = sum(len(encode(*e)) for e in decode(self._read(self.index), torn=True))
            if whole < self.used:
                self._replace(self.index, self._read(self.index)[:whole])
                self.used = whole

    def path(self, index: int) -> str:
        return f"{self.root}/segment-{index}"

    def segments(self) -> list[int]:
        files = self.system.get_file_info(fs.FileSelector(self.root))
        return sorted(int(m[1]) for f in files if f.is_file and (m := SEGMENT.fullmatch(f.base_name)))

    def _read(self, index: int) -> bytes:
        with self.system.open_input_stream(self.path(index)) as f:
            return f.read()

    def _replace(self, index: int, data: bytes) -> None:
        with self.system.open_output_stream(self.path(index)) as f:
            f.write(data)

    def roll(self) -> None:
        """Fills the segment up and begins the next."""
        with self.system.open_append_stream(self.path(self.index)) as f:
            f.write(bytes(self.segment_bytes - self.used))
        self.index, self.used = self.index + 1, 0

    def append(self, ts: int, key: bytes, value: bytes | None) -> None:
        frame = encode(ts, key, value)
        if len(frame) > self.segment_bytes:
            raise ValueError(f"an entry of {len(frame)} bytes fits no segment")
        if self.used + len(frame) > self.segment_bytes:
            self.roll()
        with self.system.open_append_stream(self.path(self.index)) as f:
            f.write(frame)
        self.used += len(frame)

    def entries(self) -> Iterator[Entry]:
        found = self.segments()
        for index in found:
            yield from decode(self._read(index), torn=index == found[-1])

    def purge(self) -> None:
        """Deletes all segments; the next one has the next number."""
        for index in self.segments():
            self.system.delete_file(self.path(index))
        self.index, self.used = self.index + 1, 0


def write_segments(frames_: DataFrame, folder: str, segment_bytes: int, shift: int = 0) -> DataFrame:
    """Writes (shard, segment, ts, seq, key, value, is_tombstone) as folder/SHARD/segment-N; path and entries of each file.

    Each segment is one task's work and bounded; ``shift`` bits of an entry's
    time hold its seq, and one that needs more is an error.
    """
    schema = pa.schema([("path", pa.string()), ("entries", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def made():
            system, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", f"{folder}/{at[0]}"))
            system.create_dir(root, recursive=True)
            (data,) = segments(held, segment_bytes)
            with system.open_output_stream(f"{root}/segment-{at[1]}") as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{at[0]}/segment-{at[1]}"]), pa.array([len(held)], pa.int64())], schema=schema)

        for batch in batches:
            for shard, segment, ts, seq, key, value, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None and (shard, segment) != at:
                    yield made()
                    held = []
                at = shard, segment
                if shift and not 0 <= seq < 1 << shift:
                    raise ValueError(f"seq {seq} doesn't fit {shift} bits")
                held.append(((ts << shift) | (seq if shift else 0), key.encode(), None if gone else (value or "").encode()))
        if held:
            yield made()

    rows = frames_.select("shard", "segment", "ts", "seq", "key", "value", "is_tombstone")
    return rows.repartition("shard", "segment").sortWithinPartitions("shard", "segment", "ts", "seq").mapInArrow(run, "path string, entries bigint")


def read_segments(spark: SparkSession, folder: str, shift: int = 0) -> DataFrame:
    """segment, seq (place in it), ts, key, value and is_tombstone of the entries of all segments of a folder and its folders.

    With ``shift`` the low bits of an entry's time are its seq.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                entries = enumerate(decode(data))
                while some := list(islice(entries, 10_000)):
                    rows = [(int(SEGMENT.search(path)[1]), ts & ((1 << shift) - 1) if shift else i, ts >> shift, key.decode(), value, value is None) for i, (ts, key, value) in some]
                    yield pd.DataFrame(rows, columns=["segment", "seq", "ts", "key", "value", "is_tombstone"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "segment-*").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.col("path").rlike(r"/segment-\d+$")).select("path", "content")
    return files.mapInPandas(run, "segment bigint, seq bigint, ts bigint, key string, value binary, is_tombstone boolean")
