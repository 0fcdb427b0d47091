"""PCAP and PCAPNG files as a Spark data source, batch and streaming, and an exporter.

``spark.read.format("pcap").load(path)``: one partition a file, records in capture order with a sequence from 1, container
faults are errors. ``readStream`` takes rotated files of a directory as they appear. Paths go through Hadoop's file
system where the session gives file contents (``records_of_files``), so captures can be wherever Spark reads.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from wirelake import schema
from wirelake.errors import DecodeError

MAX_INTERFACES = 4096
#: Magic numbers (as little-endian bytes give them): order and fractions a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
NG = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, OLD_PACKET, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6


def bad(message: str) -> DecodeError:
    return DecodeError("CAPTURE", message)


Record = tuple[int, int, int, int | None, int, int, int, bytes]  # sequence, section, interface, ns, captured, original, link, data


def records(data: bytes) -> Iterator[Record]:
    """Records of a capture, by its first four bytes; may be left early."""
    yield from _ng(data) if data[:4] == NG else _classic(data)


def _classic(data: bytes) -> Iterator[Record]:
    if data[:4] not in MAGIC or len(data) < 24:
        raise bad("no capture file")
    order, scale = MAGIC[data[:4]]
    link, at, n = struct.unpack_from(f"{order}I", data, 20)[0] & 0x0FFFFFFF, 24, 0
    while at < len(data):
        if at + 16 > len(data):
            raise bad("a record header ends too early")
        sec, frac, captured, original = struct.unpack_from(f"{order}IIII", data, at)
        at += 16
        if captured > original or at + captured > len(data):
            raise bad("a record that is longer than its packet, or than the file")
        n += 1
        yield n, 0, 0, sec * 1_000_000_000 + frac * scale, captured, original, link, data[at : at + captured]
        at += captured


def _options(body: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(f"{order}HH", body, at)
        if not code:
            break
        if at + 4 + size > len(body):
            raise bad("an option ends too early")
        out.setdefault(code, body[at + 4 : at + 4 + size])
        at += 4 + (size + 3 & ~3)
    return out


def _time(ticks: int, resolution: int, offset: int) -> int:
    """Nanoseconds of ticks: 10^-n or, with the high bit, 2^-n seconds."""
    n = resolution & 0x7F
    units = 1 << n if resolution & 0x80 else 10**n
    return ticks * 1_000_000_000 // units + offset * 1_000_000_000


def _ng(data: bytes) -> Iterator[Record]:
    at, n, section, order, interfaces = 0, 0, -1, "<", []
    while at < len(data):
        if at + 12 > len(data):
            raise bad("a block ends in its header")
        if data[at : at + 4] == NG:
            magic = data[at + 8 : at + 12]
            if magic not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                raise bad("a section of no byte order")
            order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if size < 12 or size % 4 or at + size > len(data) or struct.unpack_from(f"{order}I", data, at + size - 4)[0] != size:
            raise bad("a block whose lengths do not agree")
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == SECTION:
            section, interfaces = section + 1, []
        elif section < 0:
            raise bad("a block before the first section")
        elif kind == INTERFACE:
            if len(body) < 8 or len(interfaces) >= MAX_INTERFACES:
                raise bad("an interface too many, or too short")
            link, snap = struct.unpack_from(f"{order}HxxI", body)
            own = _options(body[8:], order)
            offset = struct.unpack(f"{order}q", own[14])[0] if len(own.get(14, b"")) == 8 else 0
            interfaces.append((link, snap, own.get(9, b"\x06")[0], offset))
        elif kind == ENHANCED:
            if len(body) < 20:
                raise bad("a packet block too short")
            k, high, low, captured, original = struct.unpack_from(f"{order}IIIII", body)
            if k >= len(interfaces):
                raise bad("a packet of an interface that is not there")
            link, snap, resolution, offset = interfaces[k]
            if captured > original or 20 + captured > len(body) or snap and captured > snap:
                raise bad("a packet longer than it can be")
            n += 1
            yield n, section, k, _time(high << 32 | low, resolution, offset), captured, original, link, body[20 : 20 + captured]
        elif kind == SIMPLE:
            if len(body) < 4 or not interfaces:
                raise bad("a simple packet without an interface")
            link, snap = interfaces[0][:2]
            original = struct.unpack_from(f"{order}I", body)[0]
            captured = min(original, snap) if snap else original
            if len(body) != 4 + (captured + 3 & ~3):
                raise bad("a simple packet of another length")
            n += 1
            yield n, section, 0, None, captured, original, link, body[4 : 4 + captured]
        elif kind == OLD_PACKET:
            raise bad("an obsolete packet block")


def _row(r: Record, source: str) -> tuple:
    sequence, section, interface, ns, captured, original, link, data = r
    return sequence, section, interface, None if ns is None else Decimal(ns), captured, original, link, source, data


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(f"{path}/*") if f.endswith((".pcap", ".pcapng", ".cap")))
    return sorted(glob.glob(path)) or [path]


def source_of(data: bytes) -> str:
    """A capture's identity: the digest of its content."""
    import hashlib

    return hashlib.sha256(data).hexdigest()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _rows_of(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        data = f.read()
    source = source_of(data)
    for r in records(data):
        yield _row(r, source)


class PcapReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = _files(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows_of(partition.path)


class PcapStreamReader(DataSourceStreamReader):
    """Files that appear in a directory, in the order of their names; the offset is the last name, a file is a partition."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def _names(self) -> list[str]:
        return [f for f in _files(self.path) if os.path.isfile(f)]

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(f) for f in self._names() if start["after"] < f <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows_of(partition.path)


class PcapSource(DataSource):
    """``format("pcap")``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> StructType:
        return schema.RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return PcapReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PcapStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("pcap").load(path)


def records_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The same rows by Spark's own file reading, for captures in any store; one capture fits a task's memory."""
    return records_of_contents(spark.read.format("binaryFile").load(path).select("content"))


def records_of_contents(files: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Records of captures whose bytes are in ``content``, with the columns ``keep`` of their rows."""
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields if f.name in keep] + [f"{f.name} {f.dataType.simpleString()}" for f in schema.RECORD.fields])
    names = [*keep, *schema.RECORD.fieldNames()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *own, content in pdf[[*keep, "content"]].itertuples(index=False):
                data = bytes(content)
                source, rows = source_of(data), []
                for r in records(data):
                    rows.append((*own, *_row(r, source)))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.select(*keep, "content").mapInPandas(run, kinds)


def counters(rows: DataFrame) -> dict[str, int]:
    """records, ip_packets and skipped_non_ip of decoded records."""
    r = rows.agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "packet").alias("ip_packets"), F.count_if(F.col("kind").isin("link", "other")).alias("skipped_non_ip")).first()
    return r.asDict()


def summary(rows: DataFrame) -> DataFrame:
    """One row on decoded records: how many there are of each kind, their bytes, and the time from the first to the last."""
    us = F.floor(F.col("timestamp_ns") / 1000).cast("bigint")
    return rows.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("kind") == "packet").alias("ip_packets"),
        F.count_if(F.col("kind").isin("link", "other")).alias("skipped_non_ip"),
        F.count_if(F.col("kind") == "malformed").alias("malformed"),
        F.coalesce(F.sum("original_len"), F.lit(0)).cast("bigint").alias("bytes"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
    )


def export(rows: DataFrame, path: str, most: int = 4096) -> int:
    """Writes records (``most`` at most) to a new nanosecond capture, in order; all have one link type and a time."""
    found = rows.orderBy("source", "sequence").limit(most + 1).collect()
    if len(found) > most:
        raise bad(f"an export has at most {most} records")
    if len({r["linktype"] for r in found}) > 1 or any(r["timestamp_ns"] is None for r in found):
        raise bad("an export has one link type, and every record a time")
    with open(path, "xb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 262_144, found[0]["linktype"] if found else 1))
        for r in found:
            sec, ns = divmod(int(r["timestamp_ns"]), 1_000_000_000)
            f.write(struct.pack("<IIII", sec, ns, len(r["data"]), r["original_len"]) + bytes(r["data"]))
    return len(found)
