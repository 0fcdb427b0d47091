"""NetFlow v5, v9 and IPFIX: datagrams to flow records.

A datagram table has exporter (address and port as text), arrival (orders a session's datagrams) and data. Version 5 needs
no state and is decoded row by row. The others carry templates, so a session (exporter, domain, version) is
folded in order of arrival. A task gets many sessions one after another, each sorted, and holds the templates of one only;
a session that is large streams through it batch by batch.
"""

from __future__ import annotations

import ipaddress
import socket
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.errors import DecodeError

#: Limits of a datagram and of a session.
MAX_RECORDS, MAX_FIELDS, TTL_SECONDS = 4096, 128, 1800
VERSIONS = (5, 9, 10)


def bad(message: str) -> DecodeError:
    return DecodeError("EXPORT", message)


class Bytes:
    """Reads big-endian numbers off the front."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left:
            raise bad("a datagram ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def padding(self, most: int | None = None) -> None:
        rest = self.take(self.left)
        if any(rest) or most is not None and len(rest) > most:
            raise bad("what follows the records is no padding")


@dataclass(frozen=True)
class TemplateField:
    id: int
    length: int
    enterprise: int
    scope: bool


@dataclass
class Template:
    fields: list[TemplateField]
    options: bool
    seen: int

    def __post_init__(self) -> None:
        """Where the fields of a record lie, if their lengths are fixed."""
        ends = list(accumulate(f.length for f in self.fields))
        fixed = all(f.length != 65535 for f in self.fields)
        self.spans = [(f.enterprise, f.id, end - f.length, end, f.scope) for f, end in zip(self.fields, ends, strict=True)] if fixed else None


@dataclass
class Session:
    """What a session remembers between datagrams."""

    templates: dict[int, Template] = field(default_factory=dict)
    expected: int | None = None
    uptime: int | None = None
    seen: int | None = None


@dataclass
class Batch:
    version: int
    domain: int
    sequence: int
    flows: list[dict] = field(default_factory=list)
    options: list[list[tuple]] = field(default_factory=list)
    notices: list[tuple[str, str]] = field(default_factory=list)


def header(data: bytes) -> tuple[int, int, int, int, int | None]:
    """(version, domain, sequence, export seconds, uptime)."""
    version = int.from_bytes(data[:2], "big") if len(data) >= 2 else 0
    if version not in VERSIONS or len(data) < {5: 24, 9: 20, 10: 16}[version]:
        raise bad("no datagram of version 5, 9 or 10")
    at = lambda k, n=4: int.from_bytes(data[k : k + n], "big")
    if version == 5:
        return 5, at(20, 2), at(16), at(8), at(4)
    if version == 9:
        return 9, at(16), at(12), at(8), at(4)
    if at(2, 2) != len(data):
        raise bad("the length of a message is not its own")
    return 10, at(12), at(8), at(4), None


def _before(ms: int, uptime: int, then: int) -> int | None:
    """``ms`` less what lies between two uptimes, which wrap at 32 bits."""
    out = ms - ((uptime - then) & 0xFFFFFFFF)
    return out if out >= 0 else None


def decode_v5(data: bytes) -> Batch:
    version, domain, sequence, seconds, uptime = header(data)
    count, nanos, sampling = *struct.unpack_from(">H", data, 2), int.from_bytes(data[12:16], "big"), int.from_bytes(data[22:24], "big") & 0x3FFF
    if count > 30 or len(data) != 24 + 48 * count or nanos >= 1_000_000_000:
        raise bad("a v5 datagram whose count, length or time is wrong")
    out, base = Batch(version, domain, sequence), seconds * 1000 + nanos // 1_000_000
    for k in range(count):
        src, dst, packets, octets, first, last, sport, dport, flags, proto = struct.unpack_from(">4s4s8xIIIIHHxBB", data, 24 + 48 * k)
        out.flows.append(
            {
                "src_ip": str(ipaddress.IPv4Address(src)), "dst_ip": str(ipaddress.IPv4Address(dst)), "src_port": sport, "dst_port": dport, "protocol": proto, "packets": packets, "bytes": octets, "tcp_flags": flags,
                "start_ms": _before(base, uptime, first), "end_ms": _before(base, uptime, last), "sampling_interval": sampling or None, "fields": [],
            }
        )
    return out


#: Information elements and what they say; addresses by length, times in their own way below.
NUMBERS = {7: ("src_port", 1 << 16), 11: ("dst_port", 1 << 16), 4: ("protocol", 1 << 8), 1: ("bytes", 1 << 64), 2: ("packets", 1 << 64), 6: ("tcp_flags", 1 << 16), 34: ("sampling_interval", 1 << 64), 152: ("start_ms", 1 << 64), 153: ("end_ms", 1 << 64)}
ADDRESSES = {8: ("src_ip", 4), 12: ("dst_ip", 4), 27: ("src_ip", 16), 28: ("dst_ip", 16)}
SECONDS = {150: "start_ms", 151: "end_ms"}
UPTIMES = {22: "start_ms", 21: "end_ms"}
FLOW_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "tcp_flags", "start_ms", "end_ms", "sampling_interval")


def normalize(fields: list[tuple[int, int, bytes, bool]], seconds: int, uptime: int | None) -> dict:
    """A flow of (enterprise, id, value, scope) fields; counters stay as exported, whatever the sampling."""
    out: dict = dict.fromkeys(FLOW_FIELDS)
    for enterprise, id_, value, _ in fields:
        if enterprise:
            continue
        number = int.from_bytes(value, "big") if 1 <= len(value) <= 8 else None
        if id_ in ADDRESSES and len(value) == ADDRESSES[id_][1]:
            out[ADDRESSES[id_][0]] = socket.inet_ntoa(value) if len(value) == 4 else str(ipaddress.ip_address(value))
        elif id_ in NUMBERS:
            name, limit = NUMBERS[id_]
            out[name] = number if number is not None and number < min(limit, 1 << 63) else None
        elif id_ in SECONDS:
            out[SECONDS[id_]] = number * 1000 if number is not None and number < 1 << 53 else None
        elif id_ in UPTIMES and uptime is not None and number is not None and number < 1 << 32:
            out[UPTIMES[id_]] = _before(seconds * 1000, uptime, number)
    return out | {"fields": fields}


def read_templates(session: Session, version: int, data: bytes, options: bool, now: int) -> None:
    c = Bytes(data)
    while c.left >= 4:
        id_, count = c.number(2), c.number(2)
        if id_ < 256 or not count:
            raise bad("a template id below 256, or a withdrawal, which UDP has not")
        scopes = 0
        if options and version == 9:
            more = c.number(2)
            if count % 4 or more % 4:
                raise bad("lengths of v9 options that no fields have")
            scopes, count = count // 4, (count + more) // 4
        elif options:
            scopes = c.number(2)
        if not 1 <= count <= MAX_FIELDS or scopes > count or options and not scopes:
            raise bad("a template with too many fields, or scopes that do not fit")
        fields = []
        for k in range(count):
            raw, length = c.number(2), c.number(2)
            if not length or version == 9 and length == 65535:
                raise bad("a field of no length")
            enterprise = c.number(4) if version == 10 and raw & 0x8000 else 0
            fields.append(TemplateField(raw & 0x7FFF if version == 10 else raw, length, enterprise, k < scopes))
        session.templates[id_] = Template(fields, options, now)
    c.padding()


def read_data(template: Template, data: bytes, room: int) -> Iterator[list[tuple[int, int, bytes, bool]]]:
    if template.spans is not None:
        size = template.spans[-1][3]
        whole = len(data) - len(data) % size
        for at in range(0, whole, size):
            if room <= 0:
                raise bad(f"a datagram has at most {MAX_RECORDS} records")
            room -= 1
            yield [(enterprise, id_, data[at + start : at + end], scope) for enterprise, id_, start, end, scope in template.spans]
        return Bytes(data[whole:]).padding(3)
    c = Bytes(data)
    least = sum(1 if f.length == 65535 else f.length for f in template.fields)
    while c.left >= least:
        if room <= 0:
            raise bad(f"a datagram has at most {MAX_RECORDS} records")
        room -= 1
        out = []
        for f in template.fields:
            n = f.length
            if n == 65535:
                n = c.number(1)
                n = c.number(2) if n == 255 else n
            out.append((f.enterprise, f.id, c.take(n), f.scope))
        yield out
    c.padding(3)


def decode(session: Session, data: bytes, now: int) -> Batch:
    """One datagram of a session; ``now`` is its arrival in seconds."""
    version, domain, sequence, seconds, uptime = header(data)
    if session.seen is not None and now - session.seen >= TTL_SECONDS:
        session.templates, session.expected, session.uptime = {}, None, None
    session.templates = {k: t for k, t in session.templates.items() if now - t.seen < TTL_SECONDS}
    out = Batch(version, domain, sequence)
    if session.uptime is not None and uptime is not None and 0 < session.uptime - uptime < 1 << 31:
        session.templates, session.expected = {}, None
        out.notices.append(("RESTART", "the exporter's uptime went back; its templates are gone"))
    if session.expected is not None and session.expected != sequence:
        out.notices.append(("SEQUENCE", f"expected sequence {session.expected}, got {sequence}"))
    session.seen, session.uptime = now, uptime
    if version == 5:
        got = decode_v5(data)
        out.flows, session.expected = got.flows, (sequence + len(got.flows)) & 0xFFFFFFFF
        return out
    records, whole, c = 0, True, Bytes(data[20 if version == 9 else 16 :])
    while c.left:
        id_, length = c.number(2), c.number(2)
        if length < 4:
            raise bad("a set shorter than its header")
        body = c.take(length - 4)
        plain, options = (0, 1) if version == 9 else (2, 3)
        if id_ in (plain, options):
            read_templates(session, version, body, id_ == options, now)
        elif id_ < 256:
            raise bad(f"set {id_} is reserved")
        elif id_ not in session.templates:
            whole = False
            out.notices.append(("TEMPLATE", f"template {id_} is not known; its set is skipped"))
        else:
            template = session.templates[id_]
            for fields in read_data(template, body, MAX_RECORDS - records):
                records += 1
                if template.options:
                    out.options.append(fields)
                else:
                    out.flows.append(normalize(fields, seconds, uptime))
    session.expected = (sequence + (1 if version == 9 else records)) & 0xFFFFFFFF if whole else None
    return out


_FIELD = "struct<enterprise:bigint,id:int,value:binary,scope:boolean>"
RECORDS = (
    "exporter string, arrival long, version int, domain long, sequence long, export_time long, kind string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packets long, bytes long,"
    f" tcp_flags int, start_ms long, end_ms long, sampling_interval long, fields array<{_FIELD}>, code string, message string"
)


def rows_of(session: Session, exporter: str, arrival: int, data: bytes) -> list[dict]:
    """Records of a datagram: flow, options and notice rows, or one anomaly."""
    try:
        version, domain, sequence, seconds, _ = header(data)
        got = decode(session, data, arrival)
    except DecodeError as e:
        return [{"exporter": exporter, "arrival": arrival, "kind": "anomaly.export", "code": e.code, "message": str(e)}]
    base = {"exporter": exporter, "arrival": arrival, "version": version, "domain": domain, "sequence": sequence, "export_time": seconds}
    out = [base | {"kind": "notice.export", "code": c, "message": m} for c, m in got.notices]
    out += [base | {"kind": "flow.export"} | f for f in got.flows]
    return out + [base | {"kind": "export.options", "fields": f} for f in got.options]


_FIELDS = pa.struct([("enterprise", pa.int64()), ("id", pa.int32()), ("value", pa.binary()), ("scope", pa.bool_())])
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), f"array<{_FIELD}>": pa.list_(_FIELDS)}
COLUMNS = {name: _ARROW[kind] for name, kind in (x.split(" ", 1) for x in RECORDS.split(", "))}
#: Records that a task holds before it gives them away.
ROWS = 10_000


def _batch(rows: list[dict]) -> pa.RecordBatch:
    arrays = []
    for name, kind in COLUMNS.items():
        values = [r.get(name) for r in rows]
        if name == "fields":
            flat = [f for v in values if v for f in v]
            parts = zip(*flat, strict=True) if flat else ([], [], [], [])
            inner = pa.StructArray.from_arrays([pa.array(list(p), f.type) for p, f in zip(parts, _FIELDS, strict=True)], fields=list(_FIELDS))
            ends = accumulate(map(len, (v or () for v in values)), initial=0)
            starts = pa.array([None if at < len(values) and values[at] is None else n for at, n in enumerate(ends)], pa.int32())
            arrays.append(pa.ListArray.from_arrays(starts, inner, type=kind))
        else:
            arrays.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(COLUMNS))


def decode_datagrams(datagrams: DataFrame) -> DataFrame:
    """Records of a datagram table, sessions in order of arrival; see RECORDS for the columns."""
    byte = lambda k, n: F.conv(F.hex(F.substring("data", k, n)), 16, 10).cast("long")
    version = F.when(F.octet_length("data") >= 2, byte(1, 2))
    domain = F.when((version == 5) & (F.octet_length("data") >= 24), byte(21, 2)).when((version == 9) & (F.octet_length("data") >= 20), byte(17, 4)).when((version == 10) & (F.octet_length("data") >= 16), byte(13, 4))
    order = ["exporter", "_domain", "_version", "arrival", "_row"]  # those that arrive at once stay in the order of the input
    keyed = datagrams.select("exporter", F.col("arrival").cast("bigint").alias("arrival"), "data", version.alias("_version"), domain.alias("_domain"), F.monotonically_increasing_id().alias("_row"))
    placed = keyed.repartition(*order[:3]).sortWithinPartitions(*order).select("exporter", "_domain", "_version", "arrival", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, session, rows = None, Session(), []
        for batch in batches:
            for *key, arrival, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    now, session = key, Session()
                rows += rows_of(session, key[0], arrival, data)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    return placed.mapInArrow(run, RECORDS)


def decode_v5_datagrams(datagrams: DataFrame) -> DataFrame:
    """The same for version 5 alone, which needs no session: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for exporter, arrival, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += rows_of(Session(), exporter, arrival, data)
            yield _batch(rows)

    return datagrams.select("exporter", F.col("arrival").cast("bigint").alias("arrival"), "data").mapInArrow(run, RECORDS)


def sequence_gaps(datagrams: DataFrame, session: list[str]) -> DataFrame:
    """Datagrams (arrival, sequence, records) whose sequence is not the one before plus its records."""
    expected = F.lag(F.col("sequence") + F.col("records")).over(W.partitionBy(*session).orderBy("arrival", "sequence", "records"))
    return datagrams.withColumn("expected", expected).where(F.col("expected") != F.col("sequence")).withColumn("gap", F.col("sequence") - F.col("expected"))
