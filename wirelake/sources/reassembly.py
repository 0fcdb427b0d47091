"""IP fragments to datagrams, TCP segments to streams, streams to application events.

State is kept by key: a fragment key for datagrams, a flow for both directions of a connection. Rows of a key are brought
together and sorted in capture order; a task streams through its keys and holds the state of one. What depends on other
keys, the greatest time seen so far, comes with the rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.errors import DecodeError
from wirelake.operators import flows
from wirelake.sources import decode, protocols

#: Limits of a datagram, a stream and an event.
MAX_FRAGMENTS, FRAGMENT_US = 64, 60_000_000
QUEUE, HISTORY, GAP, FRAMING, IDLE_US = 65_536, 4096, 1_048_576, 131_072, 120_000_000
MAX_MESSAGES, MAX_REFS, MAX_FILE = 128, 4096, 64 << 20


@dataclass(frozen=True)
class Fragment:
    id: int
    offset: int
    more: bool
    prefix: bytes
    payload: bytes
    next: int
    previous: int
    version: int


def fragment_of(ip: bytes) -> Fragment | None:
    """What a datagram is a fragment of; None if it is whole."""
    if ip[0] >> 4 == 4:
        size, total, bits = (ip[0] & 15) * 4, int.from_bytes(ip[2:4], "big"), int.from_bytes(ip[6:8], "big")
        if not bits & 0x3FFF:
            return None
        return Fragment(int.from_bytes(ip[4:6], "big"), (bits & 0x1FFF) * 8, bool(bits & 0x2000), ip[:size], ip[size:total], ip[9], 9, 4)
    number, at, previous = ip[6], 40, 6
    for _ in range(16):
        if number == decode.FRAGMENT:
            bits = int.from_bytes(ip[at + 2 : at + 4], "big")
            if bits & 6 or ip[at + 1]:
                raise DecodeError("FRAGMENT", "reserved bits of a fragment header are set")
            return Fragment(int.from_bytes(ip[at + 4 : at + 8], "big"), bits & 0xFFF8, bool(bits & 1), ip[:at], ip[at + 8 :], ip[at], previous, 6)
        if number not in decode.EXTENSIONS and number != decode.AUTH:
            return None
        size = (ip[at + 1] + 2) * 4 if number == decode.AUTH else (ip[at + 1] + 1) * 8
        number, previous, at = ip[at], at, at + size
    raise DecodeError("FRAGMENT", "too many extension headers")


def _checksum(header: bytes) -> int:
    n = sum(int.from_bytes(header[k : k + 2], "big") for k in range(0, len(header), 2))
    while n >> 16:
        n = (n & 0xFFFF) + (n >> 16)
    return ~n & 0xFFFF


def rebuilt(prefix: bytes, payload: bytes, number: int, previous: int, version: int) -> bytes:
    """A whole datagram of the first fragment's headers and all the payload."""
    head = bytearray(prefix)
    if version == 4:
        if len(head) + len(payload) > 65_535:
            raise DecodeError("FRAGMENT", "a datagram too long")
        head[2:4], head[6:8], head[10:12] = (len(head) + len(payload)).to_bytes(2, "big"), b"\0\0", b"\0\0"
        head[10:12] = _checksum(bytes(head)).to_bytes(2, "big")
    else:
        if len(head) - 40 + len(payload) > 65_535:
            raise DecodeError("FRAGMENT", "a datagram too long")
        head[previous] = number
        head[4:6] = (len(head) - 40 + len(payload)).to_bytes(2, "big")
    return bytes(head) + payload


class Datagram:
    """Fragments of one key until they make a datagram. Any overlap is an error, and drops it."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[int, bytes] = {}
        self.refs: list[int] = []
        self.first: Fragment | None = None
        self.total: int | None = None
        self.since: int | None = None

    def add(self, f: Fragment, sequence: int, us: int, wm: int) -> bytes | None:
        if self.since is not None and wm - self.since >= FRAGMENT_US:
            self.clear()
        try:
            return self._add(f, sequence, us)
        except DecodeError:
            self.clear()
            raise

    def _add(self, f: Fragment, sequence: int, us: int) -> bytes | None:
        end = f.offset + len(f.payload)
        if not f.payload or f.more and len(f.payload) % 8 or end > 65_535:
            raise DecodeError("FRAGMENT", "a fragment of no or odd length")
        if f.version == 6 and not f.offset and not f.more:  # atomic: a datagram of its own
            self.refs = [sequence]
            return rebuilt(f.prefix, f.payload, f.next, f.previous, 6)
        if self.since is None:
            self.since = us
        if any(o < end and f.offset < o + len(p) for o, p in self.pieces.items()):
            raise DecodeError("FRAGMENT", "fragments overlap")
        if len(self.pieces) >= MAX_FRAGMENTS:
            raise DecodeError("FRAGMENT", f"more than {MAX_FRAGMENTS} fragments")
        if not f.more:
            if self.total not in (None, end):
                raise DecodeError("FRAGMENT", "two ends of a datagram")
            self.total = end
        if self.total is not None and max([end, *(o + len(p) for o, p in self.pieces.items())]) > self.total:
            raise DecodeError("FRAGMENT", "a fragment beyond the end")
        if self.first is not None and not f.offset or self.first is None and not f.offset:
            self.first = f
        self.pieces[f.offset] = f.payload
        self.refs.append(sequence)
        if self.total is None or sum(map(len, self.pieces.values())) < self.total or self.first is None:
            return None
        payload = b"".join(self.pieces[o] for o in sorted(self.pieces))
        return rebuilt(self.first.prefix, payload, self.first.next, self.first.previous, f.version)


class Stream:
    """One direction of a TCP connection: contiguous bytes out of segments in any order.

    ``next`` is the sequence number that comes next. Conflicting bytes are errors, after which the stream is of no use.
    """

    def __init__(self, next_: int) -> None:
        self.next, self.at = next_, 0
        self.pending: dict[int, bytes] = {}  # start -> bytes, apart from each other
        self.history = b""
        self.end: int | None = None

    @property
    def queued(self) -> int:
        return sum(map(len, self.pending.values()))

    @property
    def closed(self) -> bool:
        return self.end == self.at

    def push(self, sequence: int, data: bytes, fin: bool) -> bytes:
        fail = lambda what: DecodeError("TCP", what)
        if len(data) > QUEUE:
            raise fail("a segment too long")
        delta = (sequence - self.next + (1 << 31)) % (1 << 32) - (1 << 31)
        start, end = self.at + delta, self.at + delta + len(data)
        if abs(delta) > GAP:
            raise fail("a segment outside of the window")
        if start < 0:
            raise fail("a segment before the stream")
        if self.end is not None and (end > self.end or fin and end != self.end):
            raise fail("data beyond FIN, or another FIN")
        if fin:
            if end < self.at or any(o + len(p) > end for o, p in self.pending.items()):
                raise fail("a FIN before data that was seen")
            self.end = end
        if start < self.at:
            old = data[: self.at - start]
            known = self.at - len(self.history)
            if old and start < known:
                raise fail("a retransmission too old to compare")
            if self.history[start - known : start - known + len(old)] != old:
                raise fail("a retransmission of other bytes")
            data, start = data[self.at - start :], self.at
        self._queue(start, data)
        out = b""
        while self.at + len(out) in self.pending:
            out += self.pending.pop(self.at + len(out))
        self.at += len(out)
        self.next = (self.next + len(out)) % (1 << 32)
        self.history = (self.history + out)[-HISTORY:]
        return out

    def _queue(self, start: int, data: bytes) -> None:
        for o in sorted(self.pending):
            p = self.pending[o]
            lo, hi = max(o, start), min(o + len(p), start + len(data))
            if lo < hi:
                if p[lo - o : hi - o] != data[lo - start : hi - start]:
                    raise DecodeError("TCP", "segments that overlap with other bytes")
                if o < lo:  # the queued piece begins before: what is new begins after it
                    data, start = data[hi - start :], hi
                else:  # the queued piece goes into the new one
                    data = data[: hi - start] + p[hi - o :] if o + len(p) > hi else data
                    del self.pending[o]
        if data:
            self.pending[start] = data
        if self.queued > QUEUE:
            raise DecodeError("TCP", "too much is queued")


class HttpBody:
    """Digest of the first body with a Content-Length in a direction."""

    def __init__(self) -> None:
        self.head, self.left, self.size, self.mime, self.done = b"", None, 0, None, False
        self.hash = hashlib.sha256()
        self.response_allowed = False

    @property
    def incomplete(self) -> bool:
        return not self.done and bool(self.left)

    def push(self, data: bytes) -> dict | None:
        if self.done:
            return None
        try:
            return self._push(data)
        except DecodeError:
            self.done, self.left = True, None
            raise

    def _push(self, data: bytes) -> dict | None:
        if self.left is None:
            self.head += data
            starts = (b"POST ", b"PUT ", *([b"HTTP/"] if self.response_allowed else []))
            if not any(s.startswith(self.head[:5]) or self.head.startswith(s) for s in starts):
                self.done = bool(self.head)
                return None
            found = protocols.http_head(self.head)
            if found is None:
                return None
            event, end, headers = found
            data, self.head = self.head[end:], b""
            if event["type"] == "http.response" and (event["status"] < 200 or event["status"] in (204, 304)):
                self.done = True
                return None
            if "transfer-encoding" in headers:
                raise DecodeError("FILE", "a body in transfer encoding is not hashed")
            lengths = headers.get("content-length", [])
            if len(lengths) > 1 or lengths and not lengths[0].isdigit():
                raise DecodeError("FILE", "a Content-Length that is none, or stands twice")
            if not lengths:
                self.done = True
                return None
            self.left = self.size = int(lengths[0])
            if self.size > MAX_FILE:
                raise DecodeError("FILE", "a body too long")
            self.mime = headers.get("content-type", [None])[-1]
        self.hash.update(data[: self.left])
        self.left -= min(self.left, len(data))
        if self.left:
            return None
        self.done = True
        return {"type": "file.seen", "size": self.size, "sha256": self.hash.hexdigest(), "mime": self.mime}


@dataclass
class Direction:
    stream: Stream
    us: int
    syn: int | None
    refs: set[int] = field(default_factory=set)
    complete: bool = True
    framing: bytes = b""
    done: bool = False
    body: HttpBody = field(default_factory=HttpBody)
    method: str | None = None

    @property
    def midstream(self) -> bool:
        return self.syn is None

    @property
    def incomplete(self) -> bool:
        return bool(self.framing or self.stream.pending or self.body.incomplete)

    def refer(self, refs: list[int]) -> None:
        self.refs |= set(refs)
        if len(self.refs) > MAX_REFS:
            self.refs, self.complete = set(sorted(self.refs)[:MAX_REFS]), False


Event = tuple[str, dict, list[int], bool, bool]  # type, payload, refs, complete, midstream


class Conversation:
    """Both directions of one flow key, packet by packet in capture order."""

    def __init__(self, dns_ports: tuple[int, ...] = (53,), files: bool = True, dns: bool = True) -> None:
        self.sides: dict[bool, Direction] = {}
        self.dns_ports, self.files, self.dns = dns_ports, files, dns

    def _anomaly(self, code: str, what: str, refs: list[int], side: Direction | None = None) -> Event:
        own = sorted(side.refs | set(refs))[:MAX_REFS] if side else list(refs)
        return "anomaly", {"anomaly": {"code": code, "message": what}}, own, side is None or side.complete, bool(side and side.midstream)

    def expire(self, wm: int | None) -> Iterator[Event]:
        for forward in [f for f, s in self.sides.items() if wm is not None and wm - s.us >= IDLE_US]:
            side = self.sides.pop(forward)
            if side.incomplete:
                yield self._anomaly("TCP", "an incomplete stream at its idle time", [], side)

    def finish(self, wm: int | None = None) -> Iterator[Event]:
        yield from self.expire(wm)
        for forward in sorted(self.sides):
            if self.sides[forward].incomplete:
                yield self._anomaly("TCP", "an incomplete stream at the end", [], self.sides[forward])
        self.sides = {}

    def packet(self, p: dict, refs: list[int]) -> Iterator[Event]:
        """``p`` has proto, ports, us, wm, forward, tcp_flags, tcp_sequence and payload."""
        yield from self.expire(p["wm"])
        dns = bool({p["src_port"], p["dst_port"]} & set(self.dns_ports))
        if dns and not self.dns:
            return
        if p["proto"] == "udp":
            if dns:
                yield self._dns(p["payload"], refs, True, False)
            return
        if p["us"] is None or p["tcp_sequence"] is None:
            yield self._anomaly("TCP", "a segment without time or sequence", refs)
            return
        flags, forward, payload = p["tcp_flags"] or 0, p["forward"], p["payload"]
        syn, fin = bool(flags & flows.SYN), bool(flags & flows.FIN)
        if flags & flows.RST:
            for way in (True, False):
                side = self.sides.pop(way, None)
                if side is not None and side.incomplete:
                    yield self._anomaly("TCP", "an incomplete stream at RST", refs, side)
            return
        if not syn and not fin and not payload:
            return
        side = self.sides.get(forward)
        if syn and side is not None and side.syn != p["tcp_sequence"]:
            yield self._anomaly("TCP", "a new SYN begins the stream anew", refs, self.sides.pop(forward))
            if not flags & flows.ACK:
                self.sides.pop(not forward, None)
            side = None
        if side is None:
            if not syn and not payload:
                return
            side = Direction(Stream((p["tcp_sequence"] + syn) % (1 << 32)), p["us"], p["tcp_sequence"] if syn else None)
        self.sides.pop(forward, None)
        side.refer(refs)
        side.us = max(side.us, p["us"])
        try:
            data = side.stream.push((p["tcp_sequence"] + syn) % (1 << 32), payload, fin)
            keep = yield from self._stream(side, forward, data, dns, refs)
        except DecodeError as e:
            yield self._anomaly(e.code, str(e), refs, side)
            return
        if keep:
            self.sides[forward] = side

    def _stream(self, side: Direction, forward: bool, data: bytes, dns: bool, refs: list[int]):
        if self.files and not dns:
            other = self.sides.get(not forward)
            asked = other.method if other else None
            side.body.response_allowed = asked not in (None, "HEAD", "CONNECT")
            try:
                found = side.body.push(data)
            except DecodeError as e:
                yield self._anomaly(e.code, str(e), refs, side)
                found = None
            if found:
                own = side.refs | (other.refs if other and other.method else set())
                yield "file.seen", {"protocol": found}, sorted(own)[:MAX_REFS], side.complete and len(own) <= MAX_REFS, side.midstream
        if side.done:
            return True
        if len(side.framing) + len(data) > FRAMING:
            raise DecodeError("LIMIT", "too much of a stream is not understood")
        side.framing += data
        return (yield from (self._dns_stream(side, refs) if dns else self._protocol(side, refs)))

    def _protocol(self, side: Direction, refs: list[int]):
        event, b = None, side.framing
        kind = protocols.looks_like(b) if b else ""
        if kind == "tls":
            message = protocols.tls_handshake(b)
            event = protocols.tls_hello(message) if message else None
            kind = None if message and event is None else kind
        elif kind == "http":
            head = protocols.http_head(b)
            event = head[0] if head else None
        elif kind == "ssh":
            event = protocols.ssh_banner(b)
        if event:
            side.method = event.get("method")
            yield event["type"], {"protocol": event}, sorted(side.refs), side.complete, side.midstream
        if event or kind is None or kind == "" and len(b) > protocols.GIVE_UP:
            side.done, side.framing = True, b""
        elif side.stream.closed:
            if b or side.stream.pending:
                yield self._anomaly("TCP", "an incomplete or unknown application at FIN", refs, side)
            side.done, side.framing = True, b""
        return True

    def _dns_stream(self, side: Direction, refs: list[int]):
        messages = 0
        while len(side.framing) >= 2:
            size = int.from_bytes(side.framing[:2], "big")
            if size < 12:
                raise DecodeError("DNS", "a message length that is none")
            if len(side.framing) < size + 2:
                break
            messages += 1
            if messages > MAX_MESSAGES:
                raise DecodeError("LIMIT", "too many messages in a packet")
            yield self._dns(side.framing[2 : size + 2], sorted(side.refs), side.complete, side.midstream)
            side.framing = side.framing[size + 2 :]
        if side.stream.closed and side.incomplete:
            yield self._anomaly("TCP", "an incomplete message at FIN", refs, side)
            return False
        return True

    def _dns(self, data: bytes, refs: list[int], complete: bool, midstream: bool) -> Event:
        try:
            message = protocols.dns_message(data)
        except DecodeError as e:
            return "anomaly", {"anomaly": {"code": e.code, "message": str(e)}}, list(refs), complete, midstream
        return "dns.response" if message["response"] else "dns.query", {"dns": message}, list(refs), complete, midstream


def _whole(column: pd.Series) -> list:
    """Python values; whole numbers that pandas holds as floats for their nulls are whole again."""
    return [None if x != x else int(x) for x in column.tolist()] if column.dtype.kind == "f" else column.tolist()


def by_key(rows: DataFrame, key: str, make: Callable[[], object], step: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Streams through rows sorted by key and sequence; ``step(state, row or None)`` yields output rows, None at a key's end."""
    ordered = rows.repartition(key).sortWithinPartitions(key, "sequence")
    names = ordered.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = state = last = None
        for pdf in batches:
            out: list = []
            for cells in zip(*[_whole(pdf[c]) for c in names], strict=True):
                row = dict(zip(names, cells, strict=True))
                if row[key] != now or state is None:
                    if state is not None:
                        out += step(state, None, last)
                    now, state = row[key], make()
                out += step(state, row, row)
                last = row
            yield pd.DataFrame(out, columns=columns, dtype=object)
        if state is not None:
            yield pd.DataFrame(list(step(state, None, last)), columns=columns, dtype=object)

    return ordered.mapInPandas(run, schema)


def reassemble(packets: DataFrame) -> DataFrame:
    """Fragments as whole packets: the columns of decode_records, refs to all fragments, and errors as malformed rows.

    Only fragments move; ``packets`` has us and wm.
    """
    parts = packets.where((F.col("kind") == "packet") & F.col("fragmented"))
    ident = F.when(F.hex(F.substring("datagram", 1, 1)).startswith("4"), F.concat(F.hex(F.substring("datagram", 5, 2)), F.col("proto"))).otherwise(F.lit("6"))
    key = F.concat_ws("|", "source", "section", "interface", F.array_join(F.transform("vlans", lambda v: v.cast("string")), ","), "src_ip", "dst_ip", ident)
    kept = ["source", "section", "interface", "sequence", "linktype", "us", "wm", "wm_end", "original_len"]
    rows = parts.select(*kept, "datagram", "vlans", key.alias("_key"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)

    def step(state: dict, row: dict | None, _: dict) -> Iterator[list]:
        if row is None:
            return
        base = [row[c] for c in kept]
        try:
            f = fragment_of(bytes(row["datagram"]))
            d = state.setdefault(f.id, Datagram())
            whole = d.add(f, row["sequence"], row["us"] or 0, row["wm"] or 0)
            if whole is None:
                return
            refs = sorted(d.refs)
            d.clear()
            del state[f.id]
            cells = decode.decoded(whole, decode.RAW) | {"vlans": [int(v) for v in row["vlans"]]}
        except DecodeError as e:
            refs, cells = [row["sequence"]], {"kind": "malformed", "error": str(e)}
        yield [*base, refs, *[cells.get(c) for c in decode.NAMES]]

    return by_key(rows, "_key", dict, step, f"{kinds}, refs array<bigint>, {decode.DECODED}", [*kept, "refs", *decode.NAMES])


EVENTS = "source string, section int, interface int, sequence long, us long, event_type string, payload string, refs array<bigint>, complete boolean, midstream boolean, reassembled boolean"
EVENT_NAMES = [x.split()[0] for x in EVENTS.split(", ")]


def analyze(records: DataFrame, dns_ports: tuple[int, ...] = (53,), files: bool = True) -> DataFrame:
    """Application events and anomalies of decoded records (decode_records with bytes), as EVENTS rows."""
    us = F.floor(F.col("timestamp_ns") / 1000).cast("bigint") if "us" not in records.columns else F.col("us")
    timed = flows.with_watermark(records.withColumn("us", us), "us").drop("_range")
    whole = timed.where((F.col("kind") == "packet") & ~F.col("fragmented")).withColumn("refs", F.array("sequence").cast("array<bigint>"))
    again = reassemble(timed)
    names = ["source", "section", "interface", "sequence", "linktype", "us", "wm", "wm_end", "refs", *decode.NAMES]
    both = whole.select(*names, F.lit(False).alias("reassembled")).unionByName(again.select(*names, F.lit(True).alias("reassembled")))
    broken = both.where(F.col("kind") == "malformed")
    anomalies = broken.select("source", "section", "interface", "sequence", "us", F.lit("anomaly").alias("event_type"), F.to_json(F.struct(F.struct(F.lit("FRAGMENT").alias("code"), F.col("error").alias("message")).alias("anomaly"))).alias("payload"), "refs", F.lit(True).alias("complete"), F.lit(False).alias("midstream"), F.lit(True).alias("reassembled"))
    usable = both.where((F.col("kind") == "packet") & ~F.col("fragmented") & F.col("proto").isin("tcp", "udp"))
    ports = F.col("src_port").isin(*dns_ports) | F.col("dst_port").isin(*dns_ports)
    usable = flows.with_flow_key(usable.where((F.col("proto") == "tcp") | ports)).withColumn("_key", flows.conversation_id())
    need = ["source", "section", "interface", "sequence", "us", "wm", "wm_end", "refs", "reassembled", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "vlans", "forward", "tcp_flags", "tcp_sequence", "payload", "_key"]

    def shown(row: dict, e: Event) -> list:
        kind, payload, refs, complete, midstream = e
        packet = {"header": {"sequence": row["sequence"], "section": row["section"], "interface": row["interface"]}, "vlans": [int(v) for v in row["vlans"]], "src": row["src_ip"], "dst": row["dst_ip"], "proto": row["proto"]}
        return [row["source"], row["section"], row["interface"], row["sequence"], row["us"], kind, json.dumps(payload | {"packet": packet}), refs, complete, midstream, row["reassembled"]]

    def step(state: Conversation, row: dict | None, last: dict) -> Iterator[list]:
        if row is None:
            yield from (shown(last, e) for e in state.finish(last["wm_end"]))
            return
        row["payload"] = bytes(row["payload"] or b"")
        yield from (shown(row, e) for e in state.packet(row, [int(x) for x in row["refs"]]))

    events = by_key(usable.select(*need), "_key", lambda: Conversation(dns_ports, files), step, EVENTS, EVENT_NAMES)
    return events.unionByName(anomalies)
