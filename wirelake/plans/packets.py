"""Packet filters: a compatibility grammar with two truth values, a subset of capture-filter syntax, and the choice between them.

In the compatibility grammar a comparison with a missing port is false, and its negation true. Names of either side
(``tcp.port``) mean one side or the other; their ``!=`` means both.
"""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.errors import QuerySyntaxError
from wirelake.functions import net
from wirelake.plans import predicate as P

#: Limits, protocol and field names.
MAX_BYTES, MAX_TOKENS, MAX_DEPTH = 4096, 256, 32
APPLICATIONS, LINKS, TRANSPORTS = ("http", "dns", "tls", "ssh"), ("arp", "lldp", "eapol"), ("tcp", "udp", "icmp", "icmpv6")
SIDES = {"src.ip": ("src",), "dst.ip": ("dst",), "src.port": ("src",), "dst.port": ("dst",)}
GUARDED = {"ip": 4, "ipv6": 6}
NUMBER_OF = {"tcp": 6, "udp": 17, "icmp": 1, "icmpv6": 58}

_TOKEN = re.compile(r"\s*(?:(==|!=|&&|\|\||[\[\](),!])|([0-9A-Za-z:][0-9A-Za-z.:/_]*)|(\S))")


def _false(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _protocol(value: str) -> str:
    low = value.lower()
    if low in NUMBER_OF:
        return low
    if not re.fullmatch(r"[0-9]+", low) or int(low) > 255:
        raise QuerySyntaxError(f"{value} is no protocol name, and no number from 0 to 255")
    return net.protocol_name(int(low))


class _Reader:
    def __init__(self, source: str) -> None:
        if len(source.encode()) > MAX_BYTES:
            raise QuerySyntaxError(f"a filter has at most {MAX_BYTES} bytes")
        self.source, self.tokens, self.at = source, [], 0
        for m in _TOKEN.finditer(source.rstrip()):
            if m[3]:
                raise QuerySyntaxError("unexpected character", source, m.start(3), m.end(3))
            text = m[1] or m[2]
            self.tokens.append(({"and": "&&", "or": "||", "not": "!"}.get(text, text), m.start(m.lastindex), m.end()))
        if len(self.tokens) > MAX_TOKENS:
            raise QuerySyntaxError(f"a filter has at most {MAX_TOKENS} tokens")

    def fail(self, message: str, back: int = 0) -> QuerySyntaxError:
        k = self.at - back
        span = self.tokens[k][1:] if k < len(self.tokens) else (len(self.source), len(self.source))
        return QuerySyntaxError(message, self.source, *span)

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in texts:
            self.at += 1
            return self.tokens[self.at - 1][0]
        return None

    def atom(self) -> str:
        if self.at < len(self.tokens) and re.match(r"[0-9A-Za-z:]", self.tokens[self.at][0]) and self.tokens[self.at][0] != "in":
            self.at += 1
            return self.tokens[self.at - 1][0]
        raise self.fail("expected a field or a value")

    def any(self, depth: int) -> Column:
        out = self.all(depth)
        while self.take("||"):
            out = out | self.all(depth)
        return out

    def all(self, depth: int) -> Column:
        out = self.one(depth)
        while self.take("&&"):
            out = out & self.one(depth)
        return out

    def one(self, depth: int) -> Column:
        if depth > MAX_DEPTH:
            raise self.fail(f"filters nest at most {MAX_DEPTH} deep")
        if self.take("!"):
            return ~self.one(depth + 1)
        if self.take("("):
            out = self.any(depth + 1)
            if not self.take(")"):
                raise self.fail("expected )")
            return out
        name = self.atom()
        if name in TRANSPORTS:
            return _false(F.col("proto") == name)
        if name in GUARDED:
            return family(GUARDED[name])
        if name in APPLICATIONS:
            return _false(F.col("app") == name)
        return self.comparison(name)

    def comparison(self, name: str) -> Column:
        guard, sides, what = None, SIDES.get(name, ()), name.rpartition(".")[2]
        group, _, part = name.partition(".")
        if group in GUARDED and part in ("src", "dst", "addr"):
            guard, sides, what = family(GUARDED[group]), ("src", "dst") if part == "addr" else (part,), "ip"
        elif group in ("tcp", "udp") and part in ("port", "srcport", "dstport"):
            guard, sides, what = _false(F.col("proto") == group), ("src", "dst") if part == "port" else (part[:3],), "port"
        elif name == "proto":
            what = "proto"
        elif not sides:
            raise self.fail(f"there is no field {name}", 1)
        op = self.take("==", "!=", "in")
        if op is None or op == "in" and what == "proto":
            raise self.fail("expected == or !=, or in for an address or a port")
        tests = self.tests(op, what, sides)
        out = reduce(Column.__and__ if op == "!=" else Column.__or__, tests)
        return out if guard is None else guard & out

    def tests(self, op: str, what: str, sides: tuple[str, ...]) -> list[Column]:
        if what == "proto":
            value = _protocol(self.atom())
            return [_false(F.col("proto") == value if op == "==" else F.col("proto") != value)]
        columns = [F.col(f"{s}_{'ip_key' if what == 'ip' else 'port'}") for s in sides]
        if op == "in" and what == "port":
            ports = self.ports()
            return [_false(c.isin(*ports)) for c in columns]
        text = self.atom()
        try:
            if op == "in":
                if "/" not in text:
                    raise ValueError
                return [_false(net.in_cidr(c, text)) for c in columns]
            value = net.ip_key_of(text) if what == "ip" else self.port(text)
        except ValueError:
            raise self.fail(f"{text} is no {'CIDR block' if op == 'in' else 'address' if what == 'ip' else 'port'}", 1) from None
        return [_false(c == value if op == "==" else c != value) for c in columns]

    def port(self, text: str) -> int:
        if not re.fullmatch(r"[0-9]+", text) or int(text) > 65535:
            raise ValueError(text)
        return int(text)

    def ports(self) -> list[int]:
        if not self.take("["):
            raise self.fail("expected [80, 443]")
        out = []
        while True:
            try:
                out.append(self.port(self.atom()))
            except ValueError:
                raise self.fail("a port is a number from 0 to 65535", 1) from None
            if self.take("]"):
                return sorted(set(out))
            if not self.take(","):
                raise self.fail("expected , or ]")


def family(version: int) -> Column:
    return _false(F.col("src_ip_key").startswith(str(version)))


def compatible(source: str) -> Column:
    """The column of a filter in the compatibility grammar."""
    reader = _Reader(source)
    out = reader.any(0)
    if reader.at < len(reader.tokens):
        raise reader.fail("unexpected here")
    return out


#: Byte expressions: where their layer begins in the datagram.
_BYTES = re.compile(r"(ip6?|tcp|udp|icmp)\[\s*(\d+)\s*(?::\s*([124])\s*)?\](?:\s*&\s*(0x[0-9a-fA-F]+|\d+))?\s*(<=|>=|==|=|!=|<|>)\s*(0x[0-9a-fA-F]+|\d+)")


class _Capture:
    """``[src|dst] host|net|port|portrange VALUE``, protocols, ``greater``, ``less``, bytes of a layer (``tcp[13] & 2 != 0``; they need the
    datagram), and, or, not and parentheses."""

    def __init__(self, source: str) -> None:
        self.source, self.at = source, 0
        self.words = [m[0] for m in re.finditer(_BYTES.pattern + r"|[()!]|&&|\|\||[^\s()!&|]+", source)]

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at] in texts:
            self.at += 1
            return self.words[self.at - 1]
        return None

    def word(self) -> str:
        if self.at >= len(self.words):
            raise QuerySyntaxError("the filter ends too early", self.source, len(self.source), len(self.source))
        self.at += 1
        return self.words[self.at - 1]

    def any(self) -> Column:
        """Left to right: ``and`` and ``or`` bind alike."""
        out = self.one()
        while op := self.take("and", "&&", "or", "||"):
            right = self.one()
            out = out & right if op in ("and", "&&") else out | right
        return out

    def one(self) -> Column:
        if self.take("not", "!"):
            return ~self.one()
        if self.take("("):
            out = self.any()
            if not self.take(")"):
                raise QuerySyntaxError("expected )", self.source, len(self.source), len(self.source))
            return out
        first = self.word()
        if m := _BYTES.fullmatch(first):
            return self.bytes_of(*m.groups())
        if first in ("greater", "less"):
            n = self.word()
            if not n.isdigit():
                raise QuerySyntaxError(f"{n} is no length", self.source)
            return F.col("original_len") >= int(n) if first == "greater" else F.col("original_len") <= int(n)
        if first in ("ip", "ip6", "icmp6", *TRANSPORTS[:3]):
            name = {"ip6": "ipv6", "icmp6": "icmpv6"}.get(first, first)
            test = family(GUARDED[name]) if name in GUARDED else _false(F.col("proto") == name)
            more = self.words[self.at] if self.at < len(self.words) else ""
            return test & self.primitive(self.word()) if more in ("src", "dst", "host", "net", "port", "portrange") else test
        if first in LINKS:
            return _false(F.col("link_proto") == first)
        return self.primitive(first)

    def bytes_of(self, layer: str, at: str, size: str | None, mask: str | None, op: str, value: str) -> Column:
        """Numbers in a layer of a packet that is whole; in IPv6 a transport layer is found behind no extension."""
        six = F.col("src_ip").contains(":")
        first = F.conv(F.hex(F.substring("datagram", 1, 1)), 16, 10).cast("int")
        start = F.when(six, F.lit(40)).otherwise(first % 16 * 4) if layer not in ("ip", "ip6") else F.lit(0)
        part = F.substr("datagram", start + int(at) + 1, F.lit(int(size or 1)))
        number = F.when(F.octet_length(part) == int(size or 1), F.conv(F.hex(part), 16, 10).cast("bigint"))
        if mask is not None:
            number = number.bitwiseAND(F.lit(int(mask, 0)).cast("bigint"))
        right = F.lit(int(value, 0)).cast("bigint")
        test = {"=": number == right, "==": number == right, "!=": number != right, "<": number < right, "<=": number <= right, ">": number > right, ">=": number >= right}[op]
        of = {"ip": ~six, "ip6": six}.get(layer, (F.col("proto") == layer) & ~F.coalesce("fragmented", F.lit(False)))
        return _false(of & test)

    def primitive(self, first: str) -> Column:
        sides = ("src", "dst")
        if first in sides:
            sides, first = (first,), self.word()
        if first not in ("host", "net", "port", "portrange"):
            raise QuerySyntaxError(f"{first} is not supported in capture filters here", self.source)
        value = self.word()
        try:
            if first == "host":
                tests = [F.col(f"{s}_ip_key") == net.ip_key_of(value) for s in sides]
            elif first == "net":
                tests = [net.in_cidr(F.col(f"{s}_ip_key"), str(ipaddress.ip_network(value, strict=False))) for s in sides]
            else:
                lo, _, hi = value.partition("-")
                if (first == "portrange") != bool(hi):
                    raise ValueError
                tests = [F.col(f"{s}_port").between(int(lo), int(hi or lo)) for s in sides]
        except ValueError:
            raise QuerySyntaxError(f"{value} is no {first}", self.source) from None
        return reduce(Column.__or__, map(_false, tests))


def capture_filter(source: str) -> Column:
    reader = _Capture(source)
    out = reader.any()
    if reader.at < len(reader.words):
        raise QuerySyntaxError(f"{reader.words[reader.at]} is unexpected", source)
    return out


def keyed(packets: DataFrame) -> DataFrame:
    return packets.withColumns({f"{s}_ip_key": net.ip_key(F.col(f"{s}_ip")) for s in ("src", "dst") if f"{s}_ip_key" not in packets.columns})


def filtered(packets: DataFrame, expression: str | None, syntax: str = "auto", now_ms: int | None = None) -> DataFrame:
    """Decoded records that a filter lets pass.

    ``auto`` takes protocol names, then event predicates, then the compatibility grammar, then capture filters; frames
    that are not IP pass only where there is no filter, a link name, or a capture filter that names them.
    """
    text = (expression or "").strip()
    if not text or text == "*" and syntax != "bpf":
        return packets
    if syntax == "auto" and text.lower() in APPLICATIONS:
        return packets.where(F.col("app") == text.lower())
    if syntax == "auto" and text.lower() in LINKS:
        return packets.where(F.col("link_proto") == text.lower())
    return keyed(packets).where(_test(text, syntax, now_ms)).select(*packets.columns)


def _test(text: str, syntax: str, now_ms: int | None) -> Column:
    if syntax == "bpf":
        return capture_filter(text)
    try:
        node = P.parse(text, now_ms)
        names = {"event_type": F.lit("packet"), "packets": F.lit(1), "bytes": F.col("original_len"), "timestamp_ms": net.ms_of_ns(F.col("timestamp_ns"))}
        test = P.to_column(node, lambda c: names.get(c, F.col(c)))
        return (F.col("kind") == "packet") & test
    except QuerySyntaxError as e:
        first = e
    try:
        return (F.col("kind") == "packet") & compatible(text)
    except QuerySyntaxError:
        if syntax == "cql":
            raise first from None
    try:
        return capture_filter(text)
    except QuerySyntaxError:
        raise first from None


#: EtherTypes of VLAN tags, IPv4 and IPv6.
TAGS, IP4, IP6 = ("8100", "88A8", "9100"), "0800", "86DD"


def ethernet_hint(node: P.Node) -> Column | None:
    """A condition on the bytes (``data``) of an Ethernet frame that every match of the predicate fulfils; null for none.

    Only addresses, blocks and protocols that must be so narrow; what else there is, and a negation, widens.
    """
    if isinstance(node, P.All):
        known = [h for h in map(ethernet_hint, node.parts) if h is not None]
        return reduce(Column.__and__, known) if known else None
    if isinstance(node, P.Any):
        known = [ethernet_hint(x) for x in node.parts]
        return None if any(h is None for h in known) else reduce(Column.__or__, known)
    if not isinstance(node, (P.Compare, P.InBlock)):
        return None
    hexed = lambda at, n: F.hex(F.substring("data", at + 1, n))
    if isinstance(node, P.Compare) and node.field.column == "proto" and node.op == "==" and node.value in NUMBER_OF:
        return (hexed(12, 2) == IP6) | (hexed(12, 2) == IP4) & (hexed(23, 1) == f"{NUMBER_OF[node.value]:02X}")
    if node.field.column in ("src_ip", "dst_ip") and (isinstance(node, P.InBlock) or node.op == "=="):
        lo, hi = net.cidr_keys(node.block) if isinstance(node, P.InBlock) else (net.ip_key_of(node.value),) * 2
        side = node.field.column == "dst_ip"
        at, n, kind = (26 + 4 * side, 4, IP4) if lo[0] == "4" else (22 + 16 * side, 16, IP6)
        return (hexed(12, 2) == kind) & hexed(at, n).between(lo[1:].upper(), hi[1:].upper())
    return None


def prefiltered(records: DataFrame, text: str, now_ms: int | None = None) -> DataFrame:
    """Capture records less those that cannot match, told by their bytes before anything is decoded; the filter itself decides later.
    Frames with VLAN tags and of other links all stay."""
    try:
        hint = ethernet_hint(P.parse(text, now_ms))
    except QuerySyntaxError:
        return records
    if hint is None:
        return records
    return records.where((F.col("linktype") != 1) | F.hex(F.substring("data", 13, 2)).isin(*TAGS) | hint)


_QUERY_WORDS = re.compile(r"(?<![\w.])(?:bytes|packets|where)(?![\w.])|(?<![\w.])(?:flow|event|conversation|identity)\.")


def is_query(text: str) -> bool:
    """Whether what is asked of flows is a query over ended flows, and no packet filter."""
    bare = re.sub(r'"(?:[^"\\]|\\.)*"', '""', text)
    return bool(re.search(r"(?<!\|)\|(?!\|)", bare) or _QUERY_WORDS.search(bare))
