"""Event predicates: text to a typed tree to one Spark column.

Three-valued as in SQL: a comparison with a missing field is unknown, also under negation. The grammar is
``or`` below ``and`` below ``not``, with comparisons, string tests, ``in`` for CIDR blocks and port lists, byte
units, and ``now()`` less a duration, folded once with the clock that is passed in.
"""

from __future__ import annotations

import ipaddress
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake.errors import QuerySyntaxError
from wirelake.functions import net

#: Limits of a query.
MAX_BYTES, MAX_TOKENS, MAX_DEPTH, MAX_PORTS = 16_384, 1024, 32, 256


class Kind(Enum):
    TEXT = "text"
    NUMBER = "number"
    PORT = "port"
    IP = "ip"


#: Columns and their other names; every dotted name also goes with an underscore.
NAMES = {
    "event_id": ("event.id",),
    "flow_id": ("flow.id",),
    "conversation_id": ("conversation.id",),
    "identity_status": ("identity.status",),
    "sensor": (),
    "source": (),
    "timestamp_ms": ("timestamp", "time"),
    "timestamp_ns": (),
    "event_type": ("type", "event.type"),
    "src_ip": ("src.ip", "ip.src", "ipv6.src"),
    "dst_ip": ("dst.ip", "ip.dst", "ipv6.dst"),
    "src_port": ("src.port",),
    "dst_port": ("dst.port",),
    "proto": (),
    "packets": ("flow.packets",),
    "bytes": ("flow.bytes",),
    "window_start_ms": ("window",),
    "payload": (),
    "dns_qname": ("dns.qname",),
    "tls_server_name": ("tls.server_name",),
    "http_host": ("http.host",),
    "http_method": ("http.method",),
    "http_status": ("http.status",),
    "file_sha256": ("file.sha256",),
    "file_size": ("file.size",),
    "anomaly_code": ("anomaly.code",),
}
KINDS = {"src_ip": Kind.IP, "dst_ip": Kind.IP, "src_port": Kind.PORT, "dst_port": Kind.PORT} | dict.fromkeys(("packets", "bytes", "timestamp_ms", "window_start_ms", "http_status", "file_size"), Kind.NUMBER)
_COLUMNS = {name: column for column, names in NAMES.items() for name in (column, *names)}


@dataclass(frozen=True)
class Field:
    column: str
    kind: Kind
    family: int | None = None


def field(name: str) -> Field:
    column = _COLUMNS.get(name)
    if column is None:
        raise KeyError(name)
    family = {"ip.": 4, "ipv6.": 6}.get(name[: name.find(".") + 1])
    return Field(column, KINDS.get(column, Kind.TEXT), family)


def is_numeric(column: str) -> bool:
    return KINDS.get(column) in (Kind.NUMBER, Kind.PORT)


class Node:
    """A predicate."""


@dataclass(frozen=True)
class Everything(Node):
    pass


@dataclass(frozen=True)
class Compare(Node):
    field: Field
    op: str
    value: str | int


@dataclass(frozen=True)
class InBlock(Node):
    field: Field
    block: str


@dataclass(frozen=True)
class InPorts(Node):
    field: Field
    ports: tuple[int, ...]


@dataclass(frozen=True)
class Not(Node):
    inner: Node


@dataclass(frozen=True)
class All(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Any(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int
    word: bool


_SPECIAL = re.escape("()[],!<>=&|")
_TOKEN = re.compile(rf'\s*(?:("(?:[^"\\]|\\.)*")|(&&|\|\||[{_SPECIAL}]=|[{_SPECIAL}])|([^\s{_SPECIAL}"][^\s{_SPECIAL}]*)|("))', re.S)


def tokens(source: str) -> list[Token]:
    if len(source.encode()) > MAX_BYTES:
        raise QuerySyntaxError(f"a query has at most {MAX_BYTES} bytes")
    out, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = _TOKEN.match(source, at)
        if m is None or m[4]:
            start = m.start(4) if m else at
            raise QuerySyntaxError("a string is not closed", source, start, len(source), 'end it with "')
        out.append(Token(m[m.lastindex], m.start(m.lastindex), m.end(), m.lastindex != 2))
        at = m.end()
        if len(out) > MAX_TOKENS:
            raise QuerySyntaxError(f"a query has at most {MAX_TOKENS} tokens")
    return out


_UNITS = {"KB": 1024, "MB": 1024**2, "GB": 1024**3}
_ORDER = ("<", "<=", ">", ">=")
_STRING = ("contains", "starts_with", "ends_with")


class _Reader:
    def __init__(self, source: str, now_ms: int) -> None:
        self.source, self.now_ms = source, now_ms
        self.tokens = tokens(source)
        self.at = 0

    def fail(self, message: str, hint: str = "", back: int = 0) -> QuerySyntaxError:
        k = self.at - back
        if k < len(self.tokens):
            return QuerySyntaxError(message, self.source, self.tokens[k].start, self.tokens[k].end, hint)
        return QuerySyntaxError(message, self.source, len(self.source), len(self.source), hint)

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at].text in texts:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def word(self, what: str) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at].word:
            self.at += 1
            return self.tokens[self.at - 1].text
        raise self.fail(f"expected {what}")

    def any(self, depth: int) -> Node:
        parts = [self.all(depth)]
        while self.take("||", "or"):
            parts.append(self.all(depth))
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    def all(self, depth: int) -> Node:
        parts = [self.one(depth)]
        while self.take("&&", "and"):
            parts.append(self.one(depth))
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def one(self, depth: int) -> Node:
        if depth > MAX_DEPTH:
            raise self.fail(f"predicates nest at most {MAX_DEPTH} deep")
        if self.take("!", "not"):
            return Not(self.one(depth + 1))
        if self.take("("):
            inner = self.any(depth + 1)
            if not self.take(")"):
                raise self.fail("expected )")
            return inner
        name = self.word("a field")
        try:
            own = field(name)
        except KeyError:
            raise self.fail(f"there is no field {name}", back=1) from None
        if self.take("in"):
            return self.membership(name, own)
        op = self.take("==", "!=", *_ORDER, *_STRING)
        if op is None:
            raise self.fail("expected a comparison", "== != < <= > >= in contains starts_with ends_with")
        if op in _STRING and own.kind is not Kind.TEXT:
            raise self.fail(f"{op} needs a text field", back=1)
        if op in _ORDER and own.kind not in (Kind.NUMBER, Kind.PORT):
            raise self.fail(f"{op} needs a number field", back=1)
        return Compare(own, op, self.value(name, own))

    def membership(self, name: str, own: Field) -> Node:
        if own.kind is Kind.IP:
            text = self.word("a CIDR block").strip('"')
            try:
                if "/" not in text:
                    raise ValueError
                return InBlock(own, str(ipaddress.ip_network(text, strict=False)))
            except ValueError:
                raise self.fail("expected a CIDR block", f"{name} in 192.0.2.0/24", back=1) from None
        if own.kind is not Kind.PORT or not self.take("["):
            raise self.fail("in goes with an address and a CIDR block, or a port and a list")
        ports = [self.port(name)]
        while not self.take("]"):
            if len(ports) >= MAX_PORTS or not self.take(","):
                raise self.fail(f"expected , or ] (at most {MAX_PORTS} ports)")
            ports.append(self.port(name))
        return InPorts(own, tuple(ports))

    def port(self, name: str) -> int:
        text = self.word("a port")
        if not re.fullmatch(r"\+?[0-9]+", text) or int(text) > 65535:
            raise self.fail("a port is a number from 0 to 65535", f"{name} in [80, 443]", back=1)
        return int(text)

    def value(self, name: str, own: Field) -> str | int:
        text = self.word("a value")
        if own.column == "timestamp_ms" and text == "now":
            if not (self.take("(") and self.take(")")):
                raise self.fail("expected now()")
            if not self.take("-"):
                return self.now_ms
            ms = net.duration_ms(self.word("a duration"))
            if ms is None:
                raise self.fail("expected a duration", "30m", back=1)
            return self.now_ms - ms
        if own.kind is Kind.TEXT:
            if not text.startswith('"'):
                return text
            try:
                return json.loads(text)
            except ValueError:
                raise self.fail("a string has an escape that is none", back=1) from None
        if own.kind is Kind.IP:
            try:
                return str(ipaddress.ip_address(text.strip('"')))
            except ValueError:
                raise self.fail("expected an address", f"{name} == 192.0.2.10", back=1) from None
        m = re.fullmatch(r"([+-]?[0-9]+)(KB|MB|GB)?", text)
        number = int(m[1]) * _UNITS.get(m[2], 1) if m else None
        if number is None or abs(number) >= 1 << 127:
            raise self.fail(f"{name} goes with a whole number", f"{name} {'== 443' if own.kind is Kind.PORT else '> 1000'}", back=1)
        if own.kind is Kind.PORT and not 0 <= number <= 65535:
            raise self.fail("a port is a number from 0 to 65535", f"{name} == 443", back=1)
        return number


def parse(source: str, now_ms: int | None = None) -> Node:
    """The predicate that ``source`` says; ``now_ms`` is what now() stands for."""
    if source.strip() in ("", "*"):
        return Everything()
    reader = _Reader(source, int(time.time() * 1000) if now_ms is None else now_ms)
    out = reader.any(0)
    if reader.at < len(reader.tokens):
        raise reader.fail("unexpected here", "join predicates with && or ||")
    return out


#: How a column of the rows is reached; the key of an address column is asked for as <column>_key.
Resolver = Callable[[str], Column]


def _number(column: Column, op: str, value: int) -> Column:
    if not -(1 << 63) <= value < 1 << 63:  # no row has such a value, and unknown stays unknown
        above = value > 0
        holds = {"==": False, "!=": True, "<": above, "<=": above, ">": not above, ">=": not above}[op]
        return F.when(column.isNotNull(), F.lit(holds))
    return {"==": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]


def to_column(node: Node, resolve: Resolver = F.col) -> Column:
    """One column that is true for the rows that match; unknown follows SQL."""
    if isinstance(node, Everything):
        return F.lit(True)
    if isinstance(node, Not):
        return ~to_column(node.inner, resolve)
    if isinstance(node, All):
        return reduce(Column.__and__, [to_column(x, resolve) for x in node.parts])
    if isinstance(node, Any):
        return reduce(Column.__or__, [to_column(x, resolve) for x in node.parts])
    own = node.field
    if own.kind is Kind.IP:
        key = resolve(f"{own.column}_key")
        if isinstance(node, InBlock):
            test = net.in_cidr(key, node.block)
        else:
            # Text that is no address equals none: known, where there is text. The comparison of keys stays a conjunct by itself, which reaches the scan.
            test, given = _number_free(key, node.op, net.ip_key_of(node.value)), resolve(own.column).isNotNull()
            test = test & (key.isNotNull() | ~given) if node.op == "==" else test | (key.isNull() & given)
        return (key.startswith(str(own.family)) & test) if own.family else test
    column = resolve(own.column)
    if isinstance(node, InPorts):
        return column.isin(*sorted(set(node.ports)))
    if own.kind is Kind.TEXT:
        tests = {"contains": column.contains, "starts_with": column.startswith, "ends_with": column.endswith}
        return tests[node.op](F.lit(node.value)) if node.op in tests else _number_free(column, node.op, node.value)
    return _number(column, node.op, node.value)


def _number_free(column: Column, op: str, value: str) -> Column:
    return column == F.lit(value) if op == "==" else column != F.lit(value)


def conjuncts(node: Node) -> list[Node]:
    return [x for p in node.parts for x in conjuncts(p)] if isinstance(node, All) else [node]


def columns(node: Node) -> set[str]:
    if isinstance(node, (All, Any)):
        return set().union(*(columns(x) for x in node.parts))
    if isinstance(node, Not):
        return columns(node.inner)
    return set() if isinstance(node, Everything) else {node.field.column}
