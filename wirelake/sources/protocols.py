"""Application messages out of bytes: DNS, TLS hellos, HTTP heads, SSH banners, and what a payload looks like."""

from __future__ import annotations

import ipaddress
import re
from typing import TYPE_CHECKING

from wirelake.errors import DecodeError

if TYPE_CHECKING:
    from wirelake.sources.decode import Packet

#: Limits of a message.
MAX_POINTERS, MAX_RECORDS, MAX_HEAD, GIVE_UP, MAX_BANNER = 128, 256, 65_536, 8192, 255
RR_TYPES = {1: "a", 28: "aaaa", 2: "ns", 5: "cname", 12: "ptr", 15: "mx", 16: "txt"}
METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH")


def bad(what: str) -> DecodeError:
    return DecodeError("DNS", what)


def escaped(data: bytes) -> str:
    """Letters, digits, hyphens and underscores as they are, any other byte as a backslash and three decimal digits."""
    return "".join(chr(c) if c < 128 and chr(c).isalnum() or c in b"-_" else f"\\{c:03d}" for c in data)


def dns_name(data: bytes, at: int) -> tuple[str, int]:
    """A name with its dot at the end, and where it ends; pointers lead backwards only."""
    labels, end, jumps, total, limit = [], None, 0, 0, at
    while True:
        if at >= len(data):
            raise bad("a name ends too early")
        n = data[at]
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(data):
                raise bad("a pointer ends too early")
            to = int.from_bytes(data[at : at + 2], "big") & 0x3FFF
            end = at + 2 if end is None else end
            jumps += 1
            if to >= limit or jumps > MAX_POINTERS:
                raise bad("a pointer that does not lead back")
            at = limit = to
        elif n & 0xC0:
            raise bad("a label of an unknown kind")
        elif not n:
            return ".".join([*labels, ""]) or ".", at + 1 if end is None else end
        else:
            label = data[at + 1 : at + 1 + n]
            total += n + 1
            if len(label) < n or total > 254:
                raise bad("a label too long")
            labels.append(escaped(label))
            at += n + 1


def _value(data: bytes, kind: int, at: int, n: int) -> dict:
    raw = data[at : at + n]
    if kind == 1 and n == 4 or kind == 28 and n == 16:
        return {"type": RR_TYPES[kind], "value": str(ipaddress.ip_address(raw))}
    if kind in (2, 5, 12):
        name, end = dns_name(data, at)
        if end != at + n:
            raise bad("a name is not its record's length")
        return {"type": RR_TYPES[kind], "value": name}
    if kind == 15 and n >= 3:
        name, end = dns_name(data, at + 2)
        if end != at + n:
            raise bad("a name is not its record's length")
        return {"type": "mx", "value": f"{int.from_bytes(raw[:2], 'big')} {name}"}
    if kind == 16:
        texts, k = [], 0
        while k < n:
            if k + 1 + raw[k] > n:
                raise bad("a text is not its record's length")
            texts.append(escaped(raw[k + 1 : k + 1 + raw[k]]))
            k += 1 + raw[k]
        return {"type": "txt", "value": "".join(texts)}
    if kind in (1, 28):
        raise bad("an address of the wrong length")
    return {"type": "unknown", "value": raw.hex()}


def dns_message(data: bytes) -> dict:
    """A whole DNS message; bytes left over are an error."""
    if len(data) < 12:
        raise bad("a message ends in its header")
    id_, bits, *counts = (int.from_bytes(data[k : k + 2], "big") for k in range(0, 12, 2))
    if sum(counts) > MAX_RECORDS:
        raise bad(f"more than {MAX_RECORDS} records")
    at, questions, sections = 12, [], []
    for _ in range(counts[0]):
        name, at = dns_name(data, at)
        if at + 4 > len(data):
            raise bad("a question ends too early")
        questions.append({"name": name, "rr_type": int.from_bytes(data[at : at + 2], "big"), "class": int.from_bytes(data[at + 2 : at + 4], "big")})
        at += 4
    for n in counts[1:]:
        records = []
        for _ in range(n):
            name, at = dns_name(data, at)
            if at + 10 > len(data):
                raise bad("a record ends too early")
            kind, class_, ttl, size = (int.from_bytes(data[at + a : at + b], "big") for a, b in ((0, 2), (2, 4), (4, 8), (8, 10)))
            at += 10
            if at + size > len(data):
                raise bad("a record's data ends too early")
            records.append({"name": name, "rr_type": kind, "class": class_, "ttl": ttl, "data": _value(data, kind, at, size)})
            at += size
        sections.append(records)
    if at != len(data):
        raise bad("bytes after the message")
    return {
        "id": id_, "response": bool(bits & 0x8000), "opcode": bits >> 11 & 15, "truncated": bool(bits & 0x0200), "rcode": bits & 15,
        "questions": questions, "answers": sections[0], "authorities": sections[1], "additionals": sections[2],
    }


class _Cut:
    """Length-prefixed reading of a TLS structure."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DecodeError("TLS", "a hello ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def block(self, n: int) -> bytes:
        return self.take(self.number(n))

    @property
    def done(self) -> bool:
        return self.at >= len(self.data)


def tls_handshake(data: bytes) -> bytes | None:
    """The first handshake message in TLS records; None while it is not whole."""
    out, at = b"", 0
    while True:
        if len(out) >= 4 and len(out) >= 4 + int.from_bytes(out[1:4], "big"):
            return out[: 4 + int.from_bytes(out[1:4], "big")]
        if len(out) > MAX_HEAD:
            raise DecodeError("TLS", "a hello too long")
        if len(data) < at + 5:
            return None
        if data[at] != 22 or data[at + 1] != 3 or data[at + 2] > 4:
            raise DecodeError("TLS", "no handshake record")
        n = int.from_bytes(data[at + 3 : at + 5], "big")
        if not 0 < n <= 16_640:
            raise DecodeError("TLS", "a record of no or too great length")
        if len(data) < at + 5 + n:
            return None
        out, at = out + data[at + 5 : at + 5 + n], at + 5 + n


def tls_hello(message: bytes) -> dict | None:
    """A client or server hello; None for another handshake message."""
    kind, c = message[0], _Cut(message[4:])
    if kind not in (1, 2):
        return None
    version = c.number(2)
    c.take(32)
    c.block(1)
    if kind == 1:
        suites = c.block(2)
        if len(suites) % 2:
            raise DecodeError("TLS", "cipher suites of odd length")
        ciphers = [int.from_bytes(suites[k : k + 2], "big") for k in range(0, len(suites), 2)]
        c.block(1)
    else:
        ciphers = [c.number(2)]
        c.take(1)
    extensions: dict[int, bytes] = {}
    if not c.done:
        e = _Cut(c.block(2))
        while not e.done:
            id_ = e.number(2)
            if id_ in extensions:
                raise DecodeError("TLS", "an extension stands twice")
            extensions[id_] = e.block(2)
    if not c.done:
        raise DecodeError("TLS", "bytes after the hello")
    out: dict = {"type": "tls.client_hello" if kind == 1 else "tls.server_hello", "version": version, "ciphers": ciphers, "alpn": [], "server_name": None, "versions": [], "ech": 0xFE0D in extensions}
    if 16 in extensions:
        a = _Cut(_Cut(extensions[16]).block(2))
        while not a.done:
            out["alpn"].append(a.block(1).decode("ascii", "replace"))
    if 43 in extensions:
        v = extensions[43][1:] if kind == 1 else extensions[43]
        out["versions"] = [int.from_bytes(v[k : k + 2], "big") for k in range(0, len(v) - 1, 2)]
    if kind == 1 and 0 in extensions:
        s = _Cut(_Cut(extensions[0]).block(2))
        while not s.done:
            sort, name = s.number(1), s.block(2)
            if not sort:
                out["server_name"] = name.decode("ascii", "replace")
                break
    return out


_REQUEST = re.compile(rb"^([!#$%&'*+.^_`|~0-9A-Za-z-]{1,32}) (\S{1,8192}) HTTP/(1\.[01])$")
_STATUS = re.compile(rb"^HTTP/(1\.[01]) ([0-9]{3})(?: .*)?$")


def http_head(data: bytes) -> tuple[dict, int, dict[str, list[str]]] | None:
    """(event, length of the head, headers); None while the head is not whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        if len(data) > MAX_HEAD:
            raise DecodeError("HTTP", "a head too long")
        return None
    first, *lines = data[:end].split(b"\r\n")
    headers: dict[str, list[str]] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise DecodeError("HTTP", "a header line that is none")
        headers.setdefault(name.decode("latin-1").lower(), []).append(value.strip().decode("latin-1"))
    if m := _REQUEST.match(first):
        event = {"type": "http.request", "method": m[1].decode(), "target": m[2].decode("latin-1"), "host": headers.get("host", [None])[0], "version": m[3].decode()}
    elif m := _STATUS.match(first):
        event = {"type": "http.response", "status": int(m[2]), "server": headers.get("server", [None])[0], "version": m[1].decode()}
    else:
        raise DecodeError("HTTP", "a first line that is none")
    return event, end + 4, headers


def ssh_banner(data: bytes) -> dict | None:
    """The version line; None while it is not whole."""
    end = data.find(b"\n")
    if end < 0 or end >= MAX_BANNER:
        if len(data) >= MAX_BANNER:
            raise DecodeError("SSH", "a banner too long")
        return None
    line = data[:end].rstrip(b"\r")
    if not line.startswith((b"SSH-2.0-", b"SSH-1.99-")) or not all(32 <= c < 127 for c in line):
        raise DecodeError("SSH", "a banner that is none")
    return {"type": "ssh.banner", "banner": line.decode()}


def looks_like(data: bytes) -> str | None:
    """Which stream protocol the first bytes begin, by content alone: '' while they could be one, None if none."""
    if data[:1] == b"\x16":
        return "tls" if len(data) < 3 or data[1] == 3 and data[2] <= 4 else None
    starts = [b"SSH-", b"HTTP/1.", *[f"{m} ".encode() for m in METHODS]]
    for s in starts:
        if data.startswith(s):
            return "ssh" if s == b"SSH-" else "http"
        if s.startswith(data):
            return ""
    return None


def recognise(p: Packet) -> str | None:
    """http, ssh, tls or dns by this packet alone; DNS on its port and only if it parses whole."""
    data = p.payload
    if p.number == 6 and data:
        first = data.split(b"\r\n", 1)[0]
        if _REQUEST.match(first) or _STATUS.match(first):
            return "http"
        if data.startswith(b"SSH-"):
            return "ssh"
        if len(data) >= 5 and 20 <= data[0] <= 24 and data[1] == 3 and data[2] <= 4:
            return "tls"
    if data and 53 in (p.src_port, p.dst_port):
        try:
            dns_message(data[2:] if p.number == 6 else data)
        except DecodeError:
            return None
        return "dns"
    return None
