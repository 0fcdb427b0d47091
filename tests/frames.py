"""Frames and captures for tests."""

from __future__ import annotations

import ipaddress
import struct

V4, V6 = ("192.0.2.10", "198.51.100.20"), ("2001:db8::10", "2001:db8::20")
MACS = bytes.fromhex("020000000002020000000001")


def _sum(b: bytes) -> int:
    b += b"\0" * (len(b) % 2)
    n = sum(struct.unpack(f">{len(b) // 2}H", b))
    while n >> 16:
        n = (n & 0xFFFF) + (n >> 16)
    return ~n & 0xFFFF


def ip(payload: bytes, proto: int, src: str = V4[0], dst: str = V4[1], ident: int = 1, bits: int = 0) -> bytes:
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 4:
        head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), ident, bits, 64, proto, 0, a.packed, b.packed)
        return head[:10] + struct.pack(">H", _sum(head)) + head[12:] + payload
    return struct.pack(">IHBB16s16s", 6 << 28, len(payload), proto, 64, a.packed, b.packed) + payload


def ethernet(data: bytes, kind: int | None = None, vlan: int | None = None) -> bytes:
    kind = kind if kind is not None else 0x0800 if data[0] >> 4 == 4 else 0x86DD
    tag = struct.pack(">HH", 0x8100, vlan) if vlan is not None else b""
    return MACS + tag + struct.pack(">H", kind) + data


def tcp(sport: int, dport: int, seq: int, flags: int, data: bytes = b"", src: str = V4[0], dst: str = V4[1]) -> bytes:
    return ethernet(ip(struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 8192, 0, 0) + data, 6, src, dst))


def udp(sport: int, dport: int, data: bytes = b"", src: str = V4[0], dst: str = V4[1]) -> bytes:
    return ethernet(ip(struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data, 17, src, dst))


def icmp(src: str = V4[0], dst: str = V4[1]) -> bytes:
    six = ":" in src
    return ethernet(ip(bytes((128 if six else 8, 0)) + bytes(6), 58 if six else 1, src, dst))


def name(text: str) -> bytes:
    return b"".join(bytes((len(x),)) + x.encode() for x in text.strip(".").split(".")) + b"\0"


def dns(qname: str = "example.test", response: bool = False, answers: list[tuple[int, int, bytes]] = ()) -> bytes:
    head = struct.pack(">HHHHHH", 7, 0x8180 if response else 0x0100, 1, len(answers), 0, 0)
    body = name(qname) + struct.pack(">HH", 1, 1)
    return head + body + b"".join(b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, ttl, len(data)) + data for kind, ttl, data in answers)


def client_hello(server: str = "example.test", alpn: str = "h2") -> bytes:
    sni = struct.pack(">HBH", len(server) + 3, 0, len(server)) + server.encode()
    proto = struct.pack(">HB", len(alpn) + 1, len(alpn)) + alpn.encode()
    ext = struct.pack(">HH", 0, len(sni)) + sni + struct.pack(">HH", 16, len(proto)) + proto
    body = b"\x03\x03" + bytes(32) + b"\0" + struct.pack(">HH", 2, 0x1301) + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


EXAMPLE = [tcp(50000, 443, 1, 2), udp(53000, 53), tcp(50001, 443, 1, 2, b"", *V6), udp(53001, 53, b"", *V6), icmp(), icmp(*V6)]


def pcap(frames: list[bytes], times: list[float] | None = None, order: str = "<", nano: bool = False, link: int = 1) -> bytes:
    times = times or [1_700_000_000 + k + (0.123456789 if nano else 0.123456) for k in range(len(frames))]
    out = struct.pack(f"{order}IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for t, f in zip(times, frames, strict=True):
        sec = int(t)
        frac = round((t - sec) * 1e9) if nano else round((t - sec) * 1e6)
        out += struct.pack(f"{order}IIII", sec, frac, len(f), len(f)) + f
    return out


def block(kind: int, body: bytes, order: str = "<") -> bytes:
    body += b"\0" * (-len(body) % 4)
    return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)


def pcapng(frames: list[bytes], ticks: list[int], options: bytes = b"", order: str = "<", simple: bool = False) -> bytes:
    out = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    out += block(1, struct.pack(f"{order}HHI", 1, 0, 65535) + options, order)
    for t, f in zip(ticks, frames, strict=True):
        if simple:
            out += block(3, struct.pack(f"{order}I", len(f)) + f, order)
        else:
            out += block(6, struct.pack(f"{order}IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f, order)
    return out
