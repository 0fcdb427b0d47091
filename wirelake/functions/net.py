"""Network scalars as Spark columns, and their driver-side counterparts for literals.

An address has a sortable key: ``4`` and eight hex digits, or ``6`` and 32. A CIDR block is then a range of keys,
which filters push down as plain comparisons; keys of null or invalid texts are null.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Groups of hex digits around at most one double colon, with a dotted tail perhaps.
V6 = rf"^(?=.*:)(?!.*::.*::)(?!.*:::)(?:[0-9a-fA-F]{{0,4}}:){{2,7}}(?:[0-9a-fA-F]{{0,4}}|{_OCTET}(?:\.{_OCTET}){{3}})$"


def ip_key_of(text: str) -> str:
    address = ipaddress.ip_address(text)
    return f"{address.version}{int(address):0{8 if address.version == 4 else 32}x}"


def cidr_keys(text: str) -> tuple[str, str]:
    """The first and last key of a block."""
    net = ipaddress.ip_network(text, strict=False)
    return ip_key_of(str(net[0])), ip_key_of(str(net[-1]))


def _hex(number: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(number.cast("long")), width, "0"))


def _v4_hex(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.concat(*[_hex(F.element_at(parts, k), 2) for k in range(1, 5)])


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda g: g != "")


def _padded(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lower(F.lpad(g, 4, "0"))), "")


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ip_key(text: Column) -> Column:
    """Key of an address text; null for what is none."""
    return F.when(text.rlike(V4), F.concat(F.lit("4"), _v4_hex(text))).when(text.rlike(V6), once(text, _v6_key))


def _v6_key(text: Column) -> Column:
    tail = F.regexp_extract(text, rf"({_OCTET}(?:\.{_OCTET}){{3}})$", 1)
    grouped = once(tail, lambda t: once(_v4_hex(t), lambda h: F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(t)), F.substr(h, F.lit(1), F.lit(4)), F.lit(":"), F.substr(h, F.lit(5), F.lit(4)))))
    plain = F.when(text.contains("."), grouped).otherwise(text)

    def whole(halves: Column) -> Column:
        left, right = _groups(F.element_at(halves, 1)), F.when(F.size(halves) > 1, _groups(F.element_at(halves, -1))).otherwise(F.array().cast("array<string>"))

        def key(g: Column) -> Column:
            given = F.size(g["l"]) + F.size(g["r"])
            fits = F.when(F.size(halves) > 1, given < 8).otherwise(given == 8)
            return F.when(fits, F.concat(F.lit("6"), _padded(g["l"]), F.repeat(F.lit("0000"), F.lit(8) - given), _padded(g["r"])))

        return once(F.struct(left.alias("l"), right.alias("r")), key)

    return once(F.split(plain, "::"), whole)


def in_cidr(key: Column, block: str) -> Column:
    """Whether a key lies in a block; null for a null key, false for the other family."""
    lo, hi = cidr_keys(block)
    return key.between(F.lit(lo), F.lit(hi))


def identity(*parts: Column) -> Column:
    """64 hex digits over the parts, each led by its length, so that no two lists of parts collide."""
    framed = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(x.cast("string"), F.lit("")) for x in parts)]
    return F.sha2(F.concat(*framed), 256)


def ms_of_ns(ns: Column) -> Column:
    """Milliseconds, rounded down also before 1970, of decimal nanoseconds; null where 64 bits do not hold them."""
    ns, n = ns.cast("decimal(38,0)"), F.lit(1_000_000).cast("decimal(38,0)")
    floored = F.call_function("div", ns - F.pmod(ns, n), n)
    limit = F.lit(str(9_223_372_036_854_775_807 * 1_000_000)).cast("decimal(38,0)")
    return F.when((ns >= -limit) & (ns <= limit), floored)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def domain(text: Column) -> Column:
    """A normal domain name: ASCII letters in lower case, no dots at the end; null if a label is empty, too long, or has other
    characters than ASCII letters, digits, hyphens and underscores."""
    name = F.translate(F.regexp_replace(text, r"\.+$", ""), UPPER, LOWER)
    return F.when((F.length(name) <= 253) & name.rlike(r"^[a-z0-9_-]{1,63}(?:\.[a-z0-9_-]{1,63})*$"), name)


#: What the URL standard has percent-encoded in paths and in queries of http(s), and what no host may hold.
IN_PATH, IN_QUERY, NO_HOST = r"[^\x21-\x7E]|[\"<>`#?{}]", r"[^\x21-\x7E]|[\"#<>']", r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]|[^\x00-\x7F]"


def _encoded(text: Column, these: str) -> Column:
    """Characters of the pattern as the bytes of their UTF-8, percent-encoded."""
    letter = lambda c: F.when(c.rlike(these), F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")).otherwise(c)
    return once(text, lambda t: F.when(t.rlike(these), F.array_join(F.transform(F.split(t, ""), letter), "")).otherwise(t))


def _path(text: Column) -> Column:
    """The path without dot segments, percent-encoded; backslashes are slashes."""

    def walk(parts: Column) -> Column:
        kinds = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.regexp_replace(F.lower(p), "%2e", ".").alias("d"), (i == F.size(parts) - 1).alias("last")))

        def step(done: Column, x: Column) -> Column:
            end = F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
            return F.when(x["d"] == "..", F.concat(up, end)).when(x["d"] == ".", F.concat(done, end)).otherwise(F.concat(done, F.array(x["p"])))

        return F.array_join(F.aggregate(kinds, F.array().cast("array<string>"), step), "/")

    slashed = F.regexp_replace(F.translate(text, "\\", "/"), "^/", "")
    walked = once(slashed, lambda t: F.when(t.rlike(r"(?i)(?:^|/)(?:\.|%2e)"), once(F.split(t, "/"), walk)).otherwise(t))
    return _encoded(F.concat(F.lit("/"), walked), IN_PATH)


def _v4_host(host: Column) -> Column:
    """The dotted address of a host whose last label is a number (decimal, octal or hexadecimal); null if it is none."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    number = lambda p: F.when(p.rlike(r"^0x[0-9a-f]{0,12}$"), F.coalesce(F.conv(F.nullif(F.substr(p, F.lit(3)), F.lit("")), 16, 10), F.lit("0"))).when(p.rlike(r"^0[0-7]{1,15}$"), F.conv(p, 8, 10)).when(p.rlike(r"^(?:0|[1-9][0-9]{0,11})$"), p).try_cast("bigint")

    def whole(numbers: Column) -> Column:
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        lead = F.slice(numbers, 1, n - 1)
        sound = (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(lead, lambda x: x > 255) & (last < F.pow(F.lit(256), 5 - n))
        value = F.aggregate(F.transform(lead, lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x) + last
        octets = [F.shiftright(value, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
        return F.when(sound, F.concat_ws(".", *octets))

    return F.when(F.size(parts) <= 4, once(F.transform(parts, number), whole))


def _v6_host(host: Column) -> Column:
    """The shortest text of a bracketed address; null if it is none."""

    def shortest(text: Column) -> Column:
        short = text
        for n in range(2, 9):  # the longest run of zeros, the first of equal ones
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$"
            short = F.when(text.rlike(run), F.regexp_replace(text, run, "$1::$2")).otherwise(short)
        return short

    def shown(key: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substr(key, k * 4 + 2, F.lit(4)), "^0{1,3}", ""))
        return F.when(key.startswith("6"), F.concat(F.lit("["), once(F.array_join(groups, ":"), shortest), F.lit("]")))

    return F.when(host.endswith("]"), once(ip_key(F.substr(host, F.lit(2), F.length(host) - 2)), shown))


def _host(raw: Column) -> Column:
    decoded = F.when(raw.contains("%"), F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B"))).otherwise(raw)

    def named(host: Column) -> Column:
        number = host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
        return F.when(host.startswith("["), _v6_host(host)).when((host == "") | host.rlike(NO_HOST), F.lit(None).cast("string")).when(number, _v4_host(host)).otherwise(host)

    return once(F.translate(decoded, UPPER, LOWER), named)


def url(text: Column) -> Column:
    """An http(s) URL as browsers write it, without fragment: scheme and host in lower case, numeric hosts as addresses, no default port, no
    dot segments, the rest percent-encoded. Null for other schemes, credentials, what is no URL, and hosts beyond ASCII (their
    names would need the tables of IDNA)."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def parts(bare: Column) -> Column:
        scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        rest = F.regexp_replace(F.substr(bare, F.length(scheme) + 2), r"^[/\\]+", "")
        authority = F.regexp_extract(rest, r"^[^/\\?]*", 0)
        tail = F.substr(rest, F.length(authority) + 1)
        path = F.regexp_extract(tail, r"^[^?]*", 0)
        return F.struct(scheme.alias("scheme"), F.regexp_extract(authority, r"^(.*)@", 1).alias("who"), F.regexp_extract(authority, r"[^@]*$", 0).alias("at"), path.alias("path"), F.when(F.length(tail) > F.length(path), F.substr(tail, F.length(path) + 2)).alias("query"))

    def made(u: Column) -> Column:
        split = r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
        port = F.regexp_replace(F.regexp_extract(u["at"], split, 2), "^0+(?=.)", "")
        default = F.when(u["scheme"] == "http", F.lit("80")).otherwise(F.lit("443"))
        shown = F.when((port == "") | (port == default), F.lit("")).when((F.length(port) <= 5) & (port.try_cast("int") <= 65535), F.concat(F.lit(":"), port))
        host = F.when(u["at"].rlike(split), _host(F.regexp_extract(u["at"], split, 1)))
        query = F.when(u["query"].isNull(), F.lit("")).otherwise(F.concat(F.lit("?"), _encoded(u["query"], IN_QUERY)))
        return F.when(u["scheme"].isin("http", "https") & u["who"].isin("", ":"), F.concat(u["scheme"], F.lit("://"), host, shown, _path(u["path"]), query))

    return once(once(F.regexp_replace(plain, r"(?s)#.*$", ""), parts), made)


def host_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://(\[[^\]]*\]|[^/?#:]*)", 1), F.lit(""))


#: TCP flag bits, their letters in order, and the named tests (mask, value; value 0: any bit of the mask).
FLAG_LETTERS = ((1, "F"), (2, "S"), (4, "R"), (8, "P"), (16, "."), (32, "U"), (64, "E"), (128, "W"))
FLAG_TESTS = {"syn": (2, 2), "syn-only": (18, 2), "syn-ack": (18, 18), "ack": (16, 16), "fin": (1, 1), "rst": (4, 4), "psh": (8, 8), "urg": (32, 32), "ece": (64, 64), "cwr": (128, 128)}


def has_flag(flags: Column, name: str) -> Column:
    mask, value = FLAG_TESTS[name]
    return flags.bitwiseAND(F.lit(mask)) == F.lit(value)


def flag_text(flags: Column) -> Column:
    """Letters of the set bits; ``none`` without any."""
    letters = F.concat_ws("", *[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(letter)) for bit, letter in FLAG_LETTERS])
    return F.when(flags.isNotNull(), F.when(letters == "", F.lit("none")).otherwise(letters))


#: Names of IP protocol numbers.
PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp", 58: "icmpv6"}


def protocol_text(number: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, name in PROTOCOLS.items():
        out = out.when(number == k, F.lit(name))
    return out.otherwise(number.cast("string"))


def protocol_name(number: int) -> str:
    return PROTOCOLS.get(number, str(number))


def duration_text(ms: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    ms = ms.cast("bigint")
    part = lambda div, mod: F.lpad((F.floor(ms / div) % mod).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), F.lit("0")), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def utc_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def mac_text(data: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(data), "(..)(?!$)", "$1:"))


def safe_text(text: Column) -> Column:
    """Printable ASCII, everything else a dot."""
    return F.regexp_replace(text, r"[^\x20-\x7E]", ".")


def json_scalar(payload: Column, path: str) -> Column:
    """Text of the scalar at a path; null for containers, null, what is missing and what is no JSON. A text that looks like a container
    is a text: only where the value begins like one is its type asked for."""
    value = F.get_json_object(payload, path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), path, "variant"))
    return F.when(value.rlike(r"^\s*[\[{]"), F.when(kind == "STRING", value)).otherwise(value)


DURATION = re.compile(r"^([0-9]+)(ms|s|m|h|d)$")
DURATION_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str, units: tuple[str, ...] = ("ms", "s", "m", "h", "d")) -> int | None:
    m = DURATION.match(text)
    return int(m[1]) * DURATION_MS[m[2]] if m and m[2] in units else None
