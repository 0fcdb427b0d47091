"""Registered queries over made captures, datagrams and odd values, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.functions import net
from wirelake.operators import correlate, enrich, evidence, flows, output, retention, stats
from wirelake.plans import ingest, modules, packets, pipeline, policy
from wirelake.plans.observations import OBSERVATIONS_SQL, PACKETS_SQL, epoch_us, observations, table
from wirelake.plans.observations import packets as made_packets
from wirelake.plans.wire import _hex, _ipv4, _MACS, _records, _tcp, _text, _udp
from wirelake.sources import decode, netflow, pcap, reassembly
from wirelake.sources.store import Store

# Captures


def _little(number: Column, n: int) -> Column:
    return F.concat(*[_hex(F.shiftrightunsigned(number.cast("bigint"), 8 * k).bitwiseAND(F.lit(255)), 2) for k in range(n)])


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture, content): records of orders in classic captures, of either byte order and both resolutions."""
    line = table(spark, sf_dir, "lineitem")
    order, n, size = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    capture = order % 40
    kept = F.least(size, F.lit(30))
    fields = [F.lit(1_700_000_000) + order, n * 1000, kept, size]
    big, little = F.concat(*[_hex(x, 8) for x in fields]), F.concat(*[_little(x, 4) for x in fields])
    record = F.concat(F.when(capture % 2 == 0, big).otherwise(little), F.repeat(F.lit("AB"), kept.cast("int")))
    own = F.array_sort(F.collect_list(F.struct(order.alias("o"), n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), record.alias("r"))))
    rows = line.groupBy(capture.alias("capture")).agg(F.array_join(F.transform(own, lambda x: x["r"]), "").alias("records"))
    heads = {0: "A1B2C3D4", 1: "D4C3B2A1", 2: "A1B23C4D", 3: "4D3CB2A1"}
    head = F.lit(None).cast("string")
    for k, magic in heads.items():
        rest = "00020004" + "0" * 16 + "0004000000000001" if k % 2 == 0 else "02000400" + "0" * 16 + "0000040001000000"
        head = F.when(F.col("capture") % 4 == k, F.lit(magic + rest)).otherwise(head)
    return rows.select("capture", F.unhex(F.concat(head, "records")).alias("content"))


def pcap_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classic captures by their contents, all byte orders and resolutions."""
    return pcap.records_of_contents(_captures(spark, sf_dir)).select("source", "sequence", F.col("timestamp_ns").cast("bigint").alias("timestamp_ns"), "captured_len", "original_len", "linktype")


_PCAP_SQL = """WITH l AS (SELECT *, l_orderkey % 40 AS capture, least(l_quantity::BIGINT, 30) AS kept, row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS sequence FROM lineitem),
h AS (SELECT *, printf('%08X%08X%08X%08X', 1700000000 + l_orderkey, l_linenumber * 1000, kept, l_quantity::BIGINT) AS big FROM l),
r AS (SELECT *, CASE WHEN capture % 2 = 0 THEN big ELSE array_to_string(list_transform(range(0, 4), lambda i: big[8*i+7:8*i+8] || big[8*i+5:8*i+6] || big[8*i+3:8*i+4] || big[8*i+1:8*i+2]), '') END || repeat('AB', kept::INT) AS rec FROM h),
c AS (SELECT capture, sha256(unhex(CASE capture % 4 WHEN 0 THEN 'A1B2C3D4' WHEN 1 THEN 'D4C3B2A1' WHEN 2 THEN 'A1B23C4D' ELSE '4D3CB2A1' END
  || CASE WHEN capture % 2 = 0 THEN '00020004' || repeat('0', 16) || '0004000000000001' ELSE '02000400' || repeat('0', 16) || '0000040001000000' END || string_agg(rec, '' ORDER BY sequence))) AS source FROM r GROUP BY capture)
SELECT source, sequence, (1700000000 + l_orderkey) * 1000000000 + l_linenumber * 1000 * CASE WHEN capture % 4 < 2 THEN 1000 ELSE 1 END AS timestamp_ns, kept AS captured_len, l_quantity::BIGINT AS original_len, 1 AS linktype FROM l JOIN c USING (capture)"""


def pcapng_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block captures: a section, two interfaces (microseconds and 2^-10 seconds), enhanced and simple packets."""
    line = table(spark, sf_dir, "lineitem")
    order, n, size = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    pad = (F.lit(4) - size % 4) % 4
    data = F.concat(F.repeat(F.lit("CD"), size), F.repeat(F.lit("00"), pad))
    block = lambda kind, body: F.concat(_hex(F.lit(kind), 8), _hex(F.length(body) / 2 + 12, 8), body, _hex(F.length(body) / 2 + 12, 8))
    ticks = F.lit(1_700_000_000).cast("bigint") * F.when(n % 2 == 0, 1_000_000).otherwise(1024) + order
    enhanced = block(6, F.concat(_hex(n % 2, 8), _hex(ticks, 16), _hex(size, 8), _hex(size, 8), data))
    record = F.when(n % 5 == 0, block(3, F.concat(_hex(size, 8), data))).otherwise(enhanced)
    own = F.array_sort(F.collect_list(F.struct(order.alias("o"), n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), record.alias("r"))))
    rows = line.groupBy((order % 40).alias("capture")).agg(F.array_join(F.transform(own, lambda x: x["r"]), "").alias("records"))
    section = block(0x0A0D0D0A, F.lit("1A2B3C4D00010000FFFFFFFFFFFFFFFF"))
    micro = block(1, F.lit("0001000000000000"))
    binary = block(1, F.lit("0065000000000000" + "000900018A000000" + "00000000"))
    # Interface 1 counts in 2^-10 seconds (option 9, high bit set), interface 0 in microseconds.
    content = F.unhex(F.concat(section, micro, binary, F.col("records")))
    found = pcap.records_of_contents(rows.select("capture", content.alias("content")), ["capture"])
    return found.select("capture", "sequence", "section", "interface", F.col("timestamp_ns").cast("bigint").alias("timestamp_ns"), "captured_len", "linktype")


_PCAPNG_SQL = """SELECT l_orderkey % 40 AS capture, row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS sequence, 0 AS section,
  CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_linenumber % 2 END AS interface,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN (1700000000::HUGEINT * 1000000 + l_orderkey) * 1000 ELSE (1700000000::HUGEINT * 1024 + l_orderkey) * 1000000000 // 1024 END::BIGINT AS timestamp_ns,
  l_quantity::BIGINT AS captured_len, CASE WHEN l_linenumber % 5 <> 0 AND l_linenumber % 2 = 1 THEN 101 ELSE 1 END AS linktype FROM lineitem"""


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a capture held: frames that are IP, that are not, and that are broken."""
    return pcap.summary(decode.decode_records(_frames(spark, sf_dir), keep_bytes=False))


_SUMMARY_SQL = """SELECT count(*) AS records, count(*) FILTER (k = 1) AS ip_packets, count(*) FILTER (k = 0) AS skipped_non_ip, count(*) FILTER (k = 2) AS malformed,
  sum(CASE k WHEN 0 THEN 46 WHEN 1 THEN 42 + l_quantity::BIGINT ELSE 30 END)::BIGINT AS bytes, min(us) AS first_us, max(us) AS last_us FROM (SELECT *, l_partkey % 3 AS k, epoch_us(l_shipdate) AS us FROM lineitem)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged ARP requests, UDP datagrams and broken frames over ``lineitem``, by thirds."""
    line = table(spark, sf_dir, "lineitem")
    order, part, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    arp = F.concat(F.lit(_MACS + "8100"), _hex(order % 4096, 4), F.lit("0806" + "0001080006040001" + "020000000001"), _hex(F.lit(10 << 24) + order % 65536, 8), F.lit("0" * 12), _hex(F.lit(10 << 24) + part % 65536, 8))
    datagram = _ipv4(_udp(F.lit(20000) + order % 10000, F.lit(53) + n, F.repeat(F.lit("ab"), F.col("l_quantity").cast("int"))), 17, _hex(F.lit(10 << 24) + order % 65536, 8), _hex(F.lit(172 << 24) + part % 65536, 8))
    frame = F.when(part % 3 == 0, arp).when(part % 3 == 1, datagram).otherwise(F.substring(datagram, 1, 60))
    return _records(line, frame, order * 10 + n, epoch_us("l_shipdate"))


def link_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are not IP: VLAN tags, addresses and ARP as text."""
    rows = decode.decode_records(_frames(spark, sf_dir), keep_bytes=False)
    shown = packets.filtered(rows, "arp")
    return shown.select("sequence", "kind", "link_proto", "ether_type", "src_mac", "dst_mac", F.element_at("vlans", 1).alias("vlan"), "details", F.array_join("path", ">").alias("path"))


_LINK_SQL = """SELECT l_orderkey * 10 + l_linenumber AS sequence, 'link' AS kind, 'arp' AS link_proto, 2054 AS ether_type, '02:00:00:00:00:01' AS src_mac, '02:00:00:00:00:02' AS dst_mac, (l_orderkey % 4096)::INT AS vlan,
  'who-has 10.0.' || (l_partkey % 65536 // 256) || '.' || (l_partkey % 256) || ' tell 10.0.' || (l_orderkey % 65536 // 256) || '.' || (l_orderkey % 256) AS details, 'ethernet>vlan>arp' AS path FROM lineitem WHERE l_partkey % 3 = 0"""


def _filter(text: str, syntax: str):
    return lambda spark, sf_dir: packets.filtered(decode.decode_records(_frames(spark, sf_dir), keep_bytes=False), text, syntax).select("sequence", "src_ip", "dst_ip", "dst_port")


def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that their bytes already rule out are not decoded."""
    text = "src.ip in 10.0.0.0/17 && (proto == udp || dst.ip == 10.0.0.1) && dst.port != 54"
    records = packets.prefiltered(_frames(spark, sf_dir), text)
    return packets.filtered(decode.decode_records(records, keep_bytes=False), text).select("sequence", "src_ip", "dst_ip", "dst_port", F.lit(True).alias("fewer"))


def capture_filter_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode.decode_records(_frames(spark, sf_dir))
    return packets.filtered(rows, "ip[9] = 17 and udp[2:2] >= 55 and (ip[16] & 0xf0 == 0xA0 or udp[8] == 0xab) and greater 60", "bpf").select("sequence", "src_ip", "dst_ip", "dst_port")


def _filter_sql(where: str) -> str:
    return f"""SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS sequence, '10.0.' || (l_orderkey % 65536 // 256) || '.' || (l_orderkey % 256) AS src_ip, '172.0.' || (l_partkey % 65536 // 256) || '.' || (l_partkey % 256) AS dst_ip,
  (53 + l_linenumber)::INT AS dst_port, 20000 + l_orderkey % 10000 AS src_port, 42 + l_quantity::BIGINT AS size FROM lineitem WHERE l_partkey % 3 = 1) WHERE {where}"""


# Applications


def _client(spark: SparkSession, sf_dir: str, port: int, data: Column) -> DataFrame:
    """Application events of one client stream for each row of ``events``: a SYN, then the data (hex)."""
    e = table(spark, sf_dir, "events")
    sport, client = F.lit(20000) + F.col("event_id") % 20000, _hex(F.lit(10 << 24) + F.floor(F.col("event_id") / 20000), 8)
    rows = None
    for k, flags, seq, part in ((1, 2, 999, F.lit("")), (2, 24, 1000, data)):
        frame = _ipv4(_tcp(sport, F.lit(port), F.lit(seq), flags, part), 6, client, F.lit("0A010002"))
        one = _records(e, frame, F.col("event_id") * 10 + k, F.lit(1_700_000_000_000_000))
        rows = one if rows is None else rows.unionByName(one)
    return reassembly.analyze(decode.decode_records(rows)).withColumn("id", F.floor(F.col("sequence") / 10))


def _scalar(path: str) -> Column:
    return net.json_scalar(F.col("payload"), path)


def tls_hello(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client hellos with a server name and two protocols, in one record each."""
    name = _text(F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".test")))
    size = (F.length(name) / 2).cast("bigint")
    sni = F.concat(F.lit("0000"), _hex(size + 5, 4), _hex(size + 3, 4), F.lit("00"), _hex(size, 4), name)
    alpn = F.lit("0010" + "000E" + "000C" + "02" + "6832" + "08" + "687474702F312E31")
    extensions = F.concat(sni, alpn)
    body = F.concat(F.lit("0303" + "11" * 32 + "00" + "0004" + "13011302" + "0100"), _hex(F.length(extensions) / 2, 4), extensions)
    shake = F.concat(F.lit("01"), _hex(F.length(body) / 2, 6), body)
    found = _client(spark, sf_dir, 443, F.concat(F.lit("160301"), _hex(F.length(shake) / 2, 4), shake))
    return found.select("id", "event_type", _scalar("$.protocol.server_name").alias("server_name"), _scalar("$.protocol.alpn[1]").alias("alpn"), _scalar("$.protocol.ciphers[1]").try_cast("int").alias("cipher"))


_TLS_SQL = "SELECT event_id AS id, 'tls.client_hello' AS event_type, 'h' || user_id || '.test' AS server_name, 'http/1.1' AS alpn, 4866 AS cipher FROM events"


def http_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of requests by their digest."""
    body = F.concat(F.lit("body-"), F.col("event_id").cast("string"))
    post = F.concat(F.lit("POST /p HTTP/1.1\r\nHost: h\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"), body)
    found = _client(spark, sf_dir, 80, _text(post)).where("event_type = 'file.seen'")
    return found.select("id", _scalar("$.protocol.sha256").alias("sha256"), _scalar("$.protocol.size").try_cast("bigint").alias("size"))


_FILE_SQL = "SELECT event_id AS id, sha256('body-' || event_id) AS sha256, length('body-' || event_id)::BIGINT AS size FROM events"


def ssh_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("SSH-2.0-made_"), F.col("user_id").cast("string"), F.lit("\r\n"))
    return _client(spark, sf_dir, 22, _text(text)).select("id", "event_type", _scalar("$.protocol.banner").alias("banner"))


_SSH_SQL = "SELECT event_id AS id, 'ssh.banner' AS event_type, 'SSH-2.0-made_' || user_id AS banner FROM events"


def ip_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS queries in two IP fragments each, the later one first, put together and analyzed."""
    e = table(spark, sf_dir, "events")
    label = F.concat(F.lit("part"), F.col("user_id").cast("string"))
    message = F.concat(F.lit("000701000001000000000000"), _hex(F.length(label), 2), _text(label), F.lit("0474657374" + "00" + "00010001"))
    whole = _udp(F.lit(20000) + F.col("event_id") % 20000, F.lit(53), message)
    src = _hex(F.lit(10 << 24) + F.col("event_id"), 8)
    rows = None
    for k, bits, part in ((1, 2, F.substr(whole, F.lit(33))), (2, 0x2000, F.substr(whole, F.lit(1), F.lit(32)))):
        frame = F.concat(F.lit(_MACS + "08004500"), _hex(F.length(part) / 2 + 20, 4), F.lit(f"0001{bits:04x}40110000"), src, F.lit("0A800002"), part)
        one = _records(e, frame, F.col("event_id") * 10 + k, F.lit(1_700_000_000_000_000))
        rows = one if rows is None else rows.unionByName(one)
    found = reassembly.analyze(decode.decode_records(rows))
    return found.select(F.floor(F.col("sequence") / 10).alias("id"), "event_type", _scalar("$.dns.questions[0].name").alias("qname"), "reassembled", F.size("refs").alias("n_refs"))


_FRAGMENTS_SQL = "SELECT event_id AS id, 'dns.query' AS event_type, 'part' || user_id || '.test.' AS qname, true AS reassembled, 2 AS n_refs FROM events"


def dns_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose labels hold dots, quotes, stars and bytes beyond ASCII."""
    e = table(spark, sf_dir, "events")
    label = F.concat(F.lit("612E622A22FF5F2D"), _text(F.col("user_id").cast("string")))
    message = F.concat(F.lit("000701000001000000000000"), _hex(F.length(label) / 2, 2), label, F.lit("0474657374" + "00" + "00010001"))
    frame = _ipv4(_udp(F.lit(20000) + F.col("event_id") % 20000, F.lit(53), message), 17, F.lit("0A000001"), F.lit("0A000002"))
    found = reassembly.analyze(decode.decode_records(_records(e, frame, F.col("event_id"), epoch_us("ts"))))
    return found.select("sequence", _scalar("$.dns.questions[0].name").alias("qname"))


_ESCAPE_SQL = r"SELECT event_id AS sequence, 'a\046b\042\034\255_-' || user_id || '.test.' AS qname FROM events"

# Exports


def _export(version: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Sessions of an order each; the first datagram brings the template, and every datagram one record."""
        line = table(spark, sf_dir, "lineitem")
        order = F.col("l_orderkey")
        k = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
        line = line.withColumn("k", k)
        fields = "".join(f"{i:04x}{n:04x}" for i, n in ((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4)))
        plain = 0 if version == 9 else 2
        template = f"{plain:04x}{4 + 4 + len(fields) // 2:04x}01000007{fields}"
        record = F.concat(_hex(F.lit(10 << 24) + order % 65536, 8), F.lit("AC000001"), _hex(F.lit(2000) + F.col("k"), 4), F.lit("01BB06"), _hex(F.col("l_extendedprice"), 8), _hex(F.col("l_quantity"), 8))
        sets = F.concat(F.when(F.col("k") == 1, F.lit(template)).otherwise(F.lit("")), F.lit("0100" + "001C"), record, F.lit("000000"))
        if version == 9:
            head = F.concat(F.lit("0009"), _hex(F.when(F.col("k") == 1, 2).otherwise(1), 4), F.lit("000003E8" + "65540000"), _hex(F.col("k"), 8), F.lit("00000001"))
        else:
            head = F.concat(F.lit("000A"), _hex(F.length(sets) / 2 + 16, 4), F.lit("65540000"), _hex(F.col("k") - 1, 8), F.lit("00000001"))
        datagrams = line.select(F.concat(F.lit("e:"), order.cast("string")).alias("exporter"), (F.lit(1_700_000_000) + F.col("k")).cast("bigint").alias("arrival"), F.unhex(F.concat(head, sets)).alias("data"))
        found = netflow.decode_datagrams(datagrams)
        return found.select("exporter", "arrival", "version", "domain", "sequence", "kind", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "code")

    return run


def _export_sql(version: int) -> str:
    return f"""SELECT 'e:' || l_orderkey AS exporter, 1700000000 + k AS arrival, {version} AS version, 1::BIGINT AS domain, {'k' if version == 9 else 'k - 1'} AS sequence, 'flow.export' AS kind,
  '10.0.' || (l_orderkey % 65536 // 256) || '.' || (l_orderkey % 256) AS src_ip, '172.0.0.1' AS dst_ip, (2000 + k)::INT AS src_port, 443 AS dst_port, 6 AS protocol, l_quantity::BIGINT AS packets, floor(l_extendedprice)::BIGINT AS bytes, NULL::VARCHAR AS code
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"""


# Odd values


def json_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look like containers, and containers."""
    k = F.col("c_custkey").cast("string")
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("[2001:db8::"), k, F.lit("]")).alias("host"), F.concat(F.lit(" {"), k).alias("brace"), F.array(k).alias("list"), F.struct(k.alias("x")).alias("object"), F.col("c_custkey").alias("number"), (F.col("c_custkey") % 2 == 0).alias("flag")).alias("protocol")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload"))
    return rows.select("c_custkey", *[net.json_scalar(F.col("payload"), f"$.protocol.{n}").alias(n) for n in ("host", "brace", "list", "object", "number", "flag", "missing")])


_JSON_SQL = """SELECT c_custkey, '[2001:db8::' || c_custkey || ']' AS host, ' {' || c_custkey AS brace, NULL::VARCHAR AS list, NULL::VARCHAR AS object, c_custkey::VARCHAR AS number, (c_custkey % 2 = 0)::VARCHAR AS flag, NULL::VARCHAR AS missing FROM customer"""

#: Text before and after the key of a row, and what the normal form has there; None for no normal form.
_URLS = [
    ("HTTP://Host", ".Test:080/a/../b/./c", "http://host", ".test/b/c"), ("https://h", '.test:0444/x/%2E%2e/y z?q="v"#f', "https://h", ".test:444/y%20z?q=%22v%22"), ("http:\\\\h", ".test\\p\\..\\q", "http://h", ".test/q"),
    ("http://[2001:DB8:0:0:0:0:0:", "]:80", "http://[2001:db8::", "]/"), ("http://user:word@h", ".test/", None, None), ("http://h", ".test/ü?ü'", "http://h", ".test/%C3%BC?%C3%BC%27"), ("ftp://h", "/", None, None),
    (" http:h", ".test?a=1#", "http://h", ".test/?a=1"), ("http://h", ".test:70000/", None, None), ("http://a b", ".test/", None, None), ("https://h", "%2Etest/..", "https://h", ".test/"),
]
_DOMAINS = [("-A", ".Test.", "-a", ".test"), ("x_", "-.TEST..", "x_", "-.test"), ("\u212a", ".test", None, None), ("a..", ".test", None, None), ("a" * 64, ".test", None, None), ("", "", "", "")]


def _by_row(key: Column, cases: list, column: int) -> Column:
    out = F.lit(None).cast("string")
    for i, case in enumerate(cases):
        out = F.when(key % len(cases) == i, F.concat(F.lit(case[column]), (key % 9 + 1).cast("string"), F.lit(case[column + 1]))).otherwise(out)
    return out


def _by_row_sql(key: str, cases: list) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN " + (f"{quoted(c[2])} || ({key} % 9 + 1) || {quoted(c[3])}" if c[2] is not None else "NULL") for i, c in enumerate(cases)) + " END"


def url_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = net.url(_by_row(F.col("o_orderkey"), _URLS, 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", u.alias("normal"))


def domain_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", net.domain(_by_row(F.col("o_orderkey"), _DOMAINS, 0)).alias("normal"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, durations, flags, protocols and addresses as readers see them."""
    e = table(spark, sf_dir, "events")
    ms = F.floor(epoch_us("ts") / 1000).cast("bigint")
    flags = (F.col("event_id") % 256).cast("int")
    return e.select(
        "event_id", net.utc_text(ms).alias("utc"), net.duration_text(F.col("event_id") * 7919).alias("duration"), net.flag_text(flags).alias("flags"), net.protocol_text(F.element_at(F.array(*map(F.lit, (6, 17, 1, 58, 47))), (F.col("event_id") % 5 + 1).cast("int"))).alias("proto"),
        net.mac_text(F.unhex(_hex(F.col("event_id"), 12))).alias("mac"), net.safe_text(F.concat(F.lit("a\té"), F.col("user_id").cast("string"))).alias("safe"), net.ms_of_ns(-F.col("event_id").cast("decimal(38,0)") * 1_000_001).cast("bigint").alias("floor_ms"),
    )


_TEXTS_SQL = """SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') AS utc,
  lpad((d // 3600000)::VARCHAR, greatest(2, length((d // 3600000)::VARCHAR))::INT, '0') || ':' || lpad((d // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((d // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((d % 1000)::VARCHAR, 3, '0') AS duration,
  CASE WHEN f = 0 THEN 'none' ELSE array_to_string(list_filter([CASE WHEN f & 1 <> 0 THEN 'F' END, CASE WHEN f & 2 <> 0 THEN 'S' END, CASE WHEN f & 4 <> 0 THEN 'R' END, CASE WHEN f & 8 <> 0 THEN 'P' END, CASE WHEN f & 16 <> 0 THEN '.' END, CASE WHEN f & 32 <> 0 THEN 'U' END, CASE WHEN f & 64 <> 0 THEN 'E' END, CASE WHEN f & 128 <> 0 THEN 'W' END], lambda x: x IS NOT NULL), '') END AS flags,
  CASE event_id % 5 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' WHEN 3 THEN 'icmpv6' ELSE '47' END AS proto,
  regexp_replace(printf('%012x', event_id), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS mac, 'a..' || user_id AS safe, floor(-event_id::HUGEINT * 1000001 / 1000000)::BIGINT AS floor_ms
FROM (SELECT *, event_id * 7919 AS d, event_id % 256 AS f FROM events)"""

# Notices, evidence, reports


def notice_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as notices of a user's fifth in compressed time: quiet for five seconds, and one a second in all."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    ms = F.floor(epoch_us("ts") / 4_000_000).cast("bigint")
    return enrich.notice_gate(e.select("event_id", (F.col("user_id") % 5).alias("topic"), ms.alias("timestamp_ms")), ["topic"], quiet_ms=5000, per_second=1)


_RATE_SQL = """WITH RECURSIVE n AS (SELECT event_id, user_id % 5 AS topic, epoch_us(ts) // 4000000 AS t, row_number() OVER (ORDER BY epoch_us(ts) // 4000000, event_id) AS k FROM events WHERE event_type = 'error'),
walk AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS topic, NULL::BIGINT AS t, false AS passed, -1::BIGINT AS second, 0 AS used, [-100000, -100000, -100000, -100000, -100000]::BIGINT[] AS last
  UNION ALL
  SELECT k, event_id, topic, t, ok, t // 1000, CASE WHEN second = t // 1000 THEN used ELSE 0 END + ok::INT, CASE WHEN ok THEN list_transform(last, lambda x, i: CASE WHEN i = topic + 1 THEN t ELSE x END) ELSE last END
  FROM (SELECT n.*, w.second, w.used, w.last, n.t - w.last[n.topic + 1] >= 5000 AND (w.second <> n.t // 1000 OR w.used < 1) AS ok FROM walk w JOIN n ON n.k = w.k + 1))
SELECT event_id, topic, t AS timestamp_ms, passed FROM walk WHERE k > 0"""


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of an order's lines, merged; those of the largest are cut."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("event"), F.array(F.col("l_partkey").cast("bigint"), (F.col("l_suppkey") + 1_000_000).cast("bigint")).alias("refs"), (F.col("l_linenumber") < 8).alias("complete"))
    out = line.groupBy("event").agg(*evidence.merged())
    return out.select("event", F.size("refs").alias("n"), F.element_at("refs", -1).alias("last"), "complete")


_MERGE_SQL = """WITH r AS (SELECT DISTINCT l_orderkey % 7 AS event, unnest([l_partkey, l_suppkey + 1000000])::BIGINT AS ref FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ref) AS k, count(*) OVER (PARTITION BY event) AS n FROM r)
SELECT event, least(n, 4096)::INT AS n, ref AS last, n <= 4096 AND (SELECT bool_and(l_linenumber < 8) FROM lineitem) AS complete FROM o WHERE k = least(n, 4096)"""


def stats_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = made_packets(spark, sf_dir)
    return stats.count(p, "syn-ack").unionByName(stats.count(p, "large", F.col("original_len") > 900))


_COUNT_SQL = f"""WITH {PACKETS_SQL}, n AS (SELECT count(*) AS all_packets FROM packets)
SELECT name, count(*) FILTER (hit) AS packets, coalesce(sum(original_len) FILTER (hit), 0)::BIGINT AS bytes, count(*) FILTER (hit) * 100.0::DOUBLE / any_value(all_packets) AS percent_packets
FROM (SELECT 'syn-ack' AS name, coalesce(tcp_flags & 18 = 18, false) AS hit, original_len FROM packets UNION ALL SELECT 'large', original_len > 900, original_len FROM packets), n GROUP BY name"""


def rrsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record sets of made responses: a name, and its addresses in any order and more than once."""
    e = observations(spark, sf_dir).where("event_type = 'view'")
    k = F.conv(F.substring("event_id", 1, 4), 16, 10).cast("bigint")
    answer = lambda x: F.struct(F.concat(F.lit("Name"), (k % 20).cast("string"), F.lit(".Test.")).alias("name"), F.lit(1).alias("class"), F.lit(1).alias("rr_type"), F.concat(F.lit("192.0.2."), x.cast("string")).alias("data"))
    payload = F.to_json(F.struct(F.struct(F.array(answer(9 - k % 5), answer(k % 3), answer(9 - k % 5)).alias("answers")).alias("dns")))
    rows = e.select("event_id", "timestamp_ms", "sensor", F.lit("dns.response").alias("event_type"), payload.alias("payload"))
    return enrich.rrsets(rows).select("event_id", "rrset", F.array_join("values", ",").alias("addresses"))


_RRSETS_SQL = f"""WITH {OBSERVATIONS_SQL}, v AS (SELECT event_id, ('0x' || event_id[1:4])::BIGINT AS k FROM obs WHERE event_type = 'view')
SELECT event_id, 'name' || (k % 20) || '.test.:1:1' AS rrset, array_to_string(list_sort(list_distinct(['192.0.2.' || (9 - k % 5), '192.0.2.' || (k % 3)])), ',') AS addresses FROM v"""


def suppressed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.suppressed(notice_rate(spark, sf_dir))


def module_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a profile's modules, and which these are."""
    on = modules.resolve(("flows", "protocols"), disabled=("ssh",))
    kind = F.element_at(F.array(*map(F.lit, ("ssh.banner", "dns.query", "intel.match", "flow.end"))), (F.col("timestamp_ms") % 4 + 1).cast("int"))
    rows = observations(spark, sf_dir).withColumn("event_type", kind)
    return retention.accepted(rows, set(on)).groupBy("event_type").agg(F.count("*").alias("count")).withColumn("modules", F.lit(",".join(on)))


_GATE_SQL = f"""WITH {OBSERVATIONS_SQL} SELECT ['ssh.banner', 'dns.query', 'intel.match', 'flow.end'][timestamp_ms % 4 + 1] AS event_type, count(*) AS count, 'packet,flow,ip-reassembly,tcp-stream,dns,tls,http' AS modules FROM obs WHERE timestamp_ms % 4 IN (1, 3) GROUP BY ALL"""


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written to a new store in two batches, read back by a query that prunes."""
    import uuid

    from wirelake.functions.tables import shared_dir

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    o = observations(spark, sf_dir)
    store.append(o.where("event_type <> 'click'"), "a" * 64)
    store.append(o.where("event_type = 'click'"), "b" * 64)
    return pipeline.query(store.events(), "event.type == click && src.ip in 10.0.0.0/25 && bytes > 1KB | group src.ip | sort src.ip", result_rows=None)


_STORE_SQL = f"""WITH {OBSERVATIONS_SQL} SELECT src_ip, count(*) AS count, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM obs
WHERE event_type = 'click' AND src_ip LIKE '10.0.0.%' AND split_part(src_ip, '.', 4)::INT < 128 AND bytes > 1024 GROUP BY ALL"""


def hot_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store, and a journal that holds one batch that is in it and one that is not yet."""
    import uuid

    from wirelake.functions.tables import shared_dir
    from wirelake.sources import store as stores

    folder = f"{shared_dir(spark)}/hot-{uuid.uuid4().hex}"
    store = Store(spark, f"{folder}/store")
    o = observations(spark, sf_dir)
    store.append(o.where("event_type = 'view'"), "a" * 64)
    stores.append_hot(o.where("event_type = 'view'"), f"{folder}/hot", "a" * 64)
    stores.append_hot(o.where("event_type in ('click', 'error')"), f"{folder}/hot", "b" * 64)
    hot = stores.hot_journal(spark, f"{folder}/hot")
    both = stores.with_hot(store.events().select("batch", *hot.drop("batch").columns), hot)
    return both.groupBy("batch", "event_type").agg(F.count("*").alias("count"), F.sum("bytes").cast("bigint").alias("bytes"), F.count("dst_ip").alias("with_target"))


_JOURNAL_SQL = f"""WITH {OBSERVATIONS_SQL} SELECT CASE WHEN event_type = 'view' THEN repeat('a', 64) ELSE repeat('b', 64) END AS batch, event_type, count(*) AS count, sum(bytes)::BIGINT AS bytes, count(dst_ip) AS with_target FROM obs WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL"""


def flow_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of several packets, and the one instance that all of these belong to."""
    p = made_packets(spark, sf_dir).select("sequence", F.lit("made").alias("source"), F.floor(F.col("sequence") / 20).alias("first_sequence")).where("sequence % 10 <> 5")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("made").alias("source"), F.array(F.col("o_orderkey") * 10 + 1, F.col("o_orderkey") * 10 + 2, (F.col("o_orderkey") + F.col("o_custkey") % 2) * 10 + 1).alias("refs"))
    return flows.inherit(e, p).select("event_id", "first_sequence")


_ANCHOR_SQL = f"""WITH {PACKETS_SQL}, p AS (SELECT sequence, floor(sequence / 20)::BIGINT AS f FROM packets WHERE sequence % 10 <> 5),
r AS (SELECT o_orderkey AS event_id, unnest([o_orderkey * 10 + 1, o_orderkey * 10 + 2, (o_orderkey + o_custkey % 2) * 10 + 1]) AS sequence FROM orders)
SELECT event_id, CASE WHEN count(DISTINCT f) = 1 AND count(f) = count(*) THEN min(f) END AS first_sequence FROM r LEFT JOIN p USING (sequence) GROUP BY event_id"""


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result as JSON lines, nulls and all."""
    found = pipeline.query(observations(spark, sf_dir), "* | group proto, dst.port | sort proto", result_rows=None)
    return spark.createDataFrame([(x,) for x in output.json_lines(found)], "line string")


_LINES_SQL = f"""WITH {OBSERVATIONS_SQL} SELECT json_object('proto', proto, 'dst_port', dst_port, 'count', count(*), 'packets', sum(packets)::BIGINT, 'bytes', sum(bytes)::BIGINT)::VARCHAR AS line FROM obs GROUP BY proto, dst_port"""


def intel_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains, URLs and digests of applications, through the matcher."""
    pages = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", r"://[^/?#]*(.*)$", 1)
    protocol = F.struct(F.upper(F.regexp_extract("url", "://([^/?#:]*)", 1)).alias("host"), rest.alias("target"), F.sha2(F.col("page_id").cast("string"), 256).alias("sha256"))
    rows = pages.select(F.col("page_id").cast("string").alias("event_id"), F.lit("http.request").alias("event_type"), *[F.lit(None).cast("string").alias(c) for c in ("src_ip", "dst_ip", "proto")], F.to_json(F.struct(protocol.alias("protocol"))).alias("payload"))
    import hashlib

    feed = [("domain", "spam-farm.example.org.", "list-a", "high"), ("domain", "WWW.Cheap-Pills.example.com", "list-a", None), ("sha256", hashlib.sha256(b"7").hexdigest().upper(), "list-b", "info"), ("url", "HTTP://spam-farm.example.org:80/x/../de/3", "list-c", "warning")]
    return enrich.findings(rows, spark.createDataFrame(feed, "kind string, value string, source string, severity string")).select("event_id", "field", "value", F.col("by").alias("source"), "severity")


_FIELD_SQL = """WITH p AS (SELECT page_id::VARCHAR AS event_id, upper(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*(.*)$', 1) AS target FROM pages),
feed(value, severity) AS (VALUES ('spam-farm.example.org', 'high'), ('www.cheap-pills.example.com', 'warning'))
SELECT event_id, 'domain' AS field, host AS value, 'list-a' AS source, severity FROM p JOIN feed ON lower(host) = feed.value
UNION ALL SELECT event_id, 'sha256', sha256(event_id), 'list-b', 'info' FROM p WHERE event_id = '7'
UNION ALL SELECT event_id, 'url', 'http://' || host || target, 'list-c', 'warning' FROM p WHERE lower(host) = 'spam-farm.example.org' AND regexp_extract(target, '^[^#]*') = '/de/3'"""


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of exported flows."""
    from wirelake.plans.wire import netflow_decode

    records = netflow_decode(spark, sf_dir)
    lacking = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ("domain long", "export_time long", "sampling_interval long", "code string", "message string")}
    full = records.withColumns(lacking | {"exporter": F.lit("e:1"), "version": F.lit(5), "fields": F.array().cast("array<struct<enterprise:bigint,id:int,value:binary,scope:boolean>>")})
    return ingest.export_rows(full, "s1").select("event_type", "identity_status", "sensor", "source", "timestamp_ms", "timestamp_ns", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "packets", "bytes")


def counters_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a policy as exposition text, a line each."""
    from wirelake.plans.catalog_operators import PROGRAM

    text = policy.prometheus(policy.effects(observations(spark, sf_dir), policy.parse(PROGRAM)))
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


_COUNTERS_SQL = f"""WITH {OBSERVATIONS_SQL} SELECT 'wirelake_policy_large_purchases_total ' || count(*) AS line FROM obs WHERE event_type = 'purchase' AND bytes >= 10240
UNION ALL SELECT 'wirelake_policy_watched_bytes_total ' || 3 * count(*) FROM obs WHERE src_ip LIKE '10.0.0.%' AND split_part(src_ip, '.', 4)::INT < 8 AND NOT (proto = 'tcp')"""


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs to an observation's flow."""
    import hashlib

    return correlate.related(observations(spark, sf_dir), hashlib.sha256(b"events:1").hexdigest()).select("event_id", "flow_id", "timestamp_ms", "truncated")


_RELATED_SQL = f"""WITH {OBSERVATIONS_SQL} SELECT event_id, flow_id, timestamp_ms, false AS truncated FROM obs WHERE flow_id = (SELECT flow_id FROM obs WHERE event_id = sha256('events:1')) AND flow_id <> '' OR event_id = sha256('events:1')"""

_EXPORT_ROWS_SQL = """SELECT 'flow.export' AS event_type, 'exported' AS identity_status, 's1' AS sensor, 'e:1' AS source, 1700003840000 - 100 AS timestamp_ms, (1700003840000 - 100)::VARCHAR || '000000' AS timestamp_ns, '10.0.' || (l_orderkey % 65536 // 256) || '.' || (l_orderkey % 256) AS src_ip, '172.0.0.1' AS dst_ip,
  (2000 + l_linenumber)::BIGINT AS src_port, 443::BIGINT AS dst_port, 'tcp' AS proto, l_quantity::BIGINT AS packets, floor(l_extendedprice)::BIGINT AS bytes FROM lineitem"""

QUERIES = {
    f.__name__: f
    for f in (
        pcap_read, pcapng_read, ingest_summary, link_frames, tls_hello, http_file, ssh_banner, ip_fragments, dns_escape, json_odd, url_odd, domain_odd, texts, notice_rate, suppressed_notices, evidence_merge, stats_count, rrsets,
        prefilter, capture_filter_bytes, module_gate, store_roundtrip, hot_journal, flow_anchor, json_rows, intel_field, export_rows, counters_text, related,
    )
} | {
    "netflow_v9": _export(9),
    "netflow_ipfix": _export(10),
    "packet_filter": _filter("src.ip in 10.0.0.0/17 && dst.port in [54, 56] && bytes >= 50", "auto"),
    "packet_filter_names": _filter("udp && !(dst port 54)", "auto"),
    "capture_filter": _filter("udp and (dst port 54 or portrange 56-57) and dst net 172.0.0.0/17 and not src host 10.0.0.9", "bpf"),
}

ORACLE = {
    "pcap_read": _PCAP_SQL, "pcapng_read": _PCAPNG_SQL, "ingest_summary": _SUMMARY_SQL, "link_frames": _LINK_SQL, "tls_hello": _TLS_SQL, "http_file": _FILE_SQL, "ssh_banner": _SSH_SQL, "ip_fragments": _FRAGMENTS_SQL, "dns_escape": _ESCAPE_SQL,
    "json_odd": _JSON_SQL, "url_odd": f"SELECT o_orderkey, {_by_row_sql('o_orderkey', _URLS)} AS normal FROM orders", "domain_odd": f"SELECT o_orderkey, {_by_row_sql('o_orderkey', _DOMAINS)} AS normal FROM orders", "texts": _TEXTS_SQL,
    "notice_rate": _RATE_SQL, "suppressed_notices": f"SELECT count(*) AS suppressed FROM ({_RATE_SQL}) WHERE NOT passed HAVING count(*) > 0", "evidence_merge": _MERGE_SQL, "stats_count": _COUNT_SQL, "rrsets": _RRSETS_SQL, "module_gate": _GATE_SQL,
    "store_roundtrip": _STORE_SQL, "hot_journal": _JOURNAL_SQL, "flow_anchor": _ANCHOR_SQL, "json_rows": _LINES_SQL, "intel_field": _FIELD_SQL, "export_rows": _EXPORT_ROWS_SQL, "counters_text": _COUNTERS_SQL, "related": _RELATED_SQL, "netflow_v9": _export_sql(9), "netflow_ipfix": _export_sql(10),
    "packet_filter": f"SELECT sequence, src_ip, dst_ip, dst_port FROM ({_filter_sql('split_part(src_ip, $$.$$, 3)::INT < 128 AND dst_port IN (54, 56) AND size >= 50')})",
    "capture_filter_bytes": f"SELECT sequence, src_ip, dst_ip, dst_port FROM ({_filter_sql('dst_port >= 55 AND size >= 60')})",
    "prefilter": f"SELECT sequence, src_ip, dst_ip, dst_port, true AS fewer FROM ({_filter_sql('split_part(src_ip, $$.$$, 3)::INT < 128 AND dst_port <> 54')})",
    "packet_filter_names": f"SELECT sequence, src_ip, dst_ip, dst_port FROM ({_filter_sql('dst_port <> 54')})",
    "capture_filter": f"SELECT sequence, src_ip, dst_ip, dst_port FROM ({_filter_sql('(dst_port IN (54, 56, 57) OR src_port BETWEEN 56 AND 57) AND split_part(dst_ip, $$.$$, 3)::INT < 128 AND src_ip <> $$10.0.0.9$$')})",
}
