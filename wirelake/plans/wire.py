"""Frames and datagrams made of the generic test tables, and what the decoders say of them, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions import net
from wirelake.operators.plugins import Registry
from wirelake.plans.observations import epoch_us, observations, table
from wirelake.sources import decode, netflow, reassembly

_MACS = "020000000002020000000001"


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number.cast("bigint")), digits, "0")


def _text(text: Column) -> Column:
    return F.hex(F.encode(text, "utf-8"))


def _ipv4(payload: Column, proto: int, src: Column, dst: Column) -> Column:
    """Hex of an Ethernet frame around hex of a transport payload; addresses as hex."""
    total = (F.length(payload) / 2 + 20).cast("bigint")
    return F.concat(F.lit(_MACS + "08004500"), _hex(total, 4), F.lit(f"0001000040{proto:02x}0000"), src, dst, payload)


def _udp(sport: Column, dport: Column, data: Column) -> Column:
    return F.concat(_hex(sport, 4), _hex(dport, 4), _hex(F.length(data) / 2 + 8, 4), F.lit("0000"), data)


def _tcp(sport: Column, dport: Column, sequence: Column, flags: int, data: Column) -> Column:
    return F.concat(_hex(sport, 4), _hex(dport, 4), _hex(sequence, 8), F.lit(f"0000000050{flags:02x}200000000000"), data)


def _records(rows: DataFrame, frame: Column, sequence: Column, us: Column) -> DataFrame:
    data = F.unhex(frame)
    size = F.octet_length(data).cast("bigint")
    return rows.select(
        sequence.cast("bigint").alias("sequence"), F.lit(0).alias("section"), F.lit(0).alias("interface"), (us.cast("decimal(38,0)") * 1000).cast("decimal(38,0)").alias("timestamp_ns"),
        size.alias("captured_len"), size.alias("original_len"), F.lit(1).alias("linktype"), F.lit("made").alias("source"), data.alias("data"),
    )


def packet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDP frames over ``lineitem``, some cut short, decoded."""
    line = table(spark, sf_dir, "lineitem")
    order, part, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    data = F.repeat(F.lit("ab"), F.col("l_quantity").cast("int"))
    frame = _ipv4(_udp(20000 + order % 10000, F.lit(53) + n, data), 17, _hex(F.lit(10 << 24) + order % 65536, 8), _hex(F.lit(172 << 24) + part % 65536, 8))
    frame = F.when(part % 10 == 0, F.substring(frame, 1, 60)).otherwise(frame)
    rows = decode.decode_records(_records(line, frame, order * 10 + n, epoch_us("l_shipdate")), keep_bytes=False)
    return rows.select("sequence", "kind", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "payload_length", "original_len")


PACKET_DECODE = """SELECT l_orderkey * 10 + l_linenumber AS sequence, CASE WHEN cut THEN 'malformed' ELSE 'packet' END AS kind,
  CASE WHEN NOT cut THEN '10.0.' || (l_orderkey % 65536 // 256) || '.' || (l_orderkey % 256) END AS src_ip, CASE WHEN NOT cut THEN '172.0.' || (l_partkey % 65536 // 256) || '.' || (l_partkey % 256) END AS dst_ip,
  (CASE WHEN NOT cut THEN 20000 + l_orderkey % 10000 END)::INT AS src_port, CASE WHEN NOT cut THEN 53 + l_linenumber END AS dst_port, CASE WHEN NOT cut THEN 'udp' END AS proto,
  CASE WHEN NOT cut THEN l_quantity::INT END AS payload_length, (CASE WHEN cut THEN 30 ELSE 42 + l_quantity::INT END)::BIGINT AS original_len
FROM (SELECT *, l_partkey % 10 = 0 AS cut FROM lineitem)"""


def dns_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS queries over ``events``, one datagram each, analyzed."""
    e = table(spark, sf_dir, "events")
    label = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    name = F.concat(_hex(F.length(label), 2), _text(label), F.lit("04"), _text(F.lit("test")), F.lit("00"))
    message = F.concat(F.lit("00070100000100000000" + "0000"), name, F.lit("00010001"))
    frame = _ipv4(_udp(F.lit(20000) + F.col("event_id") % 20000, F.lit(53), message), 17, F.lit("0A000001"), F.lit("0A000002"))
    rows = decode.decode_records(_records(e, frame, F.col("event_id"), epoch_us("ts")))
    found = reassembly.analyze(rows)
    return found.select("sequence", "event_type", net.json_scalar(F.col("payload"), "$.dns.questions[0].name").alias("qname"), "complete")


DNS_PARSE = "SELECT event_id AS sequence, 'dns.query' AS event_type, 'u' || user_id || '.test.' AS qname, true AS complete FROM events"


def tcp_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP requests over ``events``, each cut in two segments of which the second comes first, and one of them twice."""
    e = table(spark, sf_dir, "events")
    request = F.concat(F.lit("GET /e/"), F.col("event_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: h"), F.col("user_id").cast("string"), F.lit(".test\r\n\r\n"))
    port, client = F.lit(20000) + F.col("event_id") % 20000, _hex(F.lit(10 << 24) + F.floor(F.col("event_id") / 20000), 8)
    parts = [(1, 2, 999, F.lit("")), (2, 24, 1010, F.substr(request, F.lit(11))), (3, 24, 1000, F.substr(request, F.lit(1), F.lit(10))), (4, 24, 1000, F.substr(request, F.lit(1), F.lit(10)))]
    rows = None
    for k, flags, seq, text in parts:
        frame = _ipv4(_tcp(port, F.lit(80), F.lit(seq), flags, _text(text)), 6, client, F.lit("0A010002"))
        one = _records(e, frame, F.col("event_id") * 10 + k, F.lit(1_700_000_000_000_000))
        rows = one if rows is None else rows.unionByName(one)
    found = reassembly.analyze(decode.decode_records(rows))
    return found.select(F.floor(F.col("sequence") / 10).alias("event_id"), "event_type", net.json_scalar(F.col("payload"), "$.protocol.host").alias("host"), net.json_scalar(F.col("payload"), "$.protocol.target").alias("target"), F.size("refs").cast("bigint").alias("n_refs"))


TCP_REASSEMBLY = "SELECT event_id, 'http.request' AS event_type, 'h' || user_id || '.test' AS host, '/e/' || event_id AS target, 3::BIGINT AS n_refs FROM events"


def netflow_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 5 datagrams over ``lineitem``, a record each."""
    line = table(spark, sf_dir, "lineitem")
    order, n = F.col("l_orderkey"), F.col("l_linenumber")
    head = F.concat(F.lit("00050001" + "000003E8" + "65540000" + "00000000"), _hex(order, 8), F.lit("00000000"))
    record = F.concat(_hex(F.lit(10 << 24) + order % 65536, 8), F.lit("AC000001" + "00000000" + "00000000"), _hex(F.col("l_quantity"), 8), _hex(F.col("l_extendedprice"), 8), F.lit("000001F4" + "00000384"), _hex(F.lit(2000) + n, 4), F.lit("01BB" + "0018" + "0600" + "0000000000000000"))
    rows = line.select(F.lit("e:1").alias("exporter"), (order * 10 + n).alias("arrival"), F.unhex(F.concat(head, record)).alias("data"))
    return netflow.decode_v5_datagrams(rows).select("arrival", "kind", "sequence", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "tcp_flags", "start_ms", "end_ms")


NETFLOW_DECODE = """SELECT l_orderkey * 10 + l_linenumber AS arrival, 'flow.export' AS kind, l_orderkey AS sequence, '10.0.' || (l_orderkey % 65536 // 256) || '.' || (l_orderkey % 256) AS src_ip, '172.0.0.1' AS dst_ip,
  2000 + l_linenumber AS src_port, 443 AS dst_port, 6 AS protocol, l_quantity::BIGINT AS packets, floor(l_extendedprice)::BIGINT AS bytes, 24 AS tcp_flags, 1700003840000 - 500 AS start_ms, 1700003840000 - 100 AS end_ms FROM lineitem"""


def plugin_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin that makes one notice of each purchase."""
    registry = Registry()
    registry.register("purchases", ["purchase"], lambda row: [{"spent": row["bytes"]}])
    made = registry.run(observations(spark, sf_dir))
    return made.select("event_type", "conversation_id", "timestamp_ms", "bytes", net.json_scalar(F.col("payload"), "$.spent").cast("bigint").alias("spent"))


PLUGIN = "SELECT 'notice.plugin' AS event_type, conversation_id, timestamp_ms, NULL::BIGINT AS bytes, bytes AS spent FROM obs WHERE event_type = 'purchase'"
