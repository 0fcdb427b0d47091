"""Observations made of the generic test tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(column: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 17 columns over the ``events`` table."""
    e = table(spark, sf_dir, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    us = epoch_us("ts")
    port = F.when(kind == "view", 443).when(kind == "click", 80).when(kind == "purchase", 53).when(kind == "error", 22)
    proto = F.when(kind.isin("view", "click"), "tcp").when(kind == "purchase", "udp")
    v6 = F.concat(F.lit("2001:db8::"), F.lower(F.hex(user + 1)))
    v4 = F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))
    lost = kind == "error"
    return e.select(
        F.sha2(F.concat(F.lit("events:"), F.col("event_id").cast("string")), 256).alias("event_id"),
        F.when(lost, F.lit("")).otherwise(F.sha2(F.concat(F.lit("flow:"), user.cast("string"), F.lit(":"), F.col("event_type")), 256)).alias("flow_id"),
        F.sha2(F.concat(F.lit("conversation:"), user.cast("string")), 256).alias("conversation_id"),
        F.when(lost, F.lit("unassigned")).otherwise(F.lit("instance")).alias("identity_status"),
        F.concat(F.lit("sensor-"), (user % 3).cast("string")).alias("sensor"),
        F.lit("events").alias("source"),
        F.concat(us.cast("string"), F.lit("000")).alias("timestamp_ns"),
        F.floor(us / 1000).cast("bigint").alias("timestamp_ms"),
        kind.alias("event_type"),
        F.when(kind == "signup", v6).otherwise(v4).alias("src_ip"),
        (F.lit(1024) + F.col("event_id") % 50000).cast("bigint").alias("src_port"),
        F.when(kind == "error", F.lit(None)).otherwise(F.concat(F.lit("198.51."), (F.col("event_id") % 7).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string"))).alias("dst_ip"),
        port.cast("bigint").alias("dst_port"),
        proto.alias("proto"),
        F.lit(1).cast("bigint").alias("packets"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
        F.col("props").alias("payload"),
    ).select(*schema.COLUMNS)


#: The same rows in DuckDB.
OBSERVATIONS_SQL = """
obs AS (
  SELECT sha256('events:' || event_id) AS event_id,
    CASE WHEN event_type = 'error' THEN '' ELSE sha256('flow:' || user_id || ':' || event_type) END AS flow_id,
    sha256('conversation:' || user_id) AS conversation_id,
    CASE WHEN event_type = 'error' THEN 'unassigned' ELSE 'instance' END AS identity_status,
    'sensor-' || (user_id % 3) AS sensor, 'events' AS source,
    epoch_us(ts) || '000' AS timestamp_ns, floor(epoch_us(ts) / 1000)::BIGINT AS timestamp_ms, event_type,
    CASE WHEN event_type = 'signup' THEN '2001:db8::' || lower(to_hex(user_id + 1)) ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS src_ip,
    (1024 + event_id % 50000)::BIGINT AS src_port,
    CASE WHEN event_type <> 'error' THEN '198.51.' || (event_id % 7) || '.' || (event_id % 250) END AS dst_ip,
    (CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 53 WHEN 'error' THEN 22 END)::BIGINT AS dst_port,
    CASE WHEN event_type IN ('view', 'click') THEN 'tcp' WHEN event_type = 'purchase' THEN 'udp' END AS proto,
    1::BIGINT AS packets, round(value * 100)::BIGINT AS bytes, props AS payload
  FROM events)
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded packets over ``lineitem``: addresses, ports, flags, layers and lengths, in a capture order."""
    line = table(spark, sf_dir, "lineitem")
    order, part, supp, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    tcp = F.col("l_returnflag") != "N"
    flags = F.when(tcp, F.when(n == 1, 2).when(n == 2, 18).when(n == 6, 17).when(n == 7, 4).otherwise(24))
    dport = F.when(F.col("l_linestatus") == "F", 443).otherwise(53)
    client = F.concat(F.lit("10.1."), (order % 40).cast("string"), F.lit("."), (part % 25).cast("string"))
    server = F.concat(F.lit("192.0.2."), (supp % 50).cast("string"))
    back = n % 2 == 0
    app = F.when(tcp & (dport == 443), "tls").when(~tcp & (dport == 53), "dns")
    path = F.array_compact(F.array(F.lit("ethernet"), F.when(supp % 5 == 0, F.lit("vlan")), F.lit("ipv4"), F.when(tcp, F.lit("tcp")).otherwise(F.lit("udp")), app))
    return line.select(
        (order * 10 + n).alias("sequence"),
        F.when(back, server).otherwise(client).alias("src_ip"),
        F.when(back, client).otherwise(server).alias("dst_ip"),
        F.when(back, dport).otherwise((F.lit(20000) + order % 10000).cast("int")).alias("src_port"),
        F.when(back, (F.lit(20000) + order % 10000).cast("int")).otherwise(dport).alias("dst_port"),
        F.when(tcp, "tcp").otherwise("udp").alias("proto"),
        flags.alias("tcp_flags"),
        (part % 97 == 0).alias("fragmented"),
        path.alias("path"),
        (F.col("l_quantity") * 20 + 40).cast("bigint").alias("original_len"),
        epoch_us("l_shipdate").alias("us"),
    )


PACKETS_SQL = """
packets AS (
  SELECT l_orderkey * 10 + l_linenumber AS sequence,
    CASE WHEN l_linenumber % 2 = 0 THEN server ELSE client END AS src_ip, CASE WHEN l_linenumber % 2 = 0 THEN client ELSE server END AS dst_ip,
    (CASE WHEN l_linenumber % 2 = 0 THEN dport ELSE 20000 + l_orderkey % 10000 END)::INT AS src_port, (CASE WHEN l_linenumber % 2 = 0 THEN 20000 + l_orderkey % 10000 ELSE dport END)::INT AS dst_port,
    CASE WHEN tcp THEN 'tcp' ELSE 'udp' END AS proto,
    CASE WHEN tcp THEN CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 18 WHEN 6 THEN 17 WHEN 7 THEN 4 ELSE 24 END END AS tcp_flags,
    l_partkey % 97 = 0 AS fragmented,
    list_filter(['ethernet', CASE WHEN l_suppkey % 5 = 0 THEN 'vlan' END, 'ipv4', CASE WHEN tcp THEN 'tcp' ELSE 'udp' END, CASE WHEN tcp AND dport = 443 THEN 'tls' WHEN NOT tcp AND dport = 53 THEN 'dns' END], lambda x: x IS NOT NULL) AS path,
    (l_quantity * 20 + 40)::BIGINT AS original_len, epoch_us(l_shipdate) AS us
  FROM (SELECT *, l_returnflag <> 'N' AS tcp, CASE WHEN l_linestatus = 'F' THEN 443 ELSE 53 END AS dport,
    '10.1.' || (l_orderkey % 40) || '.' || (l_partkey % 25) AS client, '192.0.2.' || (l_suppkey % 50) AS server FROM lineitem))
"""
