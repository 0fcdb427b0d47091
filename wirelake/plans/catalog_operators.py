"""Registered queries of the operators that are not query-language stages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.functions import net
from wirelake.operators import correlate, enrich, flows, retention, stats
from wirelake.plans import catalog_wire, pipeline, policy, wire
from wirelake.plans.observations import OBSERVATIONS_SQL, PACKETS_SQL, epoch_us, observations, packets, table

FIRST_MS = 1_704_067_200_000  # 1 January 2024


def _report(mode: str, top: int | None = None, by: str = "packets"):
    return lambda spark, sf_dir: stats.report(packets(spark, sf_dir), mode, top, by)


def _report_sql(keys: str, tail: str = "") -> str:
    return f"""WITH {PACKETS_SQL},
keyed AS (SELECT DISTINCT sequence, rid, original_len, unnest({keys}) AS name FROM (SELECT *, row_number() OVER () AS rid FROM packets)),
n AS (SELECT count(*) AS all_packets FROM packets)
SELECT name, count(*) AS packets, sum(original_len)::BIGINT AS bytes, count(*) * 100.0::DOUBLE / any_value(all_packets) AS percent_packets
FROM keyed, n WHERE name IS NOT NULL GROUP BY name {tail}"""


_FLAGS_SQL = f"""WITH {PACKETS_SQL},
tests(name, mask, val) AS (VALUES {", ".join(f"('{n}', {m}, {v})" for n, (m, v) in net.FLAG_TESTS.items())}),
n AS (SELECT count(*) AS all_packets FROM packets)
SELECT name, count(sequence) AS packets, coalesce(sum(original_len), 0)::BIGINT AS bytes, count(sequence) * 100.0::DOUBLE / any_value(all_packets) AS percent_packets
FROM tests LEFT JOIN packets ON tcp_flags & mask = val, n GROUP BY name"""


def flow_sessionize_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.idle_sessions(packets(spark, sf_dir), 30 * 86_400_000_000).select("a_ip", "a_port", "b_ip", "b_port", "proto", "session", "start_us", "end_us", "packets_ab", "packets_ba", "bytes_ab", "bytes_ba", "flags_ab", "flags_ba")


_V4 = "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 + split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"
_KEYED_SQL = f"""
directed AS (SELECT *, ({_V4.format("src_ip")}, src_port) <= ({_V4.format("dst_ip")}, dst_port) AS fwd FROM packets),
keyed AS (SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS a_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS a_port,
  CASE WHEN fwd THEN dst_ip ELSE src_ip END AS b_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS b_port FROM directed)"""
_SIDES_SQL = """count(*) FILTER (fwd) AS packets_ab, count(*) FILTER (NOT fwd) AS packets_ba,
  coalesce(sum(original_len) FILTER (fwd), 0)::BIGINT AS bytes_ab, coalesce(sum(original_len) FILTER (NOT fwd), 0)::BIGINT AS bytes_ba,
  coalesce(bit_or(coalesce(tcp_flags, 0)) FILTER (fwd), 0) AS flags_ab, coalesce(bit_or(coalesce(tcp_flags, 0)) FILTER (NOT fwd), 0) AS flags_ba"""
_IDLE_SQL = f"""WITH {PACKETS_SQL}, {_KEYED_SQL},
cut AS (SELECT *, coalesce(us - max(us) OVER (PARTITION BY a_ip, a_port, b_ip, b_port, proto ORDER BY us, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2592000000000, true)::INT AS new FROM keyed),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY a_ip, a_port, b_ip, b_port, proto ORDER BY us, sequence ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM cut)
SELECT a_ip, a_port, b_ip, b_port, proto, session, min(us) AS start_us, max(us) AS end_us, {_SIDES_SQL}
FROM numbered GROUP BY a_ip, a_port, b_ip, b_port, proto, session"""


def flow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows.with_flow_key(packets(spark, sf_dir))
    out = flows.totals(rows, ["a_ip", "a_port", "b_ip", "b_port", "proto"])
    return out.withColumn("tcp_state", flows.tcp_state())


_TOTALS_SQL = f"""WITH {PACKETS_SQL}, {_KEYED_SQL},
sides AS (SELECT a_ip, a_port, b_ip, b_port, proto, min(us) AS start_us, max(us) AS end_us, {_SIDES_SQL} FROM keyed GROUP BY ALL)
SELECT *, CASE WHEN proto <> 'tcp' THEN NULL WHEN (flags_ab | flags_ba) & 4 <> 0 THEN 'reset' WHEN flags_ab & flags_ba & 1 <> 0 THEN 'closed' WHEN (flags_ab | flags_ba) & 1 <> 0 THEN 'half_closed'
  WHEN flags_ab & flags_ba & 2 <> 0 AND (flags_ab | flags_ba) & 16 <> 0 THEN 'established' WHEN (flags_ab | flags_ba) & 2 <> 0 THEN 'syn_seen' ELSE 'midstream' END AS tcp_state FROM sides"""


_DAY = 86_400_000_000
#: TCP idle, UDP idle and active time of the registered sessions.
_TIMES = 30 * _DAY, 10 * _DAY, 90 * _DAY


def flow_sessionize_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow instances with idle and active timeouts, TCP closes and the watermark of the capture order."""
    return flows.sessionize(packets(spark, sf_dir), flows.Timeouts(*_TIMES)).drop("vlans", "section", "interface", "source")


def _framed(*parts: str) -> str:
    return "sha256(" + " || ".join(f"strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR" for x in parts) + ")"


_ENDED_SQL = "first_sequence, initiator_forward, start_us, end_us, packets_ab, packets_ba, bytes_ab, bytes_ba, flags_ab, flags_ba"
_CLOSE_SQL = "{" + ", ".join(f"'{c}': {{0}}.{c}" for c in _ENDED_SQL.split(", ")) + "}"
_DUE_SQL = f"least({{0}}.end_us + CASE WHEN proto = 'tcp' THEN {_TIMES[0]} ELSE {_TIMES[1]} END, {{0}}.start_us + {_TIMES[2]})"
_WHY_SQL = f"CASE WHEN {{0}}.start_us + {_TIMES[2]} <= {{0}}.end_us + CASE WHEN proto = 'tcp' THEN {_TIMES[0]} ELSE {_TIMES[1]} END THEN 'active_timeout' ELSE 'idle_timeout' END"
#: Each key's packets one after another, all keys at once: a step takes the open flow and one packet.
_ACTIVE_SQL = f"""WITH RECURSIVE {PACKETS_SQL}, {_KEYED_SQL},
marked AS (SELECT *, max(us) OVER (ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS wm FROM keyed),
p AS (SELECT *, coalesce(tcp_flags, 0) AS f, row_number() OVER (PARTITION BY a_ip, a_port, b_ip, b_port, proto ORDER BY sequence) AS k FROM marked WHERE NOT fragmented),
walk AS (
  SELECT DISTINCT a_ip, a_port, b_ip, b_port, proto, 0::BIGINT AS k, NULL::STRUCT(first_sequence BIGINT, initiator_forward BOOLEAN, start_us BIGINT, end_us BIGINT, packets_ab BIGINT, packets_ba BIGINT, bytes_ab BIGINT, bytes_ba BIGINT, flags_ab INTEGER, flags_ba INTEGER) AS open,
    NULL::STRUCT(first_sequence BIGINT, initiator_forward BOOLEAN, start_us BIGINT, end_us BIGINT, packets_ab BIGINT, packets_ba BIGINT, bytes_ab BIGINT, bytes_ba BIGINT, flags_ab INTEGER, flags_ba INTEGER) AS before, NULL::VARCHAR AS before_why,
    NULL::STRUCT(first_sequence BIGINT, initiator_forward BOOLEAN, start_us BIGINT, end_us BIGINT, packets_ab BIGINT, packets_ba BIGINT, bytes_ab BIGINT, bytes_ba BIGINT, flags_ab INTEGER, flags_ba INTEGER) AS after, NULL::VARCHAR AS after_why FROM p
  UNION ALL
  SELECT a_ip, a_port, b_ip, b_port, proto, k, CASE WHEN why IS NULL THEN now END, CASE WHEN late THEN open END, CASE WHEN late THEN {_WHY_SQL.format("open")} END, CASE WHEN why IS NOT NULL THEN now END, why
  FROM (
    SELECT *, CASE WHEN proto = 'tcp' AND f & 4 <> 0 THEN 'tcp_reset' WHEN proto = 'tcp' AND now.flags_ab & now.flags_ba & 1 <> 0 THEN 'tcp_fin' WHEN {_DUE_SQL.format("now")} <= wm THEN {_WHY_SQL.format("now")} END AS why
    FROM (
      SELECT *, {{'first_sequence': coalesce(own.first_sequence, sequence), 'initiator_forward': coalesce(own.initiator_forward, fwd), 'start_us': least(coalesce(own.start_us, us), us), 'end_us': greatest(coalesce(own.end_us, us), us),
        'packets_ab': coalesce(own.packets_ab, 0) + fwd::INT, 'packets_ba': coalesce(own.packets_ba, 0) + (NOT fwd)::INT, 'bytes_ab': coalesce(own.bytes_ab, 0) + CASE WHEN fwd THEN original_len ELSE 0 END, 'bytes_ba': coalesce(own.bytes_ba, 0) + CASE WHEN fwd THEN 0 ELSE original_len END,
        'flags_ab': coalesce(own.flags_ab, 0) | CASE WHEN fwd THEN f ELSE 0 END, 'flags_ba': coalesce(own.flags_ba, 0) | CASE WHEN fwd THEN 0 ELSE f END}} AS now
      FROM (
        SELECT *, CASE WHEN NOT late THEN open END AS own
        FROM (SELECT p.*, w.open, coalesce({_DUE_SQL.format("w.open").replace("proto", "p.proto")} <= p.wm, false) AS late FROM walk w JOIN p ON w.a_ip = p.a_ip AND w.a_port = p.a_port AND w.b_ip = p.b_ip AND w.b_port = p.b_port AND w.proto = p.proto AND p.k = w.k + 1))))),
ended AS (
  SELECT a_ip, a_port, b_ip, b_port, proto, before AS flow, before_why AS end_reason FROM walk WHERE before_why IS NOT NULL
  UNION ALL SELECT a_ip, a_port, b_ip, b_port, proto, after, after_why FROM walk WHERE after_why IS NOT NULL
  UNION ALL SELECT a_ip, a_port, b_ip, b_port, proto, open, CASE WHEN {_DUE_SQL.format("open")} <= (SELECT max(us) FROM packets) THEN {_WHY_SQL.format("open")} ELSE 'eof' END
    FROM (SELECT *, row_number() OVER (PARTITION BY a_ip, a_port, b_ip, b_port, proto ORDER BY k DESC) AS last FROM walk) WHERE last = 1 AND open IS NOT NULL),
named AS (SELECT a_ip, a_port, b_ip, b_port, proto, {", ".join(f"flow.{c} AS {c}" for c in _ENDED_SQL.split(", "))}, end_reason, {_framed("''", "a_ip", "a_port", "b_ip", "b_port", "proto", "0", "0", "''")} AS conversation_id FROM ended)
SELECT *, CASE WHEN proto <> 'tcp' THEN NULL WHEN (flags_ab | flags_ba) & 4 <> 0 THEN 'reset' WHEN flags_ab & flags_ba & 1 <> 0 THEN 'closed' WHEN (flags_ab | flags_ba) & 1 <> 0 THEN 'half_closed'
  WHEN flags_ab & flags_ba & 2 <> 0 AND (flags_ab | flags_ba) & 16 <> 0 THEN 'established' WHEN (flags_ab | flags_ba) & 2 <> 0 THEN 'syn_seen' ELSE 'midstream' END AS tcp_state,
  {_framed("'instance'", "conversation_id", "first_sequence")} AS flow_id FROM named"""


def intel_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of observations that a feed names, through the matcher."""
    feed = spark.createDataFrame([("ip", "10.0.0.1", "list-a", "high"), ("ip", "2001:DB8:0::3", "list-a", None), ("ip", "198.51.3.3", "list-b", "info"), ("ip", "10.0.0.1", "list-b", "info")], "kind string, value string, source string, severity string")
    return enrich.findings(observations(spark, sf_dir), feed).select("event_id", "field", "value", F.col("by").alias("source"), "severity")


_EXACT_SQL = f"""WITH {OBSERVATIONS_SQL}, feed(value, source, severity) AS (VALUES ('10.0.0.1', 'list-a', 'high'), ('2001:db8::3', 'list-a', 'warning'), ('198.51.3.3', 'list-b', 'info'), ('10.0.0.1', 'list-b', 'info')),
ips AS (SELECT event_id, 'src.ip' AS field, src_ip AS value FROM obs UNION ALL SELECT event_id, 'dst.ip', dst_ip FROM obs)
SELECT event_id, field, value, source, severity FROM ips JOIN feed USING (value)"""


def intel_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.createDataFrame([("cidr", "10.0.0.0/30", "net-a", "high"), ("cidr", "198.51.3.0/24", "net-b", "info"), ("cidr", "2001:db8::/125", "net-c", "warning")], "kind string, value string, source string, severity string")
    return enrich.findings(observations(spark, sf_dir), feed).select("event_id", "field", "value", F.col("by").alias("source"), "severity")


_CIDR_SQL = f"""WITH {OBSERVATIONS_SQL},
ips AS (SELECT event_id, 'src.ip' AS field, src_ip AS value FROM obs UNION ALL SELECT event_id, 'dst.ip', dst_ip FROM obs WHERE dst_ip IS NOT NULL)
SELECT event_id, field, value, 'net-a' AS source, 'high' AS severity FROM ips WHERE value IN ('10.0.0.0', '10.0.0.1', '10.0.0.2', '10.0.0.3')
UNION ALL SELECT event_id, field, value, 'net-b', 'info' FROM ips WHERE starts_with(value, '198.51.3.')
UNION ALL SELECT event_id, field, value, 'net-c', 'warning' FROM ips WHERE regexp_full_match(value, '2001:db8::[0-7]')"""


def intel_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("udp-purchase", "purchase", "proto", "udp", "udp", "warning"), ("any-host", "*", "src.ip", "10.0.0.9", "host", "high")], "id string, event_type string, field string, equals string, message string, severity string")
    return enrich.findings(observations(spark, sf_dir), None, rules).select("event_id", F.col("by").alias("rule"), "field", "value", "severity")


_RULE_SQL = f"""WITH {OBSERVATIONS_SQL}
SELECT event_id, 'udp-purchase' AS rule, 'proto' AS field, 'udp' AS value, 'warning' AS severity FROM obs WHERE event_type = 'purchase' AND proto = 'udp'
UNION ALL SELECT event_id, 'any-host', 'src.ip', src_ip, 'high' FROM obs WHERE src_ip = '10.0.0.9'"""


def corr_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views before a purchase of the same user within ten hours: the shape of the correlation join, status by candidates."""
    o = observations(spark, sf_dir)
    buys = o.where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "conversation_id", F.col("timestamp_ms").alias("at"))
    views = o.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "conversation_id", F.col("timestamp_ms").alias("seen"))
    on = (buys["conversation_id"] == views["conversation_id"]) & (F.col("at") - F.col("seen")).between(0, 36_000_000)
    n = F.count("view_id").over(W.partitionBy("buy_id"))
    return buys.join(views, on, "left").select("buy_id", "view_id", (F.col("at") - F.col("seen")).alias("delta_ms"), n.alias("candidates")).withColumn("status", F.when(F.col("candidates") == 0, "unmatched").when(F.col("candidates") == 1, "inferred").otherwise("ambiguous"))


_CORR_SQL = f"""WITH {OBSERVATIONS_SQL},
joined AS (SELECT b.event_id AS buy_id, v.event_id AS view_id, b.timestamp_ms - v.timestamp_ms AS delta_ms FROM obs b LEFT JOIN obs v
  ON v.event_type = 'view' AND b.conversation_id = v.conversation_id AND b.timestamp_ms - v.timestamp_ms BETWEEN 0 AND 36000000 WHERE b.event_type = 'purchase')
SELECT *, count(view_id) OVER (PARTITION BY buy_id) AS candidates, CASE count(view_id) OVER (PARTITION BY buy_id) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'inferred' ELSE 'ambiguous' END AS status FROM joined"""

DNS_TLS_CNAMES = 3


def _dns_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS responses over views and client hellos over purchases, a name a user's tenth, aliases for some."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    user, dns = F.col("user_id"), F.col("event_type") == "view"
    host = F.concat(F.lit("Host"), (user % 10).cast("string"), F.lit(".Example.test."))
    client, server = F.concat(F.lit("10.9.0."), (user % 100).cast("string")), F.concat(F.lit("198.51.100."), (user % 10).cast("string"))
    packet = F.struct(F.struct(F.lit(0).alias("section"), F.lit(0).alias("interface")).alias("header"), F.array().cast("array<int>").alias("vlans"))
    aliased = user % DNS_TLS_CNAMES == 0
    edge = F.concat(F.lit("edge"), (user % 10).cast("string"), F.lit(".cdn.test"))
    rec = lambda name, kind, ttl, tag, value: F.struct(name.alias("name"), F.lit(1).alias("class"), F.lit(kind).alias("rr_type"), ttl.cast("bigint").alias("ttl"), F.struct(F.lit(tag).alias("type"), value.alias("value")).alias("data"))
    ttl = (F.lit(600) + F.col("event_id") % 20 * 3000).cast("bigint")
    answers = F.when(aliased, F.array(rec(host, 5, F.lit(7200), "cname", edge), rec(edge, 1, ttl, "a", server))).otherwise(F.array(rec(host, 1, ttl, "a", server)))
    question = F.array(F.struct(host.alias("name"), F.lit(1).alias("class")))
    message = F.struct(F.lit(0).alias("rcode"), F.lit(False).alias("truncated"), F.lit(True).alias("response"), question.alias("questions"), answers.alias("answers"))
    payload = F.when(dns, F.to_json(F.struct(packet.alias("packet"), message.alias("dns")))).otherwise(F.to_json(F.struct(packet.alias("packet"), F.struct(F.lower(host).alias("server_name")).alias("protocol"))))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("flow-"), F.col("event_id").cast("string")).alias("flow_id"),
        F.lit("instance").alias("identity_status"),
        F.lit("s").alias("sensor"),
        F.lit("c").alias("source"),
        F.concat(epoch_us("ts").cast("string"), F.lit("000")).alias("timestamp_ns"),
        F.floor(epoch_us("ts") / 1000).cast("bigint").alias("timestamp_ms"),
        F.when(dns, "dns.response").otherwise("tls.client_hello").alias("event_type"),
        F.when(dns, F.lit("192.0.2.53")).otherwise(client).alias("src_ip"),
        F.when(dns, client).otherwise(server).alias("dst_ip"),
        payload.alias("payload"),
    )


def corr_dns_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlate.relate(_dns_tls(spark, sf_dir), 3600)
    return out.select("status", "candidate_count", "tls_event_id", "dns_event_id", "delta_ns", "dns_ttl_seconds", F.array_join("dns_name_chain", ">").alias("chain"))


_DNS_SQL = f"""WITH ev AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS us FROM events),
d AS (SELECT event_id::VARCHAR AS dns_event_id, user_id, us AS at, least(600 + event_id % 20 * 3000, CASE WHEN user_id % {DNS_TLS_CNAMES} = 0 THEN 7200 ELSE 1000000 END)::BIGINT AS dns_ttl_seconds,
  'host' || (user_id % 10) || '.example.test' || CASE WHEN user_id % {DNS_TLS_CNAMES} = 0 THEN '>edge' || (user_id % 10) || '.cdn.test' ELSE '' END AS chain FROM ev WHERE event_type = 'view'),
t AS (SELECT event_id::VARCHAR AS tls_event_id, user_id, us AS at FROM ev WHERE event_type = 'purchase'),
j AS (SELECT tls_event_id, dns_event_id, ((t.at - d.at) * 1000)::VARCHAR AS delta_ns, dns_ttl_seconds, chain FROM t LEFT JOIN d
  ON t.user_id % 10 = d.user_id % 10 AND t.user_id % 100 = d.user_id % 100 AND t.at - d.at BETWEEN 0 AND 3600000000 AND t.at - d.at < dns_ttl_seconds * 1000000)
SELECT *, count(dns_event_id) OVER (PARTITION BY tls_event_id) AS candidate_count,
  CASE count(dns_event_id) OVER (PARTITION BY tls_event_id) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'inferred' ELSE 'ambiguous' END AS status FROM j"""


def notice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as notices of a sensor, quiet for ten minutes."""
    rows = observations(spark, sf_dir).where("event_type = 'error'").select("event_id", "sensor", "timestamp_ms")
    return enrich.notice_gate(rows, ["sensor"], quiet_ms=600_000, per_second=100)


_DEDUP_SQL = f"""WITH RECURSIVE {OBSERVATIONS_SQL},
n AS (SELECT event_id, sensor, timestamp_ms, row_number() OVER (PARTITION BY sensor ORDER BY timestamp_ms, event_id) AS k FROM obs WHERE event_type = 'error'),
walk AS (SELECT event_id, sensor, timestamp_ms, k, timestamp_ms AS last, true AS passed FROM n WHERE k = 1
  UNION ALL SELECT n.event_id, n.sensor, n.timestamp_ms, n.k, CASE WHEN n.timestamp_ms - w.last >= 600000 THEN n.timestamp_ms ELSE w.last END, n.timestamp_ms - w.last >= 600000
  FROM walk w JOIN n ON n.sensor = w.sensor AND n.k = w.k + 1)
SELECT event_id, sensor, timestamp_ms, passed FROM walk"""


def change_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a user's protocol between successive observations."""
    rows = observations(spark, sf_dir).where("proto is not null").select("conversation_id", "timestamp_ms", "event_id", "proto")
    return enrich.changes(rows, ["conversation_id"], "proto", ["timestamp_ms", "event_id"])


_CHANGE_SQL = f"""WITH {OBSERVATIONS_SQL},
l AS (SELECT conversation_id, timestamp_ms, event_id, proto, lag(proto) OVER (PARTITION BY conversation_id ORDER BY timestamp_ms, event_id) AS previous FROM obs WHERE proto IS NOT NULL)
SELECT * FROM l WHERE previous <> proto"""

PROGRAM = """
rule large-purchase version "1" on purchase where bytes >= 10KB {
  notice(severity: high, message: "A large purchase; look");
  metric(name: "large_purchases", value: 1);
}
on * where src.ip in 10.0.0.0/29 && !(proto == tcp) {
  tag("watched");
  metric(name: watched_bytes, value: 3);
  log(level: info, message: "seen");
}
"""


def policy_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.effects(observations(spark, sf_dir), policy.parse(PROGRAM))
    return found.select("event_id", "effect", "rule_id", "action_index", "label", "text", "increment")


_LOW = "src_ip LIKE '10.0.0.%' AND split_part(src_ip, '.', 4)::INT < 8 AND NOT (proto = 'tcp')"
_EFFECTS_SQL = f"""WITH {OBSERVATIONS_SQL}
SELECT event_id, 'notice.policy' AS effect, 'large-purchase' AS rule_id, 0 AS action_index, 'high' AS label, 'A large purchase; look' AS text, NULL::BIGINT AS increment FROM obs WHERE event_type = 'purchase' AND bytes >= 10240
UNION ALL SELECT event_id, 'policy.metric', 'large-purchase', 1, 'large_purchases', NULL, 1 FROM obs WHERE event_type = 'purchase' AND bytes >= 10240
UNION ALL SELECT event_id, 'policy.tag', 'rule-2', 0, 'watched', 'true', NULL FROM obs WHERE {_LOW}
UNION ALL SELECT event_id, 'policy.metric', 'rule-2', 1, 'watched_bytes', NULL, 3 FROM obs WHERE {_LOW}
UNION ALL SELECT event_id, 'policy.log', 'rule-2', 2, 'info', 'seen', NULL FROM obs WHERE {_LOW}"""


def policy_metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.effects(observations(spark, sf_dir), policy.parse(PROGRAM))
    return policy.metric_totals(found).select("event_id", "label", "increment", "total")


_METRIC_SQL = f"""WITH {OBSERVATIONS_SQL},
m AS (SELECT event_id, timestamp_ms, 'large_purchases' AS label, 1::BIGINT AS increment FROM obs WHERE event_type = 'purchase' AND bytes >= 10240
  UNION ALL SELECT event_id, timestamp_ms, 'watched_bytes', 3 FROM obs WHERE {_LOW})
SELECT event_id, label, increment, sum(increment) OVER (PARTITION BY label ORDER BY timestamp_ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM m"""


def json_virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path functions over payloads: text, number, and null for what is no scalar."""
    o = observations(spark, sf_dir)
    return o.select("event_id", net.json_scalar(F.col("payload"), "$.k").alias("k_text"), net.json_scalar(F.col("payload"), "$.k").try_cast("bigint").alias("k_number"), net.json_scalar(F.col("payload"), "$").alias("whole"))


_JSON_SQL = f"WITH {OBSERVATIONS_SQL} SELECT event_id, json_extract_string(payload, '$.k') AS k_text, try_cast(json_extract_string(payload, '$.k') AS BIGINT) AS k_number, NULL::VARCHAR AS whole FROM obs"


def retention_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") == "error", F.lit("anomaly.decode")).otherwise(F.col("event_type")))
    return retention.retained(o, FIRST_MS + 20 * 86_400_000, FIRST_MS + 5 * 86_400_000).select("event_id", "event_type", "timestamp_ms")


_RETENTION_SQL = f"""WITH {OBSERVATIONS_SQL}, o AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'anomaly.decode' ELSE event_type END AS event_type, timestamp_ms FROM obs)
SELECT * FROM o WHERE timestamp_ms IS NULL OR timestamp_ms >= CASE WHEN event_type = 'anomaly.decode' THEN {FIRST_MS} + 432000000 ELSE {FIRST_MS} + 1728000000 END"""


def union_hot_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed rows and the hot rows whose batch is not committed."""
    from wirelake.sources.store import with_hot

    o = observations(spark, sf_dir).withColumn("batch", F.floor(F.col("timestamp_ms") / 86_400_000).cast("string"))
    committed = o.where(F.col("timestamp_ms") < FIRST_MS + 20 * 86_400_000)
    hot = o.where(F.col("timestamp_ms") >= FIRST_MS + 15 * 86_400_000)
    return with_hot(committed, hot, "batch").groupBy("event_type").agg(F.count("*").alias("count"), F.sum("bytes").cast("bigint").alias("bytes"))


_HOT_SQL = f"""WITH {OBSERVATIONS_SQL}, o AS (SELECT *, floor(timestamp_ms / 86400000) AS batch FROM obs),
c AS (SELECT * FROM o WHERE timestamp_ms < {FIRST_MS} + 1728000000), h AS (SELECT * FROM o WHERE timestamp_ms >= {FIRST_MS} + 1296000000)
SELECT event_type, count(*) AS count, sum(bytes)::BIGINT AS bytes FROM (SELECT * FROM c UNION ALL SELECT * FROM h WHERE batch NOT IN (SELECT batch FROM c)) GROUP BY ALL"""


def netflow_seq_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the exporters' sequence numbers: an order is a session, a line a datagram with quantity records."""
    from wirelake.sources.netflow import sequence_gaps

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").cast("bigint").alias("arrival"), (F.col("l_partkey") % 50).cast("bigint").alias("sequence"), F.col("l_quantity").cast("bigint").alias("records"))
    return sequence_gaps(rows, ["session"])


_GAP_SQL = """WITH r AS (SELECT l_orderkey AS session, l_linenumber::BIGINT AS arrival, (l_partkey % 50)::BIGINT AS sequence, l_quantity::BIGINT AS records FROM lineitem),
e AS (SELECT *, lag(sequence + records) OVER (PARTITION BY session ORDER BY arrival, sequence, records) AS expected FROM r)
SELECT session, arrival, sequence, records, expected, sequence - expected AS gap FROM e WHERE expected IS NOT NULL AND expected <> sequence"""


def trace_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    return correlate.trace(observations(spark, sf_dir), hashlib.sha256(b"flow:1:view").hexdigest()).select("event_id", "timestamp_ms", "event_type")


_TRACE_SQL = f"WITH {OBSERVATIONS_SQL} SELECT event_id, timestamp_ms, event_type FROM obs WHERE flow_id = sha256('flow:1:view') ORDER BY timestamp_ms"


def url_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = net.url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("normal"), net.domain(net.host_of(u)).alias("host"))


_URL_SQL = """SELECT page_id, regexp_replace(url, '#.*$', '') AS normal, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages"""


def flow_end_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that sees ended flows only, whatever it asks."""
    o = observations(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") == "view", F.lit("flow.end")).otherwise(F.col("event_type")))
    return pipeline.flows(o, "bytes > 1KB | group proto, src.ip | sort bytes desc | limit 50", result_rows=None)


_SCOPE_SQL = f"""WITH {OBSERVATIONS_SQL} SELECT proto, src_ip, count(*) AS count, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM obs WHERE event_type = 'view' AND bytes > 1024 GROUP BY ALL ORDER BY bytes DESC LIMIT 50"""


QUERIES = {
    "stats_summary": _report("summary"),
    "stats_hierarchy": _report("hierarchy"),
    "stats_protocols": _report("protocols"),
    "stats_flags": _report("flags"),
    "stats_talkers": _report("top-talkers", 10),
    "stats_endpoints": _report("endpoints", 10, "bytes"),
    "stats_conversations": _report("conversations", 10),
    "stats_ports": _report("ports", 10),
} | {
    f.__name__: f
    for f in (
        flow_sessionize_idle, flow_totals, flow_sessionize_active, intel_exact, intel_cidr, intel_rule, corr_interval, corr_dns_tls, notice_dedup, change_notice,
        policy_effects, policy_metric_totals, json_virtual, retention_classes, union_hot_tail, netflow_seq_gap, trace_flow, url_normal, flow_end_scope,
        wire.packet_decode, wire.dns_parse, wire.tcp_reassembly, wire.netflow_decode, wire.plugin_udtf,
    )
} | catalog_wire.QUERIES

ORACLE = {
    "stats_summary": _report_sql("list_concat(['all matched packets'], CASE WHEN fragmented THEN ['ip fragments'] ELSE [] END, path[2:])"),
    "stats_hierarchy": _report_sql("list_transform(range(1, len(path) + 1), lambda n: array_to_string(path[1:n], ' > '))"),
    "stats_protocols": _report_sql("path[2:]"),
    "stats_flags": _FLAGS_SQL,
    "stats_talkers": _report_sql("[src_ip]", "ORDER BY packets DESC, name LIMIT 10"),
    "stats_endpoints": _report_sql("[src_ip, dst_ip]", "ORDER BY bytes DESC, name LIMIT 10"),
    "stats_conversations": _report_sql("[least(src_ip, dst_ip) || ' <-> ' || greatest(src_ip, dst_ip)]", "ORDER BY packets DESC, name LIMIT 10"),
    "stats_ports": _report_sql("[proto || '/' || dst_port]", "ORDER BY packets DESC, name LIMIT 10"),
    "flow_sessionize_idle": _IDLE_SQL,
    "flow_totals": _TOTALS_SQL,
    "flow_sessionize_active": _ACTIVE_SQL,
    "intel_exact": _EXACT_SQL,
    "intel_cidr": _CIDR_SQL,
    "intel_rule": _RULE_SQL,
    "corr_interval": _CORR_SQL,
    "corr_dns_tls": _DNS_SQL,
    "notice_dedup": _DEDUP_SQL,
    "change_notice": _CHANGE_SQL,
    "policy_effects": _EFFECTS_SQL,
    "policy_metric_totals": _METRIC_SQL,
    "json_virtual": _JSON_SQL,
    "retention_classes": _RETENTION_SQL,
    "union_hot_tail": _HOT_SQL,
    "netflow_seq_gap": _GAP_SQL,
    "trace_flow": _TRACE_SQL,
    "url_normal": _URL_SQL,
    "flow_end_scope": _SCOPE_SQL,
    "packet_decode": wire.PACKET_DECODE,
    "dns_parse": wire.DNS_PARSE,
    "tcp_reassembly": wire.TCP_REASSEMBLY,
    "netflow_decode": wire.NETFLOW_DECODE,
    "plugin_udtf": f"WITH {OBSERVATIONS_SQL} {wire.PLUGIN}",
} | catalog_wire.ORACLE
