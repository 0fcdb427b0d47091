"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wirelake.plans.observations import OBSERVATIONS_SQL, observations
from wirelake.plans.pipeline import query

#: 1 February 2024, 00:00 UTC, as now() of the registered queries.
NOW_MS = 1_706_745_600_000

FLAGSHIP = "event.type == purchase && bytes >= 1KB | group src.ip | sort bytes desc | limit 20"

_ALL = "event_id, flow_id, conversation_id, identity_status, sensor, source, timestamp_ns, timestamp_ms, event_type, src_ip, src_port, dst_ip, dst_port, proto, packets, bytes, payload"
_TOTALS = "count(*) AS count, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes"

#: name -> (query, SQL over obs)
QUERIES: dict[str, tuple[str, str]] = {
    "cql_filter_eq": ("event.type == purchase && src.ip == 10.0.0.3", f"SELECT {_ALL} FROM obs WHERE event_type = 'purchase' AND src_ip = '10.0.0.3'"),
    "cql_filter_neq_null": ("proto != tcp", f"SELECT {_ALL} FROM obs WHERE proto <> 'tcp'"),
    "cql_not_3vl": ("!(dst.port == 443 || proto == udp)", f"SELECT {_ALL} FROM obs WHERE NOT (dst_port = 443 OR proto = 'udp')"),
    "cql_range_units": ("bytes >= 1KB && bytes < 10KB", f"SELECT {_ALL} FROM obs WHERE bytes >= 1024 AND bytes < 10240"),
    "cql_ports_in": ("dst.port in [443, 22, 8080]", f"SELECT {_ALL} FROM obs WHERE dst_port IN (443, 22, 8080)"),
    "cql_cidr": ("src.ip in 10.0.0.0/29 | select event.id, src.ip", "SELECT event_id, src_ip FROM obs WHERE src_ip LIKE '10.0.0.%' AND split_part(src_ip, '.', 4)::INT < 8"),
    "cql_cidr_v6": ("src.ip in 2001:db8::/124 | select event.id, src.ip", "SELECT event_id, src_ip FROM obs WHERE regexp_full_match(src_ip, '2001:db8::[0-9a-f]')"),
    "cql_family": ("!(ip.src == 10.0.0.1) && dst.port != 443 | select event.id, src.ip", "SELECT event_id, src_ip FROM obs WHERE NOT (src_ip NOT LIKE '%:%' AND src_ip = '10.0.0.1') AND dst_port <> 443"),
    "cql_contains": ('payload contains "7" && sensor contains "-1"', f"SELECT {_ALL} FROM obs WHERE contains(payload, '7') AND contains(sensor, '-1')"),
    "cql_starts_with": ("event.id starts_with ab || flow.id starts_with 0", f"SELECT {_ALL} FROM obs WHERE starts_with(event_id, 'ab') OR starts_with(flow_id, '0')"),
    "cql_ends_with": ('event.id ends_with "7f"', f"SELECT {_ALL} FROM obs WHERE ends_with(event_id, '7f')"),
    "cql_time_range": ("time >= now() - 7d && time < now() | select event.id, time", f"SELECT event_id, timestamp_ms FROM obs WHERE timestamp_ms >= {NOW_MS} - 604800000 AND timestamp_ms < {NOW_MS}"),
    "cql_select": ("bytes > 5000 | select dst.port, event.type, bytes", "SELECT dst_port, event_type, bytes FROM obs WHERE bytes > 5000"),
    "cql_group_bare": ("* | group proto, dst.port", f"SELECT proto, dst_port, {_TOTALS} FROM obs GROUP BY ALL"),
    "cql_group_sum": ("* | group proto | sum bytes as total", "SELECT proto, sum(bytes)::BIGINT AS total FROM obs GROUP BY ALL"),
    "cql_group_avg": ("* | group event.type | avg bytes as mean", "SELECT event_type, avg(bytes) AS mean FROM obs GROUP BY ALL"),
    "cql_group_min": ("* | group sensor | min bytes as least", "SELECT sensor, min(bytes) AS least FROM obs GROUP BY ALL"),
    "cql_group_max": ("* | group src.ip | max timestamp as last", "SELECT src_ip, max(timestamp_ms) AS last FROM obs GROUP BY ALL"),
    "cql_sum_global": ("proto == tcp | sum bytes as total", "SELECT sum(bytes)::BIGINT AS total FROM obs WHERE proto = 'tcp'"),
    "cql_count": ("proto == udp | count", "SELECT count(*) AS count FROM obs WHERE proto = 'udp'"),
    "cql_group_count": ("* | group identity.status, sensor | count", "SELECT identity_status, sensor, count(*) AS count FROM obs GROUP BY ALL"),
    "cql_distinct": ("* | distinct src.ip", "SELECT DISTINCT src_ip FROM obs"),
    "cql_top": ("* | top 5 src.ip", "SELECT src_ip, count(*) AS count FROM obs GROUP BY ALL ORDER BY count DESC, src_ip LIMIT 5"),
    "cql_window_count": ("* | window 1h | count", "SELECT (floor(timestamp_ms / 3600000) * 3600000)::BIGINT AS window_start_ms, count(*) AS count FROM obs GROUP BY ALL"),
    "cql_window_group": ("event.type == view | window 24h | group src.ip | sum bytes as total", "SELECT src_ip, (floor(timestamp_ms / 86400000) * 86400000)::BIGINT AS window_start_ms, sum(bytes)::BIGINT AS total FROM obs WHERE event_type = 'view' GROUP BY ALL"),
    "cql_chained": ("* | group src.ip | sum bytes as total | max total as peak", "SELECT max(total) AS peak FROM (SELECT sum(bytes)::BIGINT AS total FROM obs GROUP BY src_ip)"),
    "cql_sort_nulls_last": ("* | group proto | sort proto desc", f"SELECT proto, {_TOTALS} FROM obs GROUP BY ALL ORDER BY proto DESC NULLS LAST"),
    "cql_limit": ("* | group src.ip | sort src.ip | limit 7", f"SELECT src_ip, {_TOTALS} FROM obs GROUP BY ALL ORDER BY src_ip NULLS LAST LIMIT 7"),
    "cql_timeline": ("src.ip == 10.0.0.5 | select time, event.type, bytes | timeline", "SELECT timestamp_ms, event_type, bytes FROM obs WHERE src_ip = '10.0.0.5' ORDER BY timestamp_ms"),
    "cql_flagship": (FLAGSHIP, f"SELECT src_ip, {_TOTALS} FROM obs WHERE event_type = 'purchase' AND bytes >= 1024 GROUP BY ALL ORDER BY bytes DESC NULLS LAST LIMIT 20"),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(observations(spark, sf_dir), text, NOW_MS, None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from wirelake.plans import catalog_operators

    return {name: _query(text) for name, (text, _) in QUERIES.items()} | catalog_operators.QUERIES


def oracle_sql() -> dict[str, str]:
    from wirelake.plans import catalog_operators

    return {name: f"WITH {OBSERVATIONS_SQL} {sql}" for name, (_, sql) in QUERIES.items()} | catalog_operators.ORACLE
