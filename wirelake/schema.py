"""The observation table: one wide, versioned row type."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2
READABLE_VERSIONS = (1, 2)


def _fields(*rows: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in rows])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

OBSERVATION = _fields(
    ("event_id", _S, False),
    ("flow_id", _S, False),
    ("conversation_id", _S, True),
    ("identity_status", _S, True),
    ("sensor", _S, False),
    ("source", _S, False),
    ("timestamp_ns", _S, True),
    ("timestamp_ms", _L, True),
    ("event_type", _S, False),
    ("src_ip", _S, True),
    ("src_port", _L, True),
    ("dst_ip", _S, True),
    ("dst_port", _L, True),
    ("proto", _S, True),
    ("packets", _L, True),
    ("bytes", _L, True),
    ("payload", _S, False),
)
#: Columns that version 1 lacks and reads as null.
SINCE_VERSION_2 = ("conversation_id", "identity_status")
COLUMNS = OBSERVATION.fieldNames()
#: Physical columns that projections of everything must not show.
HIDDEN = ("src_ip_key", "dst_ip_key", "batch", "event", "hour")

HEADER = _fields(("sequence", _L, False), ("section", _I, False), ("interface", _I, False), ("timestamp_ns", T.DecimalType(38, 0), True), ("captured_len", _L, False), ("original_len", _L, False))
RECORD = T.StructType([*HEADER.fields, T.StructField("linktype", _I), T.StructField("source", _S), T.StructField("data", T.BinaryType())])
REFERENCE = _fields(("sequence", _L, False), ("section", _I, False), ("interface", _I, False))

#: The closed vocabulary of stored event types.
EVENT_TYPES = (
    "packet", "flow.end", "flow.export", "export.options", "notice.export", "anomaly.export",
    "dns.query", "dns.response", "anomaly",
    "tls.client_hello", "tls.server_hello", "http.request", "http.response", "ssh.banner", "file.seen",
    "anomaly.decode", "notice.dns_change", "intel.match", "notice.policy", "policy.tag", "policy.metric", "policy.log",
    "policy.summary", "notice.plugin", "anomaly.plugin",
)

#: Virtual columns: path into the payload, and whether the value is numeric.
VIRTUAL = {
    "tls_server_name": ("$.protocol.server_name", False),
    "dns_qname": ("$.dns.questions[0].name", False),
    "http_host": ("$.protocol.host", False),
    "http_method": ("$.protocol.method", False),
    "http_status": ("$.protocol.status", True),
    "file_sha256": ("$.protocol.sha256", False),
    "file_size": ("$.protocol.size", True),
    "anomaly_code": ("$.anomaly.code", False),
}
