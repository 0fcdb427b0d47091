"""From decoded captures and flow exports to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake import schema
from wirelake.functions import net
from wirelake.operators import flows
from wirelake.sources import decode, reassembly

def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _row(df: DataFrame, sensor: str, stage: str, ident: list[Column], cells: dict[str, Column]) -> DataFrame:
    """Observations of ``df``: what ``cells`` does not say is null; ids follow from the source, the stage and ``ident``."""
    base = {
        "event_id": net.identity(F.lit(sensor), F.col("source"), F.lit(stage), *ident),
        "flow_id": F.lit(""),
        "identity_status": F.lit("unassigned"),
        "sensor": F.lit(sensor),
        "source": F.col("source"),
    } | cells
    return df.select(*[base.get(f.name, _null(f.dataType.simpleString())).cast(f.dataType).alias(f.name) for f in schema.OBSERVATION.fields])


def _header() -> Column:
    return F.struct("sequence", "section", "interface", F.col("timestamp_ns").cast("string").alias("timestamp_ns"), "captured_len", "original_len")


def packet_rows(packets: DataFrame, sensor: str) -> DataFrame:
    """``packet`` rows; those of flows carry their instance, if ``packets`` has first_sequence."""
    has = "first_sequence" in packets.columns
    known = F.col("first_sequence").isNotNull() if has else F.lit(False)
    keyed = flows.with_flow_key(packets).withColumn("_conversation", flows.conversation_id())
    payload = F.to_json(F.struct(F.struct(_header().alias("header"), "vlans", "tcp_flags", "icmp_type", "icmp_code", "fragmented", "app").alias("packet")))
    first = F.col("first_sequence").cast("string") if has else _null("string")
    cells = {
        "flow_id": F.when(known, net.identity(F.lit("instance"), F.col("_conversation"), first)).otherwise(F.lit("")),
        "conversation_id": F.when(F.col("proto").isin("tcp", "udp"), F.col("_conversation")),
        "identity_status": F.when(known, F.lit("instance")).otherwise(F.lit("unassigned")),
        "timestamp_ns": F.col("timestamp_ns").cast("string"),
        "timestamp_ms": net.ms_of_ns(F.col("timestamp_ns")),
        "event_type": F.lit("packet"),
        **{c: F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "proto")},
        "packets": F.lit(1),
        "bytes": F.col("original_len"),
        "payload": payload,
    }
    return _row(keyed, sensor, "packet", [F.col("sequence")], cells)


def flow_rows(ended: DataFrame, sensor: str) -> DataFrame:
    """``flow.end`` rows, under the time of their end; addresses are the canonical endpoints."""
    payload = F.to_json(F.struct("first_sequence", "initiator_forward", "start_us", "end_us", "packets_ab", "packets_ba", "bytes_ab", "bytes_ba", "flags_ab", "flags_ba", "end_reason", "tcp_state"))
    cells = {
        "flow_id": F.col("flow_id"),
        "conversation_id": F.col("conversation_id"),
        "identity_status": F.lit("instance"),
        "timestamp_ns": F.concat(F.col("end_us").cast("string"), F.lit("000")),
        "timestamp_ms": F.floor(F.col("end_us") / 1000),
        "event_type": F.lit("flow.end"),
        "src_ip": F.col("a_ip"), "src_port": F.col("a_port"), "dst_ip": F.col("b_ip"), "dst_port": F.col("b_port"), "proto": F.col("proto"),
        "packets": F.col("packets_ab") + F.col("packets_ba"),
        "bytes": F.col("bytes_ab") + F.col("bytes_ba"),
        "payload": payload,
    }
    return _row(ended, sensor, "flow.end", [F.col("flow_id"), F.col("end_us")], cells)


def malformed_rows(records: DataFrame, sensor: str) -> DataFrame:
    payload = F.to_json(F.struct(F.struct(F.lit("PACKET").alias("code"), F.col("error").alias("message")).alias("anomaly"), F.struct(_header().alias("header")).alias("packet")))
    cells = {"timestamp_ns": F.col("timestamp_ns").cast("string"), "timestamp_ms": net.ms_of_ns(F.col("timestamp_ns")), "event_type": F.lit("anomaly.decode"), "payload": payload}
    return _row(records, sensor, "anomaly.decode", [F.col("sequence")], cells)


def analysis_rows(events: DataFrame, instances: DataFrame, sensor: str) -> DataFrame:
    """Application events under the instance that all their packets belong to."""
    named = events.withColumn("event_id", net.identity(F.col("source"), F.col("event_type"), F.col("sequence"), F.col("payload")))
    rows = flows.inherit(named, instances.select("source", "sequence", "first_sequence", "flow_id"), "flow_id")
    packet = F.from_json("payload", "packet struct<src:string,dst:string,proto:string>")["packet"]
    known = F.col("flow_id").isNotNull()
    cells = {
        "flow_id": F.coalesce("flow_id", F.lit("")),
        "identity_status": F.when(known, "instance").otherwise("unassigned"),
        "timestamp_ns": F.concat(F.col("us").cast("string"), F.lit("000")),
        "timestamp_ms": F.floor(F.col("us") / 1000),
        "event_type": F.col("event_type"),
        "src_ip": packet["src"], "dst_ip": packet["dst"], "proto": packet["proto"],
        "payload": F.col("payload"),
    }
    return _row(rows, sensor, "analysis", [F.col("event_type"), F.col("sequence"), F.col("payload")], cells)


def export_rows(records: DataFrame, sensor: str) -> DataFrame:
    """``flow.export`` and its companions of decoded datagrams; time is the flow's end, else the export's."""
    rows = records.withColumn("source", F.col("exporter"))
    ms = F.coalesce("end_ms", F.col("export_time") * 1000, F.col("arrival") * 1000)
    shown = F.transform("fields", lambda f: F.struct(f["enterprise"].alias("enterprise"), f["id"].alias("id"), F.hex(f["value"]).alias("value"), f["scope"].alias("scope")))
    payload = F.to_json(F.struct("version", "domain", "sequence", "export_time", "start_ms", "end_ms", "tcp_flags", "sampling_interval", "code", "message", shown.alias("fields")))
    cells = {
        "identity_status": F.lit("exported"),
        "timestamp_ns": F.concat(ms.cast("string"), F.lit("000000")),
        "timestamp_ms": ms,
        "event_type": F.col("kind"),
        **{c: F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "packets", "bytes")},
        "proto": net.protocol_text(F.col("protocol")),
        "payload": payload,
    }
    return _row(rows, sensor, "export", [F.col("arrival"), payload], cells)


def capture(records: DataFrame, sensor: str = "default", timeouts: flows.Timeouts = flows.Timeouts(), dns_ports: tuple[int, ...] = (53,)) -> DataFrame:
    """All observations of a capture: packets, ended flows, application events and anomalies."""
    rows = decode.decode_records(records).withColumn("us", F.floor(F.col("timestamp_ns") / 1000).cast("bigint"))
    packets = rows.where(F.col("kind") == "packet")
    slim = packets.drop("payload", "datagram")
    instances = flows.assign(slim, timeouts)
    marked = slim.join(instances, ["source", "sequence"], "left")
    ended = flows.sessionize(slim, timeouts)
    events = reassembly.analyze(rows, dns_ports)
    named = flows.with_flow_key(marked).withColumn("conversation_id", flows.conversation_id()).withColumn("flow_id", F.when(F.col("first_sequence").isNotNull(), flows.flow_id()))
    out = packet_rows(marked, sensor).unionByName(flow_rows(ended, sensor)).unionByName(malformed_rows(rows.where(F.col("kind") == "malformed"), sensor))
    return out.unionByName(analysis_rows(events, named, sensor))
