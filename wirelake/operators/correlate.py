"""DNS to TLS correlation: which name lookups can explain a connection, with ambiguity kept.

Bindings are answers of DNS responses under the questions that lead to them, through at most sixteen aliases. A client
hello joins them by equality of name, address, sensor, link context, client and source, and by an interval of
time; all candidates stay, and their number makes the status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.errors import WirelakeError
from wirelake.functions import net

#: Aliases on the way to an answer, and the greatest TTL.
HOPS, MAX_TTL = 16, (1 << 32) - 1

DNS = (
    "struct<rcode:int,truncated:boolean,response:boolean,questions:array<struct<name:string,class:int>>,"
    "answers:array<struct<name:string,class:int,rr_type:int,ttl:bigint,data:struct<type:string,value:string>>>>"
)
PACKET = "struct<header:struct<section:int,interface:int>,vlans:array<int>>"


def _name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\.+$", ""))


def context(packet: Column) -> Column:
    """Section, interface and VLANs as one text; null if one is missing."""
    return F.concat_ws("|", packet["header"]["section"].cast("string"), packet["header"]["interface"].cast("string"), F.array_join(F.transform(packet["vlans"], lambda v: v.cast("string")), ","))


def _complete(packet: Column) -> Column:
    return packet["header"]["section"].isNotNull() & packet["header"]["interface"].isNotNull() & packet["vlans"].isNotNull()


def _sound_ttl(ttl: Column) -> Column:
    return F.when((ttl > 0) & (ttl <= MAX_TTL), ttl)


def walk(question: Column, owner: Column, ttl: Column, answers: Column) -> Column:
    """struct(current, ttl, chain) after following aliases from the question towards the owner of an answer.

    A step needs exactly one alias of the current name, with a sound TTL, to a name that is new.
    """
    start = F.struct(question.alias("current"), ttl.alias("ttl"), F.array(question).alias("chain"), F.lit(False).alias("stuck"))

    def step(s: Column, _: Column) -> Column:
        links = F.filter(answers, lambda r: (r["class"] == 1) & (r["rr_type"] == 5) & (_name(r["name"]) == s["current"]))
        link = F.get(links, F.lit(0))
        to, own = _name(link["data"]["value"]), _sound_ttl(link["ttl"])
        good = (F.size(links) == 1) & to.isNotNull() & own.isNotNull() & ~F.array_contains(s["chain"], to)
        moved = F.struct(to.alias("current"), F.least(s["ttl"], own).alias("ttl"), F.concat(s["chain"], F.array(to)).alias("chain"), F.lit(False).alias("stuck"))
        stopped = F.struct(s["current"].alias("current"), s["ttl"].alias("ttl"), s["chain"].alias("chain"), F.lit(True).alias("stuck"))
        return F.when(s["stuck"] | (s["current"] == owner), s).when(F.coalesce(good, F.lit(False)), moved).otherwise(stopped)

    return F.aggregate(F.sequence(F.lit(1), F.lit(HOPS)), start, step)


def bindings(events: DataFrame) -> DataFrame:
    """One row for each answer of a DNS response under each question that leads to it."""
    rows = events.where((F.col("event_type") == "dns.response") & (F.col("flow_id") != "") & (F.col("identity_status") == "instance") & F.col("timestamp_ns").isNotNull())
    rows = rows.withColumn("_p", F.from_json("payload", f"dns {DNS}, packet {PACKET}")).where(_complete(F.col("_p.packet")))
    dns = F.col("_p.dns")
    rows = rows.where((dns["rcode"] == 0) & ~dns["truncated"] & dns["response"]).withColumns({"_answers": dns["answers"], "_context": context(F.col("_p.packet")), "_q": F.explode(dns["questions"])})
    rows = rows.where(F.col("_q.class") == 1).withColumn("_a", F.explode("_answers"))
    rows = rows.where((F.col("_a.class") == 1) & F.col("_a.data.type").isin("a", "aaaa"))
    ttl = _sound_ttl(F.col("_a.ttl"))
    rows = rows.withColumns({"_owner": _name(F.col("_a.name")), "_key": net.ip_key(F.col("_a.data.value")), "_ttl": ttl}).where("_key is not null and _ttl is not null and _owner is not null and _q.name is not null")
    walked = walk(_name(F.col("_q.name")), F.col("_owner"), F.col("_ttl"), F.col("_answers"))
    rows = rows.withColumn("_w", walked).where(F.col("_w.current") == F.col("_owner"))
    return rows.select(
        F.element_at("_w.chain", 1).alias("name"),
        F.col("_key").alias("address_key"),
        F.col("sensor").alias("dns_sensor"),
        F.col("source").alias("dns_source"),
        F.col("_context").alias("dns_context"),
        F.col("dst_ip").alias("dns_client"),
        F.col("timestamp_ns").cast("decimal(38,0)").alias("dns_at"),
        F.col("_w.ttl").alias("dns_ttl_seconds"),
        F.col("_w.chain").alias("dns_name_chain"),
        F.col("event_id").alias("dns_event_id"),
        F.col("flow_id").alias("dns_flow_id"),
    )


def hellos(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("event_type") == "tls.client_hello").withColumn("_p", F.from_json("payload", f"protocol struct<server_name:string>, packet {PACKET}"))
    return rows.select(
        F.col("event_id").alias("tls_event_id"),
        F.col("flow_id").alias("tls_flow_id"),
        F.col("identity_status").alias("_identity"),
        "sensor",
        "source",
        F.col("src_ip").alias("client"),
        F.col("dst_ip").alias("destination_ip"),
        net.ip_key(F.col("dst_ip")).alias("_key"),
        _name(F.col("_p.protocol.server_name")).alias("server_name"),
        F.when(_complete(F.col("_p.packet")), context(F.col("_p.packet"))).alias("_context"),
        F.col("timestamp_ns").cast("decimal(38,0)").alias("_at"),
    )


def relate(events: DataFrame, window_seconds: int, cross_source: bool = False) -> DataFrame:
    """One row for each client hello and candidate: status unmatched, inferred or ambiguous."""
    if not 1 <= window_seconds <= 3600:
        raise WirelakeError("the window lasts from 1 to 3600 seconds")
    # A lookup that explains a hello lies in its stretch of the window's length, or the one before: a client that is busy
    # all day does not meet all its lookups with all its hellos.
    length = F.lit(window_seconds * 1_000_000_000).cast("decimal(38,0)")
    stretch = lambda at: F.floor(at / length).cast("bigint")
    tls = hellos(events).withColumn("_stretch", F.explode_outer(F.array(stretch(F.col("_at")), stretch(F.col("_at")) - 1)))
    dns = bindings(events).withColumn("_dns_stretch", stretch(F.col("dns_at")))
    delta = F.col("_at") - F.col("dns_at")
    on = (
        (F.col("server_name") == F.col("name"))
        & (F.col("_stretch") == F.col("_dns_stretch"))
        & (F.col("_key") == F.col("address_key"))
        & (F.col("sensor") == F.col("dns_sensor"))
        & (F.col("_context") == F.col("dns_context"))
        & (F.col("client") == F.col("dns_client"))
        & (F.col("_identity") == "instance")
        & (F.col("tls_flow_id") != "")
        & (F.col("tls_flow_id") != F.col("dns_flow_id"))
        & (delta >= 0)
        & (delta <= F.lit(window_seconds * 1_000_000_000))
        & (delta < F.col("dns_ttl_seconds").cast("decimal(20,0)") * F.lit(1_000_000_000))
    )
    if not cross_source:
        on = on & (F.col("source") == F.col("dns_source"))
    pairs = tls.join(dns, on, "left").withColumn("delta_ns", delta.cast("string"))
    first = F.row_number().over(W.partitionBy("tls_event_id", "dns_event_id").orderBy(F.size("dns_name_chain"), F.concat_ws(".", "dns_name_chain"), "dns_ttl_seconds"))
    pairs = pairs.withColumn("_first", first).where("_first = 1")
    n = F.count("dns_event_id").over(W.partitionBy("tls_event_id"))
    counted = pairs.withColumn("candidate_count", n).where("dns_event_id is not null or candidate_count = 0").drop("_stretch", "_dns_stretch")
    out = counted.join(_intel(events), "tls_event_id", "left")
    own = _intel(events).withColumnRenamed("tls_event_id", "dns_event_id").withColumnRenamed("_ids", "_dns_ids")
    out = out.join(own, "dns_event_id", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        F.lit("correlation.dns_tls").alias("event_type"),
        F.when(F.col("candidate_count") == 0, "unmatched").when(F.col("candidate_count") == 1, "inferred").otherwise("ambiguous").alias("status"),
        "candidate_count", "tls_event_id", "tls_flow_id", "dns_event_id", "dns_flow_id", "sensor", "source", "dns_source",
        (F.col("dns_source") != F.col("source")).alias("cross_source"),
        "client", "server_name", "destination_ip", "dns_name_chain", "dns_ttl_seconds", "delta_ns",
        F.lit(window_seconds).alias("window_seconds"),
        F.concat(F.coalesce("_ids", empty), F.coalesce("_dns_ids", empty)).alias("intel_event_ids"),
    )


def _intel(events: DataFrame) -> DataFrame:
    """Indicator matches by the event that they are about."""
    rows = events.where(F.col("event_type") == "intel.match").select(net.json_scalar(F.col("payload"), "$.source_event_id").alias("tls_event_id"), "event_id")
    return rows.where("tls_event_id is not null").groupBy("tls_event_id").agg(F.array_sort(F.collect_list("event_id")).alias("_ids"))


def trace(events: DataFrame, flow_id: str) -> DataFrame:
    """All observations of one flow in time order."""
    if len(flow_id) != 64 or not all(c in "0123456789abcdef" for c in flow_id):
        raise WirelakeError("a flow id has 64 hex digits")
    return events.where(F.col("flow_id") == flow_id).orderBy(F.asc_nulls_last("timestamp_ms"))


def timeline(events: DataFrame, limit: int | None = None) -> DataFrame:
    out = events.orderBy(F.asc_nulls_last("timestamp_ms"))
    return out.limit(limit) if limit is not None else out


def related(events: DataFrame, event_id: str, window_seconds: int = 300, limit: int = 10_000) -> DataFrame:
    """Observations of the focus's flow and of the flows that correlate with it, in time order; ``truncated`` says if more exist."""
    focus = events.where(F.col("event_id") == event_id).select("flow_id", "timestamp_ms").limit(1)
    row = focus.first()
    if row is None:
        raise WirelakeError(f"there is no event {event_id}")
    span = window_seconds * 1000
    kinds = F.col("event_type").isin("dns.response", "tls.client_hello", "intel.match")
    near = events.where(kinds & (F.lit(True) if row["timestamp_ms"] is None else F.col("timestamp_ms").between(row["timestamp_ms"] - span, row["timestamp_ms"] + span)))
    links = relate(near, window_seconds).where("status <> 'unmatched'").select("tls_flow_id", "dns_flow_id")
    hop = links.where((F.col("tls_flow_id") == row["flow_id"]) | (F.col("dns_flow_id") == row["flow_id"]))
    flows = focus.select("flow_id").union(hop.select("tls_flow_id")).union(hop.select("dns_flow_id")).where("flow_id <> ''").distinct()
    found = events.join(flows, "flow_id", "left_semi").select(*events.columns).unionByName(events.where((F.col("event_id") == event_id) & (F.col("flow_id") == "")))
    out = timeline(found, limit + 1)
    number = F.row_number().over(W.orderBy(F.asc_nulls_last("timestamp_ms"), "event_id"))  # limit + 1 rows at most
    return out.withColumn("_n", number).withColumn("truncated", F.max("_n").over(W.partitionBy(F.lit(1))) > limit).where(F.col("_n") <= limit).drop("_n")
