from __future__ import annotations

import json
from random import Random

import pytest
from frames import EXAMPLE, client_hello, dns, pcap, tcp, udp
from pyspark.sql import functions as F

from wirelake import schema
from wirelake.errors import StoreError, WirelakeError
from wirelake.operators import correlate, enrich, evidence, flows, retention
from wirelake.operators.plugins import Registry
from wirelake.plans import pipeline, policy
from wirelake.sources import collector, feeds, netflow
from wirelake.sources import pcap as P
from wirelake.sources.store import Store, foreign, hot_journal, with_hot
from wirelake.streaming import live

A, B = "a" * 64, "b" * 64


def obs(spark, rows):
    base = {"event_id": "e", "flow_id": "", "sensor": "s", "source": "c", "event_type": "packet", "payload": "{}"}
    full = [tuple((base | {"event_id": f"e{k}"} | r).get(c) for c in schema.COLUMNS) for k, r in enumerate(rows)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.OBSERVATION.fields)
    return spark.createDataFrame(full, kinds)


def bulk(spark):
    return obs(spark, [{"src_ip": "10.0.0.1", "dst_port": 443, "bytes": 100, "packets": 1, "timestamp_ms": 1000 * k} for k in range(1100)])


def test_store_publishes_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.events().count() == 0
    s.append(bulk(spark), A)
    got = pipeline.query(s.events(), "dst.port == 443 && event.type == packet && time >= 5 | group src.ip | sort bytes desc").first()
    assert (got["count"], got["bytes"]) == (1099, 109900)
    assert pipeline.query(s.events(), "*").columns == schema.COLUMNS
    for batch in (A, "x"):
        with pytest.raises(StoreError):
            s.append(bulk(spark), batch)
    bad = bulk(spark).withColumn("payload", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        s.append(bad, B)
    assert s.committed() == [A] and not list((tmp_path / "s").glob(".staging*"))
    assert Store(spark, str(tmp_path / "s")).events().count() == 1100
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "schema.json").write_text('{"schema_version": 9}')
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "t"))


def test_partitions_are_pruned(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = obs(spark, [{"timestamp_ms": 10}, {"timestamp_ms": 7_200_000}, {"timestamp_ms": None, "event_type": "odd type"}])
    s.append(rows, A)
    df = pipeline.query(s.events(), "event.type == packet && time < 3600000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "event" in plan.split("PartitionFilters: [")[1].split("]")[0] and df.count() == 1
    assert pipeline.query(s.events(), 'event.type == "odd type"').count() == 1


def test_old_layout_and_version(spark, tmp_path):
    old = obs(spark, [{"bytes": 5}]).drop(*schema.SINCE_VERSION_2)
    old.write.parquet(str(tmp_path / "data" / A / "event=x" / "hour=0"))
    old.write.parquet(str(tmp_path / "data" / B / "event=y" / "hour=0"))
    got = foreign(spark, str(tmp_path / "data"), 1)
    assert got.columns == schema.COLUMNS and got.count() == 2 and got.first()["conversation_id"] is None


def test_compaction_classes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append(obs(spark, [{"timestamp_ms": 100}, {"timestamp_ms": 200}, {"timestamp_ms": None}]), A)
    assert s.compact(str(tmp_path / "t"), 150) == {"read": 3, "retained": 2, "discarded": 1}
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "t")).append(bulk(spark), A)
    with pytest.raises(StoreError):
        s.compact(str(tmp_path / "s" / "inner"), 0)
    rows = obs(spark, [{"timestamp_ms": 100}, {"timestamp_ms": 100, "event_type": "notice.policy"}, {"timestamp_ms": 100, "event_type": "anomaly"}])
    assert [r["event_type"] for r in retention.retained(rows, 200, 0).collect()] == ["notice.policy"]
    assert retention.accepted(obs(spark, [{"event_type": "dns.query"}, {"event_type": "x.y"}, {"event_type": "file.seen"}]), {"files"}).count() == 2


def test_hot_tail(spark, tmp_path):
    row = {f: "x" for f in schema.COLUMNS} | {"timestamp_ms": 1, "src_port": 1, "dst_port": 1, "packets": 1, "bytes": 1}
    (tmp_path / "j.jsonl").write_text("\n".join(json.dumps(row | {"batch": b, "event_id": b}) for b in "123") + '\n{"batch": "4", "event')
    hot = hot_journal(spark, str(tmp_path / "j.jsonl"))
    committed = hot.where("batch = '1'")
    assert sorted(r["batch"] for r in with_hot(committed, hot).collect()) == ["1", "2", "3"]


PACKET = {"header": {"section": 0, "interface": 0}, "vlans": []}


def lookup(ttl=60, **change):
    dns_ = {"rcode": 0, "truncated": False, "response": True, "questions": [{"name": "A.test.", "class": 1}], "answers": [{"name": "a.test", "class": 1, "rr_type": 1, "ttl": ttl, "data": {"type": "a", "value": "198.51.100.20"}}]}
    return {"event_type": "dns.response", "flow_id": "f1", "identity_status": "instance", "timestamp_ns": "1000000000", "src_ip": "9.9.9.9", "dst_ip": "192.0.2.10", "payload": json.dumps({"packet": PACKET, "dns": dns_ | change.pop("dns", {})})} | change


def hello(**change):
    return {"event_type": "tls.client_hello", "flow_id": "f2", "identity_status": "instance", "timestamp_ns": "2000000000", "src_ip": "192.0.2.10", "dst_ip": "198.51.100.20", "payload": json.dumps({"packet": change.pop("packet", PACKET), "protocol": {"server_name": "a.TEST"}})} | change


@pytest.mark.parametrize(("left", "right", "want"), [
    (lookup(), hello(), "inferred"), (lookup(ttl=1), hello(), "unmatched"), (lookup(ttl=0), hello(), "unmatched"), (lookup(source="d"), hello(), "unmatched"), (lookup(sensor="t"), hello(), "unmatched"),
    (lookup(dst_ip="192.0.2.11"), hello(), "unmatched"), (lookup(), hello(dst_ip="198.51.100.21"), "unmatched"), (lookup(), hello(flow_id="f1"), "unmatched"), (lookup(), hello(flow_id=""), "unmatched"),
    (lookup(), hello(timestamp_ns="999999999"), "unmatched"), (lookup(), hello(identity_status="unassigned"), "unmatched"), (lookup(dns={"rcode": 3}), hello(), "unmatched"), (lookup(dns={"truncated": True}), hello(), "unmatched"),
    (lookup(), hello(packet=PACKET | {"vlans": [3]}), "unmatched"),
])
def test_correlation_mutations(spark, left, right, want):
    assert [r["status"] for r in correlate.relate(obs(spark, [left, right]), 300).collect()] == [want]


def test_correlation_ambiguity_intel_and_aliases(spark):
    intel = {"event_type": "intel.match", "payload": json.dumps({"source_event_id": "e2"})}
    got = correlate.relate(obs(spark, [lookup(), lookup(flow_id="f9"), hello(), intel]), 300).collect()
    assert [r["status"] for r in got] == ["ambiguous"] * 2 and [r["intel_event_ids"] for r in got] == [["e3"]] * 2
    answers = [{"name": "a.test.", "class": 1, "rr_type": 5, "ttl": 3, "data": {"type": "cname", "value": "b.test."}}, {"name": "b.test.", "class": 1, "rr_type": 1, "ttl": 60, "data": {"type": "a", "value": "198.51.100.20"}}]
    rows = obs(spark, [lookup(dns={"answers": answers}, source="d"), hello()])
    assert correlate.relate(rows, 300).first()["status"] == "unmatched"
    r = correlate.relate(rows, 300, cross_source=True).first()
    assert (r["status"], r["dns_ttl_seconds"], r["dns_name_chain"], r["cross_source"]) == ("inferred", 3, ["a.test", "b.test"], True)
    loop = [answers[0], {"name": "b.test.", "class": 1, "rr_type": 5, "ttl": 3, "data": {"type": "cname", "value": "a.test"}}, answers[1] | {"name": "c.test"}]
    assert correlate.relate(obs(spark, [lookup(dns={"answers": loop}), hello()]), 300).first()["status"] == "unmatched"
    with pytest.raises(WirelakeError):
        correlate.relate(rows, 0)
    near = correlate.related(obs(spark, [lookup(timestamp_ms=1000), hello(timestamp_ms=2000), {"flow_id": "f3"}]), "e1")
    assert [r["event_id"] for r in near.collect()] == ["e0", "e1"]
    with pytest.raises(WirelakeError):
        correlate.trace(rows, "x")


def test_findings_and_derived_rows(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"kind":"domain","value":"A.test","source":"x"}\n{"kind":"ip","value":"2001:DB8::1","source":"y","severity":"high"}\n\n{"kind":"cidr","value":"10.0.0.0/8","source":"z"}\n{"kind":"url","value":"http://a.test/p#f","source":"u"}\n')
    (tmp_path / "r.jsonl").write_text('{"id":"r","event_type":"*","field":"proto","equals":"tcp","message":"m","severity":"info"}\n')
    events = obs(spark, [
        {"event_type": "http.request", "src_ip": "2001:db8:0::1", "dst_ip": "10.1.2.3", "proto": "tcp", "bytes": 5, "payload": json.dumps({"protocol": {"host": "a.test", "target": "/p"}})},
        {"event_type": "packet", "src_ip": "11.0.0.1"},
    ])
    found = enrich.findings(events, feeds.indicators(spark, str(tmp_path / "i.jsonl")), feeds.rules(spark, str(tmp_path / "r.jsonl")))
    assert sorted((r["event_type"], r["by"], r["field"]) for r in found.collect()) == [("intel.match", "u", "url"), ("intel.match", "x", "domain"), ("intel.match", "y", "src.ip"), ("intel.match", "z", "dst.ip"), ("notice.policy", "r", "proto")]
    made = enrich.derived(events, found)
    assert made.count() == 5 and made.where("bytes is not null").count() == 0 and {json.loads(r["payload"])["source_event_id"] for r in made.collect()} == {"e0"}
    for bad in ('{"kind":"ip","value":"x","source":"x"}', '{"kind":"ip","value":"1.2.3.4","source":"x","severity":"loud"}'):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(WirelakeError):
            enrich.findings(events, feeds.indicators(spark, str(tmp_path / "b.jsonl")))
    (tmp_path / "b.jsonl").write_text('{"kind":"ip","value":"1.2.3.4","source":"x","more":1}')
    with pytest.raises(WirelakeError):
        feeds.indicators(spark, str(tmp_path / "b.jsonl"))


def test_changes_and_gate(spark):
    responses = [lookup(timestamp_ms=k, dns={"answers": [{"name": "a.test", "class": 1, "rr_type": 1, "ttl": 1, "data": {"type": "a", "value": v}} for v in values]}) for k, values in enumerate((["1", "2"], ["2", "1"], ["3"]))]
    sets = enrich.rrsets(obs(spark, responses))
    got = enrich.changes(sets, ["sensor", "rrset"], "values", ["timestamp_ms"]).collect()
    assert [r["timestamp_ms"] for r in got] == [2]
    rows = obs(spark, [{"timestamp_ms": t} for t in (0, 59_999, 60_000, 119_999, 130_000)])
    gated = enrich.notice_gate(rows, ["sensor"])
    assert [r["passed"] for r in gated.orderBy("timestamp_ms").collect()] == [True, False, True, False, True]
    assert enrich.suppressed(gated).first()["suppressed"] == 2
    many = obs(spark, [{"timestamp_ms": 5, "flow_id": str(k)} for k in range(120)])
    assert enrich.notice_gate(many, ["flow_id"]).where("passed").count() == 100


def test_gate_by_brute_force(spark):
    """Keys with null, ties, repeated rows; refusals that begin no quiet time, round after round."""
    rng = Random(5)
    rows = [(f"e{k % 55}", rng.choice(["a", "b", "c", None]), rng.randrange(12_000)) for k in range(90)]
    df = spark.createDataFrame(rows, "event_id string, topic string, timestamp_ms long")
    for quiet, most in ((1500, 1), (400, 2), (2500, 1)):
        got = enrich.notice_gate(df, ["topic"], quiet_ms=quiet, per_second=most).collect()
        last, used, passed = {}, {}, []
        for e, topic, at in sorted(((r["event_id"], r["topic"], r["timestamp_ms"]) for r in got), key=lambda r: (r[2], r[0])):
            ok = at - last.get(topic, -10**9) >= quiet and used.get(at // 1000, 0) < most
            if ok:
                last[topic], used[at // 1000] = at, used.get(at // 1000, 0) + 1
            passed.append((at, ok))
        assert len(got) == 90 and sorted((r["timestamp_ms"], r["passed"]) for r in got) == sorted(passed)


def test_collector_reads_datagrams(spark, tmp_path):
    """A port that a stream listens on; what it has received comes to the decoder, once."""
    import socket
    import time

    collector.register(spark)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    stream = spark.readStream.format("udp_exports").option("host", "127.0.0.1").option("port", str(port)).option("journal", str(tmp_path / "j")).load()
    got = []
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(netflow.decode_v5_datagrams(df).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    head = bytes.fromhex("00050001000003E8655400000000000000000000" + "00000000")
    record = bytes.fromhex("0A000001" + "AC000001" + "00000000" + "00000000" + "00000005" + "00000200" + "000001F4" + "00000384" + "07D0" + "01BB" + "0018" + "0600" + "0000000000000000")
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for _ in range(100):
                out.sendto(head + record, ("127.0.0.1", port))
                time.sleep(0.5)
                if len(got) >= 3:
                    break
    finally:
        q.stop()
    assert len(got) >= 3 and {(r["kind"], r["src_ip"], r["packets"], r["bytes"]) for r in got} == {("flow.export", "10.0.0.1", 5, 512)} and got[0]["exporter"].startswith("127.0.0.1:")


def test_policy_effects_and_counters(spark):
    program = policy.parse('on packet where bytes > 1 { notice(severity: high, message: m); metric(name: n, value: 2); }')
    events = obs(spark, [{"bytes": b, "timestamp_ms": k, "flow_id": "f"} for k, b in enumerate((1, 2, 3))])
    found = policy.effects(events, program)
    assert [r["total"] for r in policy.metric_totals(found).orderBy("timestamp_ms").collect()] == [2, 4]
    assert policy.gated(found).where("passed").count() == 3 and policy.prometheus(found).endswith("n_total 4\n")
    assert policy.observations(found, events).where("packets is null and event_type = 'policy.metric'").count() == 2


def test_plugins(spark):
    r = Registry()
    r.register("double", ["dns.query"], lambda row: [{"seen": row["event_id"]}, {"again": 1}])
    r.register("broken", ["dns.query"], lambda row: 1 / 0)
    made = r.run(obs(spark, [{"event_type": "dns.query", "bytes": 3}, {"event_type": "packet"}]).coalesce(1))
    assert sorted(x["event_type"] for x in made.collect()) == ["anomaly.plugin", "notice.plugin", "notice.plugin"] and made.where("bytes is not null").count() == 0
    with pytest.raises(WirelakeError):
        r.register("p", ["packet"], lambda row: [])


def test_evidence(spark, tmp_path):
    events = obs(spark, [{"payload": '{"source_event_id":"e1"}'}, {"payload": '{"source_event_id":"e2"}'}, {}, {"payload": '{"source_event_id":"e3"}'}])
    assert evidence.source_event(events, "e0")["event_id"] == "e2"
    with pytest.raises(WirelakeError):
        evidence.source_event(events, "e3")
    (tmp_path / "a.pcap").write_bytes(pcap(EXAMPLE))
    records = P.read(spark, str(tmp_path / "a.pcap"))
    refs = records.where("sequence = 4").select("source", "section", "interface", "sequence")
    assert evidence.packets_of(records, refs.union(refs)).count() == 1
    df = spark.createDataFrame([(1, [3, 1], True), (1, [1, 2], True)], "k int, refs array<int>, complete boolean")
    r = df.groupBy("k").agg(*evidence.merged()).first()
    assert (r["refs"], r["complete"]) == ([1, 2, 3], True)
    manifest = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "path string, bytes long, closed_ms long")
    assert sorted(x["path"] for x in evidence.prune(manifest, 10).collect()) == ["b", "c"]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('sensor = "x"\n')
    assert feeds.config([tmp_path / "c.toml", tmp_path / "none"], {"WIRELAKE_ACTIVE_SECONDS": "5"}) | {} == feeds.DEFAULTS | {"sensor": "x", "active_seconds": 5}
    (tmp_path / "c.toml").write_text("sensors = 1\n")
    with pytest.raises(WirelakeError):
        feeds.config([tmp_path / "c.toml"], {})


def test_capture_stream_windows_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.pcap").write_bytes(pcap([udp(53000 + k, 53, dns()), tcp(50000, 443, 1, 24, client_hello())]))
    P.register(spark)
    stream = spark.readStream.format("pcap").load(str(tmp_path / "in"))
    rows = stream.select(
        F.concat_ws("-", "source", "sequence").alias("event_id"), F.lit("").alias("flow_id"), F.lit(None).cast("string").alias("conversation_id"), F.lit(None).cast("string").alias("identity_status"), F.lit("s").alias("sensor"), "source",
        F.col("timestamp_ns").cast("string"), F.lit(1).cast("bigint").alias("timestamp_ms"), F.lit("packet").alias("event_type"), *[F.lit(None).cast(t).alias(c) for c, t in (("src_ip", "string"), ("src_port", "bigint"), ("dst_ip", "string"), ("dst_port", "bigint"), ("proto", "string"))],
        F.lit(1).cast("bigint").alias("packets"), F.col("original_len").alias("bytes"), F.lit("{}").alias("payload"),
    )
    s, got = Store(spark, str(tmp_path / "s")), []
    live.write_store(rows, s, str(tmp_path / "c1"), available_now=True).awaitTermination(120)
    assert s.events().count() == 6
    live.query_windows(rows, "* | count", 1, got.append, str(tmp_path / "c2"), available_now=True).awaitTermination(120)
    assert sum(x["rows"][0]["count"] for x in got) == 6 and {x["event_type"] for x in got} == {"query.window"}


def test_flow_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = "sequence long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, us long, original_len long, tcp_flags int, tcp_sequence long, fragmented boolean, vlans array<int>"
    rows = [(k, "10.0.0.1", "10.0.0.2", 1 + k % 2, 5, "tcp", 1_700_000_000_000_000 + k * 1_000_000, 10, 4 if k % 7 == 6 else 16, None, False, []) for k in range(40)]
    df = spark.createDataFrame(rows, kinds)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.stream_flows(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(180)
    want = flows.sessionize(df).where("end_reason = 'tcp_reset'")
    assert sorted((r["first_sequence"], r["packets_ab"]) for r in spark.table("ended").where("end_reason = 'tcp_reset'").collect()) == sorted((r["first_sequence"], r["packets_ab"]) for r in want.collect())


@pytest.mark.parametrize("block", [40, 250_000])
@pytest.mark.parametrize("per_second", [1, 3])
def test_full_seconds_take_few_rounds(spark, monkeypatch, block, per_second):
    """Hundreds of seconds that are full one after another, so that what passes in one depends on all before: a round settles a block at least."""
    tables = []
    monkeypatch.setattr(enrich, "BLOCK", block, raising=False)
    monkeypatch.setattr(enrich, "written", lambda df, tag, own=enrich.written: tables.append(tag) or own(df, tag))
    rng = Random(11)
    rows = [(k, rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([-1, 1]) * rng.randrange(120_000) if k else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, topic string, timestamp_ms long")
    got = enrich.notice_gate(df, ["topic"], quiet_ms=2500, per_second=per_second).collect()
    used, last, want = {}, {}, {0: False}
    for k, topic, at in sorted(rows[1:], key=lambda r: (r[2], r[0])):
        want[k] = used.get(at // 1000, 0) < per_second and (topic not in last or at - last[topic] >= 2500)
        if want[k]:
            used[at // 1000], last[topic] = used.get(at // 1000, 0) + 1, at
    assert {r["event_id"]: r["passed"] for r in got} == want and len(got) == len(rows)
    assert len(tables) <= (5 if block > len(rows) else 50)
