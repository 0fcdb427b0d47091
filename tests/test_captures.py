from __future__ import annotations

import struct
from random import Random

import pytest
from frames import EXAMPLE, V4, V6, client_hello, dns, ethernet, ip, pcap, pcapng, tcp, udp
from pyspark.sql import functions as F

from wirelake.errors import DecodeError, QuerySyntaxError
from wirelake.operators import flows, stats
from wirelake.plans import ingest, packets, pipeline
from wirelake.sources import decode, netflow, protocols, reassembly
from wirelake.sources import pcap as P


def decoded(spark, tmp_path, data, name="x.pcap"):
    (tmp_path / name).write_bytes(data)
    return decode.decode_records(P.read(spark, str(tmp_path / name))).withColumn("us", F.floor(F.col("timestamp_ns") / 1000).cast("bigint"))


@pytest.mark.parametrize(("text", "want"), {
    "dst.port == 443": [1, 3], "proto == udp || proto == tcp && src.ip == 192.0.2.10": [1, 2, 4], "(proto == udp || proto == tcp) && src.ip == 192.0.2.10": [1, 2],
    "!(tcp or udp)": [5, 6], "src.ip in 2001:db8::/32 && dst.port != 443": [4], "dst.port != 443": [2, 4], "proto == 58": [6],
}.items())
def test_golden_filters(spark, tmp_path, text, want):
    rows = packets.keyed(decoded(spark, tmp_path, pcap(EXAMPLE)))
    assert sorted(r["sequence"] for r in rows.where(packets.compatible(text)).collect()) == want


def test_filter_dispatch(spark, tmp_path):
    arp = ethernet(bytes.fromhex("0001080006040001020000000001c000020a000000000000c0000214"), 0x0806)
    rows = decoded(spark, tmp_path, pcap([*EXAMPLE, arp]))
    n = lambda x, s="auto": packets.filtered(rows, x, s).count()
    assert [n("dst port 443"), n("udp and port 53"), n("src host 192.0.2.10"), n("not tcp and not udp", "bpf"), n("arp"), n("*"), n("dst.port == 443"), n("tcp")] == [2, 2, 3, 3, 1, 7, 2, 2]
    assert rows.where("kind = 'link'").first()["details"] == "who-has 192.0.2.20 tell 192.0.2.10"
    with pytest.raises(QuerySyntaxError):
        n("tcp[13] == 2")


@pytest.mark.parametrize(("data", "first"), [
    (pcap(EXAMPLE), 1700000000123456000), (pcap(EXAMPLE, order=">"), 1700000000123456000), (pcap(EXAMPLE, nano=True), 1700000000123456716),
    (pcapng(EXAMPLE, [1_700_000_000_500_000 + k for k in range(6)]), 1700000000500000000),
    (pcapng(EXAMPLE, [(1_700_000_000 << 10) + 512] * 6, struct.pack("<HHB3xHHq", 9, 1, 0x8A, 14, 8, -1)), 1699999999500000000),
    (pcapng(EXAMPLE, [0] * 6, simple=True), None),
])
def test_containers(data, first):
    rows = list(P.records(data))
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6] and [r[7] for r in rows] == EXAMPLE
    assert rows[0][3] == first or abs(rows[0][3] - first) < 1000


def test_sections_and_damage():
    one = pcapng(EXAMPLE, [1] * 6)
    rows = list(P.records(one + one))
    assert [r[0] for r in rows][6] == 7 and {r[1] for r in rows} == {0, 1}
    for bad in (b"", b"abcd" * 9, pcap(EXAMPLE)[:-1], one[:-4], one[:40], pcap(EXAMPLE)[:24] + struct.pack("<IIII", 0, 0, 9, 3) + bytes(9)):
        with pytest.raises(DecodeError):
            list(P.records(bad))


def test_decode_never_fails_otherwise():
    rng = Random(1)
    for _ in range(4000):
        data = bytearray(rng.choice([*EXAMPLE, udp(1, 53, dns()), tcp(1, 443, 5, 24, client_hello())]))
        for _ in range(rng.randrange(4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randrange(len(data) + 1)])
        assert decode.decoded(data, rng.choice([0, 1, 101, 113, 276]))["kind"] in ("packet", "link", "other", "malformed")
        for parse in (protocols.dns_message, protocols.tls_handshake, protocols.http_head, protocols.ssh_banner):
            try:
                parse(data)
            except DecodeError:
                pass


def test_messages():
    m = protocols.dns_message(dns("example.test", True, [(1, 60, bytes((198, 51, 100, 20))), (5, 9, b"\x01a\xc0\x0c")]))
    assert m["questions"][0]["name"] == "example.test." and [a["data"]["value"] for a in m["answers"]] == ["198.51.100.20", "a.example.test."]
    for k in range(12, len(dns())):
        with pytest.raises(DecodeError):
            protocols.dns_message(dns()[:k])
    hello = protocols.tls_hello(protocols.tls_handshake(client_hello()))
    assert hello["server_name"] == "example.test" and hello["alpn"] == ["h2"]
    assert all(protocols.tls_handshake(client_hello()[:k]) is None for k in range(len(client_hello())))
    event, end, _ = protocols.http_head(b"GET /x HTTP/1.1\r\nHost: a\r\n\r\nrest")
    assert (event["method"], event["host"], end) == ("GET", "a", 28)
    assert protocols.ssh_banner(b"SSH-2.0-x\r\n")["banner"] == "SSH-2.0-x"


def test_stream_reassembly():
    s = reassembly.Stream(0xFFFFFFFE)
    assert s.push(0, b"cd", False) == b"" and s.push(0xFFFFFFFE, b"ab", False) == b"abcd" and s.push(0xFFFFFFFE, b"ab", False) == b""
    assert s.push(2, b"e", True) == b"e" and s.closed
    for segments in ([(0, b"abc"), (1, b"X")], [(5, b"ab"), (6, b"X")], [(0, b"ab"), ((1 << 32) - 3, b"x")]):
        s = reassembly.Stream(0)
        with pytest.raises(DecodeError):
            for seq, data in segments:
                s.push(seq, data, False)
    text, rng = bytes(range(200)) * 3, Random(2)
    for _ in range(200):
        s, out, cuts = reassembly.Stream(7), b"", []
        for _ in range(30):
            a = rng.randrange(len(text))
            cuts.append((a, min(len(text), a + rng.randrange(1, 90))))
        cuts += [(k, min(k + 50, len(text))) for k in range(0, len(text), 50)]
        rng.shuffle(cuts)
        for a, b in cuts:
            out += s.push(7 + a, text[a:b], False)
        assert out == text and not s.pending


def conversation_frames():
    head = b"GET /f HTTP/1.1\r\nHost: a.test\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\nContent-Type: text/plain\r\n\r\nabc"
    back = V4[::-1]
    query, answer = dns(), dns("example.test", True, [(1, 60, bytes((198, 51, 100, 20)))])
    framed = struct.pack(">H", len(query)) + query
    big = struct.pack(">HHHH", 53001, 53, 8 + len(query), 0) + query
    return [
        udp(53000, 53, query), udp(53, 53000, answer, *back),
        tcp(40000, 80, 99, 2), tcp(80, 40000, 499, 18, b"", *back), tcp(40000, 80, 110, 24, head[10:]), tcp(40000, 80, 100, 24, head[:10]), tcp(80, 40000, 500, 24, body, *back),
        tcp(41000, 443, 9, 2), tcp(41000, 443, 60, 24, client_hello()[50:]), tcp(41000, 443, 10, 24, client_hello()[:50]),
        tcp(42000, 53, 1, 2), tcp(42000, 53, 2, 25, framed),
        ethernet(ip(big[16:], 17, ident=7, bits=2)), ethernet(ip(big[:16], 17, ident=7, bits=0x2000)),
        tcp(43000, 22, 1, 24, b"SSH-2.0-test\r\n"), ethernet(b"\x45\x00"),
    ]


def test_capture_to_observations(spark, tmp_path):
    frames = conversation_frames()
    (tmp_path / "c.pcap").write_bytes(pcap(frames, [1_700_000_000 + k * 0.01 for k in range(len(frames))]))
    rows = ingest.capture(P.read(spark, str(tmp_path / "c.pcap"))).cache()
    kinds = {r["event_type"]: r["count"] for r in rows.groupBy("event_type").count().collect()}
    assert kinds == {"packet": 15, "flow.end": 5, "anomaly.decode": 1, "dns.query": 3, "dns.response": 1, "http.request": 1, "http.response": 1, "file.seen": 1, "tls.client_hello": 1, "ssh.banner": 1}
    import hashlib

    assert hashlib.sha256(b"abc").hexdigest() in rows.where("event_type = 'file.seen'").first()["payload"]
    assert pipeline.query(rows, 'tls.server_name == "example.test" | select flow.id, tls.server_name').first()["tls_server_name"] == "example.test"
    assert rows.where("event_type = 'tls.client_hello'").first()["flow_id"] in {r["flow_id"] for r in rows.where("event_type = 'flow.end'").collect()}
    again = ingest.capture(P.records_of_files(spark, str(tmp_path / "c.pcap")))
    assert {r["event_id"] for r in again.collect()} == {r["event_id"] for r in rows.collect()}
    assert rows.select("event_id").distinct().count() == rows.count()


def test_statistics_golden(spark, tmp_path):
    frames = [
        tcp(1000, 443, 1, 2), tcp(443, 1000, 1, 18, b"", *V4[::-1]), tcp(1000, 443, 2, 16), tcp(1000, 443, 2, 17), tcp(443, 1000, 2, 17, b"", *V4[::-1]),
        udp(53, 53, b"x"), udp(53, 53, b"y", *V4[::-1]), tcp(1, 2, 1, 4),
    ]
    rows = decoded(spark, tmp_path, pcap(frames))
    got = {r["name"]: r["packets"] for r in stats.report(rows, "flags").collect()}
    assert {k: got[k] for k in ("syn", "syn-only", "syn-ack", "fin", "rst", "ack")} == {"syn": 2, "syn-only": 1, "syn-ack": 1, "fin": 2, "rst": 1, "ack": 4}
    e = stats.envelope(rows, "top-talkers", 1)
    assert e["rows"][0]["packets"] == 5 and e["rows_omitted"] == 1 and e["matched_packets"] == 8
    assert stats.count(rows, "https", F.col("dst_port") == 443).first()["packets"] == 3
    for style in ("table", "markdown", "csv", "json"):
        assert V4[0] in stats.render(e, style)
    ended = {(r["end_reason"], r["packets_ab"], r["packets_ba"]) for r in flows.sessionize(rows).collect()}
    assert ("tcp_fin", 3, 2) in ended and ("tcp_reset", 1, 0) in ended and len(ended) == 3


def simple_fold(rows, idle, active):
    """One pass over all packets in capture order, with a table of open flows: independent of the operator's code."""
    table, out, clock = {}, [], None

    def deadline(f):
        return min((f["start"] + active, "active_timeout"), (f["end"] + idle, "idle_timeout"), key=lambda x: x[0])

    def close(key, reason):
        f = table.pop(key)
        out.append((key, f["first"], f["fwd"], f["start"], f["end"], *f["packets"], *f["bytes"], *f["flags"], reason))

    def expire():
        for key in list(table):
            at, reason = deadline(table[key])
            if at <= clock:
                close(key, reason)

    for seq, key, us, fwd, size, flags, tcp_seq in rows:
        clock = us if clock is None else max(clock, us)
        expire()
        side, initial = int(not fwd), flags & 18 == 2 and tcp_seq is not None
        if initial and key in table:
            f = table[key]
            both, either = f["flags"][0] & f["flags"][1], f["flags"][0] | f["flags"][1]
            state = "reset" if either & 4 else "closed" if both & 1 else "half" if either & 1 else "open" if both & 2 and either & 16 else "syn" if either & 2 else "mid"
            if f["syns"][side] != tcp_seq if f["syns"][side] is not None else state in ("open", "mid", "half"):
                close(key, "tcp_reuse")
        f = table.setdefault(key, {"first": seq, "fwd": fwd, "start": us, "end": us, "packets": [0, 0], "bytes": [0, 0], "flags": [0, 0], "syns": [None, None]})
        if initial:
            f["syns"][side] = tcp_seq
        f["start"], f["end"] = min(f["start"], us), max(f["end"], us)
        f["packets"][side] += 1
        f["bytes"][side] += size
        f["flags"][side] |= flags
        if flags & 4:
            close(key, "tcp_reset")
        elif f["flags"][0] & f["flags"][1] & 1:
            close(key, "tcp_fin")
        expire()
    for key in list(table):
        close(key, "eof")
    return sorted(out)


@pytest.mark.parametrize("flags", [[2, 16, 16, 16, 17, 4, 18], [16, 24, 16, 16, 16, 16, 16, 16, 16, 17], [2, 18, 16, 16, 16, 16, 16, 16, 16, 16, 16]])
@pytest.mark.parametrize("hot", [False, True])
def test_sessions_equal_the_sequential_fold(spark, monkeypatch, flags, hot):
    """Also with keys so hot that they are cut by ranges of the capture."""
    if hot:
        monkeypatch.setattr(flows, "HOT", 100)
        monkeypatch.setattr(flows, "RANGE", 64)
    rng = Random(3)
    rows, us = [], 0
    for seq in range(1, 1500):
        us += rng.randrange(0, 4_000_000)
        rows.append((seq, rng.choice([0, 0, 0, 1, 2, 3, 4, 5]), max(0, us - rng.choice([0, 0, 0, 9_000_000])), rng.random() < 0.5, 100, rng.choice(flags), rng.randrange(3)))
    df = spark.createDataFrame(
        [(seq, f"10.0.0.{k if fwd else 200}", f"10.0.0.{200 if fwd else k}", 5, 5, "tcp", us, size, flags, tcp_seq, False) for seq, k, us, fwd, size, flags, tcp_seq in rows],
        "sequence long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, us long, original_len long, tcp_flags int, tcp_sequence long, fragmented boolean",
    )
    limits = flows.Timeouts(5_000_000, 5_000_000, 20_000_000)
    got = flows.sessionize(df.repartition(7), limits)
    cells = [x.split()[0] for x in flows.ENDED.split(", ")]
    have = sorted((int(r["a_ip"].split(".")[-1]), *[r[c] for c in cells]) for r in got.collect())
    assert have == simple_fold(rows, 5_000_000, 20_000_000)
    marks = flows.assign(df, limits)
    assert marks.count() == len(rows) and marks.select("first_sequence").distinct().count() == got.count()


@pytest.mark.parametrize("hot", [False, True])
def test_packets_of_one_sequence_need_no_order_of_the_input(spark, monkeypatch, hot):
    """The input comes in another order each time it is read, as blocks of a shuffle may."""
    if hot:
        monkeypatch.setattr(flows, "HOT", 100)
    second, rng = 1_000_000, Random(5)
    rows = [(1, 0, 1000 * second, True, 100, 16, None)]
    for k in range(1, 61):
        at = [rng.choice([100, 985, 990, 996, 998]) for _ in range(rng.randrange(2, 5))]
        rows += [(k + 1 + n // 3, k, t * second, rng.random() < 0.5, 100 + n, rng.choice([16, 16, 4, 17]), None) for n, t in enumerate(at)]
    rows.sort(key=lambda r: (r[0], *r[2:6]))

    def shuffled(batches):
        for pdf in batches:
            yield pdf.sample(frac=1)

    df = spark.createDataFrame(
        [(seq, f"10.0.0.{k if fwd else 200}", f"10.0.0.{200 if fwd else k}", 5, 5, "tcp", us, size, flags, tcp_seq, False) for seq, k, us, fwd, size, flags, tcp_seq in rows],
        "sequence long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, us long, original_len long, tcp_flags int, tcp_sequence long, fragmented boolean",
    ).coalesce(1)
    df = df.mapInPandas(shuffled, df.schema)
    cells = [x.split()[0] for x in flows.ENDED.split(", ")]
    want = simple_fold(rows, 5 * second, 20 * second)
    for _ in range(2):
        got = flows.sessionize(df, flows.Timeouts(5 * second, 5 * second, 20 * second))
        assert sorted((int(r["a_ip"].split(".")[-1]), *[r[c] for c in cells]) for r in got.collect()) == want


@pytest.mark.parametrize(("times", "ends"), [([0, 4, 8, 12, 17], ["active_timeout", "idle_timeout", "eof"]), ([20, 10, 15], ["eof"])])
def test_timeouts(times, ends):
    rows = [(k + 1, 0, t * 1_000_000, True, 1, 16, None) for k, t in enumerate(times)]
    got = simple_fold(rows, 5_000_000 if len(times) == 5 else 60_000_000, 12_000_000 if len(times) == 5 else 300_000_000)
    assert [x[-1] for x in got] == ends
    if len(times) == 3:
        assert got[0][3:5] == (10_000_000, 20_000_000)


def test_syn_reuse():
    rows = [(k + 1, 0, k, True, 1, 2, s) for k, s in enumerate([100, 100, 900])]
    got = simple_fold(rows, 60_000_000, 300_000_000)
    assert [(x[1], x[-1]) for x in got] == [(1, "tcp_reuse"), (3, "eof")]


def template(version, id_=256):
    fields = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4)]
    body = struct.pack(">HH", id_, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)
    return struct.pack(">HH", 0 if version == 9 else 2, 4 + len(body)) + body


RECORD = bytes((192, 0, 2, 1, 198, 51, 100, 2)) + struct.pack(">HHBII", 1234, 443, 6, 1024, 8)
DATA = struct.pack(">HH", 256, 4 + len(RECORD) + 3) + RECORD + bytes(3)


def export(version, sequence, *sets, uptime=1000):
    body = b"".join(sets)
    if version == 9:
        return struct.pack(">HHIIII", 9, len(sets), uptime, 1_700_000_000, sequence, 1) + body
    return struct.pack(">HHIII", 10, 16 + len(body), 1_700_000_000, sequence, 1) + body


@pytest.mark.parametrize("version", [9, 10])
def test_templates_and_sequences(spark, version):
    datagrams = [export(version, 0, DATA), export(version, 1 if version == 9 else 0, template(version), DATA), export(version, 5, DATA), export(version, 6, struct.pack(">HH", 99, 4))]
    df = spark.createDataFrame([("e:1", k, bytearray(d)) for k, d in enumerate(datagrams)], "exporter string, arrival long, data binary")
    rows = netflow.decode_datagrams(df).orderBy("arrival").collect()
    flows_ = [r for r in rows if r["kind"] == "flow.export"]
    assert len(flows_) == 2 and (flows_[0]["dst_port"], flows_[0]["bytes"], flows_[0]["packets"]) == (443, 1024, 8)
    assert [r["code"] for r in rows if r["kind"] == "notice.export"] == ["TEMPLATE", "SEQUENCE"]
    assert [r["kind"] for r in rows if r["arrival"] == 3] == ["anomaly.export"]
    assert ingest.export_rows(netflow.decode_datagrams(df), "s").where("event_type = 'flow.export'").first()["proto"] == "tcp"


def test_many_sessions_share_a_task(spark, monkeypatch):
    """Sessions that go on from batch to batch, many in a task: none costs a call of its own, none sees the templates of another."""
    monkeypatch.setattr(netflow, "ROWS", 3)
    sent = [(f"e:{e}", k, bytearray(export(9, k, DATA) if k or e % 2 else export(9, k, template(9), DATA))) for k in range(5) for e in range(40)]
    df = spark.createDataFrame(sent, "exporter string, arrival long, data binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = netflow.decode_datagrams(df)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = lambda kind: sorted((r["exporter"], r["arrival"]) for r in rows if r["kind"] == kind)
    assert by("flow.export") == sorted((f"e:{e}", k) for e in range(0, 40, 2) for k in range(5))
    assert by("notice.export") == sorted((f"e:{e}", k) for e in range(1, 40, 2) for k in range(5))
    flow, notice = (next(r for r in rows if r["kind"] == kind) for kind in ("flow.export", "notice.export"))
    assert [f["id"] for f in flow["fields"]] and all(len(f["value"]) for f in flow["fields"]) and notice["fields"] is None


def test_version_five_and_restart(spark):
    record = bytes((192, 0, 2, 1, 198, 51, 100, 2)) + bytes(4) + struct.pack(">HHIIII", 0, 0, 10, 1000, 500, 900) + struct.pack(">HHBBBB", 1234, 443, 0, 24, 6, 0) + bytes(8)
    v5 = struct.pack(">HHIIIIBBH", 5, 1, 1000, 1_700_000_000, 0, 42, 0, 0, 100) + record
    df = spark.createDataFrame([("e:1", 0, bytearray(v5))], "exporter string, arrival long, data binary")
    r = netflow.decode_v5_datagrams(df).first()
    assert (r["sequence"], r["sampling_interval"], r["bytes"], r["dst_port"], r["start_ms"], r["end_ms"]) == (42, 100, 1000, 443, 1_699_999_999_500, 1_699_999_999_900)
    s = netflow.Session()
    netflow.decode(s, export(9, 0, template(9)), 0)
    assert [c for c, _ in netflow.decode(s, export(9, 1, DATA, uptime=10), 1).notices] == ["RESTART", "TEMPLATE"]
    netflow.decode(s, export(9, 2, template(9), uptime=11), 2)
    assert not s.templates == {} and netflow.decode(s, export(9, 3, DATA, uptime=12), 2 + netflow.TTL_SECONDS).flows == []


def test_export_roundtrip(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(EXAMPLE, nano=True))
    rows = P.read(spark, str(tmp_path / "a.pcap"))
    assert P.export(rows.where("sequence in (2, 5)"), str(tmp_path / "b.pcap")) == 2
    assert [r[7] for r in P.records((tmp_path / "b.pcap").read_bytes())] == [EXAMPLE[1], EXAMPLE[4]]
    with pytest.raises(FileExistsError):
        P.export(rows, str(tmp_path / "b.pcap"))
    assert P.counters(decode.decode_records(rows)) == {"records": 6, "ip_packets": 6, "skipped_non_ip": 0}
    assert V6[0] in {r["src_ip"] for r in decode.decode_records(rows).collect()}
