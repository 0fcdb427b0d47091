"""Indicator and rule matches, change notices, and the gate that keeps notices few.

Indicators: (kind, value, source, severity); exact ones join on the normal value, blocks on ranges of address keys. Rules:
(id, event_type, field, equals, message, severity). Both tables are small by contract (their sizes are checked) and
are broadcast; the events never move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.errors import WirelakeError
from wirelake.functions import net
from wirelake.functions.tables import written

#: Limits of a feed, and of the findings of an event.
MAX_INDICATORS, MAX_BLOCKS, MAX_RULES, MAX_SOURCES, MAX_FINDINGS = 65_536, 512, 256, 8, 128
SEVERITIES = ("info", "warning", "high", "critical")
RULE_FIELDS = ("src.ip", "dst.ip", "domain", "sha256", "anomaly.code", "proto")


def indicators(feed: DataFrame) -> DataFrame:
    """The feed with normal values; bad entries, or too many, are errors. It is read once, and has at most MAX_INDICATORS rows."""
    kind, value = F.col("kind"), F.col("value")
    normal = (
        F.when(kind == "ip", net.ip_key(value))
        .when(kind == "domain", net.domain(value))
        .when(kind == "url", net.url(value))
        .when((kind == "sha256") & value.rlike("^[0-9a-fA-F]{64}$"), F.lower(value))
        .when((kind == "cidr") & net.ip_key(F.substring_index(value, "/", 1)).isNotNull(), value)
    )
    out = feed.select("kind", normal.alias("match"), "source", F.coalesce("severity", F.lit("warning")).alias("severity"))
    rows = out.limit(MAX_INDICATORS + 1).collect()
    if len(rows) > MAX_INDICATORS or sum(r["kind"] == "cidr" for r in rows) > MAX_BLOCKS:
        raise WirelakeError(f"a feed has at most {MAX_INDICATORS} indicators, {MAX_BLOCKS} of them blocks")
    for r in rows:
        if r["match"] is None or r["severity"] not in SEVERITIES or r["source"] is None or not 1 <= len(r["source"]) <= 256:
            raise WirelakeError(f"a bad indicator: {r.asDict()}")
    if max(Counter((r["kind"], r["match"]) for r in rows if r["kind"] != "cidr").values(), default=0) > MAX_SOURCES:
        raise WirelakeError(f"at most {MAX_SOURCES} sources an indicator")
    return feed.sparkSession.createDataFrame(rows, out.schema)


def field_values(events: DataFrame, fields: set[str]) -> Column:
    """(field, kind, value, match) of what an observation can be matched by in ``fields``, in field order; the payload is read only if one
    of them is in it."""
    one = lambda field, kind, value, match: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), value.alias("value"), match.alias("match"))
    p = F.from_json("payload", "protocol struct<server_name:string,host:string,target:string,sha256:string>, anomaly struct<code:string>, dns struct<questions:array<struct<name:string>>>")
    target = F.concat(F.lit("http://"), p["protocol"]["host"], p["protocol"]["target"])
    known = {
        "anomaly.code": lambda: one("anomaly.code", "anomaly.code", p["anomaly"]["code"], p["anomaly"]["code"]),
        "dst.ip": lambda: one("dst.ip", "ip", F.col("dst_ip"), net.ip_key(F.col("dst_ip"))),
        "proto": lambda: one("proto", "proto", F.col("proto"), F.col("proto")),
        "sha256": lambda: one("sha256", "sha256", p["protocol"]["sha256"], F.lower(p["protocol"]["sha256"])),
        "src.ip": lambda: one("src.ip", "ip", F.col("src_ip"), net.ip_key(F.col("src_ip"))),
        "url": lambda: one("url", "url", target, net.url(target)),
    }
    out = F.array(*[make() for field, make in known.items() if field in fields])
    if "domain" in fields:
        questions = F.transform(F.slice(F.coalesce(p["dns"]["questions"], F.array().cast("array<struct<name:string>>")), 1, 256), lambda q: q["name"])
        names = F.concat(questions, F.array(p["protocol"]["server_name"], p["protocol"]["host"]))
        domains = F.transform(names, lambda n: one("domain", "domain", n, net.domain(n)))
        out = F.array_sort(F.concat(out, domains)) if len(fields) > 1 else domains
    return F.filter(out, lambda v: v["match"].isNotNull())


#: Fields that an indicator of a kind is looked for in.
FIELDS_OF = {"ip": ("src.ip", "dst.ip"), "cidr": ("src.ip", "dst.ip"), "domain": ("domain",), "url": ("url",), "sha256": ("sha256",)}


def findings(events: DataFrame, feed: DataFrame | None, rules: DataFrame | None = None, feed_version: str = "", rules_version: str = "") -> DataFrame:
    """event_id, event_type (intel.match or notice.policy), severity, by, version, field, value, message; exact matches, then
    blocks, then rules, MAX_FINDINGS an event at most. Only fields that the feed or the rules ask for are looked at."""
    known = indicators(feed).collect() if feed is not None else []  # MAX_INDICATORS rows at most
    own = rules.limit(MAX_RULES + 1).collect() if rules is not None else []
    if len(own) > MAX_RULES or any(r["field"] not in RULE_FIELDS or r["severity"] not in SEVERITIES for r in own):
        raise WirelakeError(f"at most {MAX_RULES} rules, on {', '.join(RULE_FIELDS)}")
    spark = events.sparkSession
    fields = {f for r in known for f in FIELDS_OF[r["kind"]]} | {r["field"] for r in own}
    values = events.select("event_id", F.col("event_type").alias("_type"), F.explode(field_values(events, fields) if fields else F.array().cast("array<struct<field:string,kind:string,value:string,match:string>>")).alias("_v")).select("event_id", "_type", "_v.*")
    kinds = "event_id string, event_type string, severity string, by string, field string, value string, _order int"
    out = spark.createDataFrame([], kinds)
    if exact := [(r["kind"], r["match"], r["source"], r["severity"]) for r in known if r["kind"] != "cidr"]:
        table = F.broadcast(spark.createDataFrame(exact, "kind string, match string, by string, severity string"))
        out = out.unionByName(values.join(table, ["kind", "match"]).select("event_id", F.lit("intel.match").alias("event_type"), "severity", "by", "field", "value", F.lit(0).alias("_order")))
    if ranges := [(*net.cidr_keys(r["match"]), r["source"], r["severity"]) for r in known if r["kind"] == "cidr"]:
        table = F.broadcast(spark.createDataFrame(ranges, "lo string, hi string, by string, severity string"))
        # At most MAX_BLOCKS ranges; most values lie in none of them and go before the join.
        near = values.where(F.col("match").between(min(r[0] for r in ranges), max(r[1] for r in ranges)))
        inside = near.where("kind = 'ip'").join(table, F.col("match").between(F.col("lo"), F.col("hi")))
        out = out.unionByName(inside.select("event_id", F.lit("intel.match").alias("event_type"), "severity", "by", "field", "value", F.lit(1).alias("_order")))
    if own:
        table = F.broadcast(rules.select(F.col("event_type").alias("_of"), F.col("field").alias("_field"), "equals", F.col("id").alias("by"), "severity"))
        hit = values.join(table, (F.col("field") == F.col("_field")) & (F.col("value") == F.col("equals")) & ((F.col("_of") == "*") | (F.col("_of") == F.col("_type"))))
        out = out.unionByName(hit.select("event_id", F.lit("notice.policy").alias("event_type"), "severity", "by", "field", "value", F.lit(2).alias("_order")).distinct())
    order = F.row_number().over(W.partitionBy("event_id").orderBy("_order", "field", "value", "by"))
    version = F.when(F.col("event_type") == "intel.match", F.lit(feed_version)).otherwise(F.lit(rules_version))
    return out.withColumn("_n", order).where(F.col("_n") <= MAX_FINDINGS).withColumn("version", version).drop("_n", "_order")


def derived(events: DataFrame, found: DataFrame, stage: str = "finding") -> DataFrame:
    """Observations of the findings: the parent's row with counters null, so that sums count nothing twice."""
    rows = events.join(found.withColumnRenamed("event_type", "_new"), "event_id")
    extra = [c for c in found.columns if c not in ("event_id", "event_type")]
    payload = F.to_json(F.struct(F.col("event_id").alias("source_event_id"), *extra))
    new_id = net.identity(F.lit(stage), F.col("event_id"), payload)
    none = F.lit(None).cast("bigint")
    changed = {"event_id": new_id, "event_type": F.col("_new"), "packets": none, "bytes": none, "payload": payload}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in events.columns])


def notice_gate(notices: DataFrame, keys: list[str], time: str = "timestamp_ms", order: list[str] = ("event_id",), quiet_ms: int = 60_000, per_second: int = 100) -> DataFrame:
    """``notices`` with passed: false if the same key passed within the quiet time before, or the second is full.

    By event time. Only what passes begins a quiet time. A key's notices are cut into pieces where the gap to the one before is the quiet
    time or more, and each piece is walked in order by itself, a row at a time. If that fills no second, this is the result. A second
    that is full refuses notices, which then begin no quiet time, so that keys depend on each other: then blocks of seconds are walked
    (``_gated``).
    """
    rows = written(_with_pieces(notices, keys, time, quiet_ms), "notices")
    marked = written(_walked(rows, keys, time, order, quiet_ms), "notices-walked")
    full = marked.where("_new").groupBy(F.floor(F.col(time) / 1000)).count().where(F.col("count") > per_second)
    if full.isEmpty():
        return marked.select(*notices.columns, F.col("_new").alias("passed"))
    passed = _gated(rows, keys, time, order, quiet_ms, per_second).withColumn("passed", F.lit(True))
    return rows.join(passed, "_row", "left").select(*notices.columns, F.coalesce("passed", F.lit(False)).alias("passed"))


#: Candidates of a block of seconds, about.
BLOCK = 250_000


def _gated(rows: DataFrame, keys: list[str], time: str, order: list[str], quiet_ms: int, per_second: int) -> DataFrame:
    """The _row of what passes, where seconds are full.

    Whole seconds make blocks, which are all walked at once, each as if no key were quiet when it begins. A block whose
    keys were quiet, as the end of the block before says, is walked again from there, until all fit together: each round settles
    one block or more. Of notices of one key and time only the first can pass.
    """
    known = [f"_k{i}" for i in range(len(keys))]
    named = rows.where(F.col(time).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, known, strict=True)], F.col(time).alias("_time"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "_row").alias("_at"))
    if quiet_ms > 0:
        named = named.groupBy(*known, "_time").agg(F.min("_at").alias("_at"))
    found = written(named.withColumn("_second", F.floor(F.col("_time") / 1000)), "notices-first")
    n = max(1, -(-found.count() // BLOCK))
    blocks = written(found.repartitionByRange(n, "_second").withColumn("_block", F.spark_partition_id()), "notices-blocks")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    ids = sorted(r["_block"] for r in blocks.select("_block").distinct().collect())
    nothing = F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = second = top = None
        used, last = 0, {}

        def ended() -> list[tuple]:
            return [(block, None, *k, at) for k, at in last.items() if top is None or at + quiet_ms > top]

        def shown(out: list[tuple]) -> pa.RecordBatch:
            names = ["_block", "_row", *known, "_time"]
            like = {f.name: f.type for f in batch.schema}
            return pa.RecordBatch.from_arrays([pa.array(c, like[x]) for x, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

        for batch in batches:
            out = []
            columns = {c: batch.column(c).to_pylist() for c in ("_block", "_row", "_second", "_time")}
            for b, row, s, at, *key in zip(*columns.values(), *[batch.column(c).to_pylist() for c in known], strict=True):
                if b != block:
                    out += ended()
                    block, second, top, last = b, None, None, {}
                key = tuple(key)
                if row is None:  # quiet since a block before
                    last[key] = at
                    continue
                top = at
                if s != second:
                    second, used = s, 0
                if used < per_second and (key not in last or at - last[key] >= quiet_ms):
                    used += 1
                    last[key] = at
                    out.append((b, row, *[None] * len(known), None))
            if out:
                yield shown(out)
        if out := ended():
            yield shown(out)

    schema = ", ".join(["_block int", "_row long", *[f"{k} {kinds[k]}" for k in known], f"_time {kinds['_time']}"])
    told: dict[int, tuple] = dict.fromkeys(ids, (0, None))  # what a block was told of the one before
    ends, source, again, rounds = {}, {}, ids, []
    while again:
        part = blocks.where(F.col("_block").isin(again)).select("_block", "_at._row", "_second", "_time", *known, "_at")
        for r in {source[ids[ids.index(b) - 1]] for b in again if told[b][0]}:
            follows = {ids[ids.index(b) - 1]: b for b in again if told[b][0] and source[ids[ids.index(b) - 1]] == r}
            next_ = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])[F.col("_block")]
            state = rounds[r].where(F.col("_row").isNull() & F.col("_block").isin(*follows))
            part = part.unionByName(state.select(next_.alias("_block"), nothing.cast("bigint").alias("_row"), nothing.cast("bigint").alias("_second"), "_time", *known, nothing.cast(kinds["_at"]).alias("_at")))
        placed = part.repartition(len(again), "_block").sortWithinPartitions("_block", F.col("_second").asc_nulls_first(), "_time", "_at").drop("_at")
        rounds.append(written(placed.mapInArrow(run, schema), "notices-gated"))
        source |= dict.fromkeys(again, len(rounds) - 1)
        sums = rounds[-1].where("_row is null").groupBy("_block").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*known, "_time").cast("decimal(38,0)")).alias("h")).collect()
        ends |= dict.fromkeys(again, (0, None)) | {r["_block"]: (r["n"], r["h"]) for r in sums}
        again = [b for a, b in zip(ids, ids[1:], strict=False) if told[b] != ends[a]]
        told |= {b: ends[ids[ids.index(b) - 1]] for b in again}
    out = [df.where(F.col("_row").isNotNull() & F.col("_block").isin([b for b in ids if source[b] == r])).select("_row") for r, df in enumerate(rounds)]
    return reduce(DataFrame.unionByName, out)


def _with_pieces(notices: DataFrame, keys: list[str], time: str, quiet_ms: int) -> DataFrame:
    """``notices`` with _row, a number of their own, and _piece.

    Found from the first and last time of each key in each stretch of the quiet time: a stretch is part of the piece before if the
    gap between is shorter. Within a stretch no gap can be longer.
    """
    rows = notices.withColumns({"_row": F.monotonically_increasing_id(), "_stretch": F.floor(F.col(time) / max(1, quiet_ms))})
    ends = rows.groupBy(*keys, "_stretch").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    by = W.partitionBy(*keys).orderBy("_stretch")  # of a key as many rows as it has stretches
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(by) >= quiet_ms, F.lit(True)).cast("int")
    pieces = ends.withColumn("_opens", opens).withColumn("_piece", F.sum("_opens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    there = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_stretch").alias("_s"), "_piece")
    on = rows["_stretch"].eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(F.col(f"_k{i}"))
    return rows.join(there, on).select(*notices.columns, "_row", "_piece")


def _walked(rows: DataFrame, keys: list[str], time: str, order: list[str], quiet_ms: int) -> DataFrame:
    """``rows`` with _new: whether their key is not quiet."""
    whole = [*keys, "_piece"]
    placed = rows.withColumn("_cell", F.xxhash64(*whole)).repartition("_cell").sortWithinPartitions("_cell", *whole, time, *order, "_row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = last = None
        for pdf in batches:
            new = []
            for key, at in zip(pdf[whole].itertuples(index=False), pdf[time], strict=True):
                key = tuple(None if k is None or k != k else k for k in key)
                if key != cell:
                    cell, last = key, None
                fits = at == at and at is not None and (last is None or at - last >= quiet_ms)
                new.append(fits)
                if fits:
                    last = at
            yield pdf.drop(columns=["_cell"]).assign(_new=new)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return placed.select(*rows.columns, "_cell").mapInPandas(run, f"{kinds}, _new boolean")


def suppressed(gated: DataFrame) -> DataFrame:
    """One row with the number of notices that did not pass, if there are any."""
    return gated.agg(F.count_if(~F.col("passed")).alias("suppressed")).where("suppressed > 0")


def rrsets(events: DataFrame) -> DataFrame:
    """(rrset, timestamp_ms, event_id, values): the sorted distinct values of each record set in each DNS response."""
    answers = F.from_json("payload", "dns struct<answers:array<struct<name:string,class:int,rr_type:int,data:string>>>")["dns"]["answers"]
    rows = events.where(F.col("event_type") == "dns.response").select("event_id", "timestamp_ms", "sensor", F.explode(answers).alias("_a"))
    key = F.concat_ws(":", F.lower(F.col("_a.name")), F.col("_a.rr_type").cast("string"), F.col("_a.class").cast("string"))
    return rows.groupBy("event_id", "timestamp_ms", "sensor", key.alias("rrset")).agg(F.array_sort(F.collect_set("_a.data")).alias("values"))


def changes(sets: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value is another than the one before of the same key, with ``previous``."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return sets.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))
