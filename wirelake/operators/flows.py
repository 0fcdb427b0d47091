"""Bidirectional flows with idle and active timeouts, TCP closes and reuse.

A flow's fold depends on other flows only through the watermark, the greatest time seen so far in capture order. So
the watermark at each packet is computed first (in ranges of the sequence, each led by the maximum of those before, never in one task), and every key folds by itself, cut into runs: a packet that follows the one before it in its key by the idle time
or more, with the watermark past both, always opens a flow. A key of more than ``HOT`` packets (one may hold a third of them) is cut into
the same ranges before it is sorted, and its ranges carry over what they need.

Most runs are one flow, which sums say of them: no connection is reset, closed or opened inside, and the active time does not end there.
These are aggregated. Only the packets of the other runs are folded one by one, in tasks that hold one open flow.

Packets of one sequence come in the order of all else that the fold sees of them, so that runs are the same however often and from
whatever order of the input they are computed. Runs that hold such packets are folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.functions import net
from wirelake.functions.tables import written

FIN, SYN, RST, ACK = 1, 2, 4, 16


@dataclass(frozen=True)
class Timeouts:
    """Microseconds."""

    tcp_idle: int = 120_000_000
    udp_idle: int = 30_000_000
    active: int = 300_000_000

    def idle(self, proto: str) -> int:
        return self.tcp_idle if proto == "tcp" else self.udp_idle


KEY = ("a_ip", "a_port", "b_ip", "b_port", "proto", "section", "interface", "vlans")


def with_flow_key(packets: DataFrame) -> DataFrame:
    """The canonical key: the smaller endpoint (by typed address, then port) is a; ``forward`` is a to b."""
    src, dst = F.struct(net.ip_key(F.col("src_ip")).alias("k"), F.col("src_port").alias("p")), F.struct(net.ip_key(F.col("dst_ip")).alias("k"), F.col("dst_port").alias("p"))
    forward = src <= dst
    have = set(packets.columns)
    pick = lambda x, y: F.when(F.col("forward"), F.col(x)).otherwise(F.col(y))
    out = packets.withColumn("forward", forward)
    return out.withColumns(
        {
            "a_ip": pick("src_ip", "dst_ip"),
            "a_port": pick("src_port", "dst_port"),
            "b_ip": pick("dst_ip", "src_ip"),
            "b_port": pick("dst_port", "src_port"),
            "section": F.col("section") if "section" in have else F.lit(0),
            "interface": F.col("interface") if "interface" in have else F.lit(0),
            "vlans": F.col("vlans") if "vlans" in have else F.array().cast("array<int>"),
            "source": F.col("source") if "source" in have else F.lit(""),
        }
    )


#: Packets of a key from which on it is cut before it is sorted; packets of a range of the capture order; ranges up to which what they begin
#: with is broadcast.
HOT, RANGE, BROADCAST_RANGES = 1_000_000, 16_384, 100_000


#: After sequence and time, what orders packets of one sequence of a key.
_TIES = ("forward", "original_len", "tcp_flags", "tcp_sequence")


def range_of(width: int | None = None) -> Column:
    return F.floor(F.col("sequence") / (width or RANGE)).cast("bigint")


def capture_ranges(packets: DataFrame, time: str = "us") -> tuple[DataFrame, int]:
    """(source, _range, _before, wm_end), to be joined: the greatest time before each range and of all; and the number of packets."""
    tops = packets.groupBy("source", range_of().alias("_range")).agg(F.max(time).alias("_top"), F.count("*").alias("_n"))
    few = tops.limit(BROADCAST_RANGES + 1).collect()
    if len(few) > BROADCAST_RANGES:
        by = W.partitionBy("source")
        return tops.select("source", "_range", F.max("_top").over(by.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.max("_top").over(by).alias("wm_end")), HOT + 1
    rows, before, end = [], {}, {}
    for r in few:
        if r["_top"] is not None:
            end[r["source"]] = max(end.get(r["source"], r["_top"]), r["_top"])
    for r in sorted(few, key=lambda r: r["_range"]):
        known = before.get(r["source"])
        rows.append((r["source"], r["_range"], known, end.get(r["source"])))
        if r["_top"] is not None:
            before[r["source"]] = r["_top"] if known is None else max(known, r["_top"])
    return F.broadcast(packets.sparkSession.createDataFrame(rows, "source string, _range bigint, _before bigint, wm_end bigint")), sum(r["_n"] for r in few)


def with_watermark(packets: DataFrame, time: str = "us", ranges: DataFrame | None = None) -> DataFrame:
    """``packets`` with wm, the greatest time up to each in capture order of its source, wm_end, the greatest of all, and _range.

    Sequences are cut into equal ranges; a range's own running maximum joins the maximum of those before it.
    """
    found = ranges if ranges is not None else capture_ranges(packets, time)[0]
    rows = packets.withColumn("_range", range_of()).join(found, ["source", "_range"])
    own = W.partitionBy("source", "_range").orderBy("sequence", time).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("wm", F.greatest(F.max(time).over(own), F.col("_before"))).drop("_before")


@dataclass
class Flow:
    """One instance while it is open."""

    first: int
    forward: bool
    start: int
    end: int
    syns: list[int | None] = field(default_factory=lambda: [None, None])
    packets: list[int] = field(default_factory=lambda: [0, 0])
    bytes: list[int] = field(default_factory=lambda: [0, 0])
    flags: list[int] = field(default_factory=lambda: [0, 0])

    def deadline(self, idle: int, active: int) -> tuple[int, str]:
        at, limit = self.end + idle, self.start + active
        return (limit, "active_timeout") if limit <= at else (at, "idle_timeout")

    def reused_by(self, side: int, sequence: int) -> bool:
        """Whether an initial SYN of that side belongs to a new connection."""
        known, a, b = self.syns[side], *self.flags
        if known is not None:
            return known != sequence
        if (a | b) & RST or a & b & FIN:
            return False
        return bool((a | b) & FIN or not (a | b) & SYN or a & b & SYN and (a | b) & ACK)

    def row(self, reason: str) -> tuple:
        return (self.first, self.forward, self.start, self.end, *self.packets, *self.bytes, *self.flags, reason)


ENDED = "first_sequence long, initiator_forward boolean, start_us long, end_us long, packets_ab long, packets_ba long, bytes_ab long, bytes_ba long, flags_ab int, flags_ba int, end_reason string"


class Folder:
    """The fold of one key; packets come in capture order. Pure Python, shared by batch and stream."""

    def __init__(self, proto: str, timeouts: Timeouts) -> None:
        self.tcp, self.idle, self.active = proto == "tcp", timeouts.idle(proto), timeouts.active
        self.flow: Flow | None = None

    def expire(self, wm: int | None) -> Iterator[tuple]:
        if self.flow is not None and wm is not None:
            at, reason = self.flow.deadline(self.idle, self.active)
            if at <= wm:
                yield self.flow.row(reason)
                self.flow = None

    def packet(self, sequence: int, us: int, wm: int, forward: bool, size: int, flags: int | None, tcp_sequence: int | None) -> Iterator[tuple]:
        """Flows that end before or with the packet; ``last`` is then the packet's instance."""
        yield from self.expire(wm)
        flags, side = flags or 0, 0 if forward else 1
        opens = self.tcp and flags & (SYN | ACK) == SYN and tcp_sequence is not None
        if opens and self.flow is not None and self.flow.reused_by(side, tcp_sequence):
            yield self.flow.row("tcp_reuse")
            self.flow = None
        if self.flow is None:
            self.flow = Flow(sequence, forward, us, us)
        f = self.flow
        if opens:
            f.syns[side] = tcp_sequence
        f.start, f.end = min(f.start, us), max(f.end, us)
        f.packets[side] += 1
        f.bytes[side] += size
        f.flags[side] |= flags
        self.last = f.first
        if self.tcp and flags & RST:
            yield f.row("tcp_reset")
            self.flow = None
        elif self.tcp and f.flags[0] & FIN and f.flags[1] & FIN:
            yield f.row("tcp_fin")
            self.flow = None
        yield from self.expire(wm)

    def finish(self, wm: int | None) -> Iterator[tuple]:
        yield from self.expire(wm)
        if self.flow is not None:
            yield self.flow.row("eof")
            self.flow = None


def foldable(packets: DataFrame, time: str = "us") -> tuple[DataFrame, int]:
    """Packets that take part in flows, keyed, with watermark and the last watermark of their source; and the number of all."""
    keyed = with_flow_key(packets)
    ranges, n = capture_ranges(keyed, time)
    rows = with_watermark(keyed, time, ranges)
    rows = rows.where(~F.coalesce("fragmented", F.lit(False)) & F.col("proto").isin("tcp", "udp") & F.col(time).isNotNull())
    if "tcp_sequence" not in rows.columns:
        rows = rows.withColumn("tcp_sequence", F.lit(None).cast("long"))
    return rows, n


def with_runs(rows: DataFrame, timeouts: Timeouts, time: str = "us", hot: int | None = None) -> DataFrame:
    """``rows`` with run, and tied: between two runs of a key, no flow can go on; a tied packet has the sequence of the one before it in its key.

    What is open before a packet ends by the idle time after the greatest time of its key so far; if the watermark at the
    packet has passed that, the packet begins a run. Keys of more than ``hot`` rows are cut by _range.
    """
    if hot is None:
        return _cut(rows.withColumns({"_part": F.lit(0), "_carried": F.lit(None).cast("long"), "_runs": F.lit(0).cast("long")}), timeouts, time)
    rows = rows.withColumn("_key", F.xxhash64("source", *[F.col(c) if c != "vlans" else F.array_join(F.transform("vlans", lambda v: v.cast("string")), ",") for c in KEY]))
    crowded = rows.groupBy("_key").count().where(F.col("count") > hot).select("_key", F.lit(True).alias("_hot"))
    rows = rows.join(crowded, "_key", "left").withColumn("_part", F.when(F.col("_hot"), F.col("_range")).otherwise(-1)).drop("_hot")
    where = ["source", *KEY, "_part"]
    earlier = W.partitionBy("source", *KEY).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a key's ranges: as many rows as there are ranges
    tops = rows.where("_part >= 0").groupBy(*where).agg(F.max(time).alias("_top"))
    carried = tops.select(*where, F.max("_top").over(earlier).alias("_carried"))
    rows = rows.join(carried, where, "left")
    breaks = _cut(rows.withColumn("_runs", F.lit(0).cast("long")), timeouts, time)
    counts = breaks.where("_part >= 0").groupBy(*where).agg(F.max("run").alias("_last"))
    return breaks.join(counts.select(*where, F.sum("_last").over(earlier).alias("_runs")), where, "left").withColumn("run", F.col("run") + F.coalesce("_runs", F.lit(0))).drop("_key", "_part", "_runs")


def _cut(rows: DataFrame, timeouts: Timeouts, time: str) -> DataFrame:
    idle = F.when(F.col("proto") == "tcp", F.lit(timeouts.tcp_idle)).otherwise(F.lit(timeouts.udp_idle))
    by = W.partitionBy("source", *KEY, "_part").orderBy("sequence", time, *_TIES)  # packets of one sequence are of one part
    latest = F.greatest(F.max(time).over(by.rowsBetween(W.unboundedPreceding, -1)), F.col("_carried"))
    breaks = F.coalesce(latest + idle <= F.col("wm"), F.lit(True))
    tied = F.coalesce(F.lag("sequence").over(by) == F.col("sequence"), F.lit(False))
    return rows.withColumns({"_break": breaks.cast("int"), "tied": tied}).withColumn("run", F.sum("_break").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_break", "_carried", "_runs")


def run_sums(rows: DataFrame, timeouts: Timeouts, time: str = "us") -> DataFrame:
    """For each run the flow that it is, if it is one, and plain: whether it is.

    A run is one flow unless a reset or the second side's FIN comes before its last packet, a connection is opened elsewhere than
    by its first packet (repeated alike perhaps), the active time may end before its last packet, or packets of it are tied.
    """
    way, us, seq = F.col("forward"), F.col(time), F.col("sequence")
    flags, tcp = F.coalesce("tcp_flags", F.lit(0)), F.col("proto") == "tcp"
    bit = lambda b: tcp & (flags.bitwiseAND(F.lit(b)) != 0)
    opens = tcp & (flags.bitwiseAND(F.lit(SYN | ACK)) == SYN) & F.col("tcp_sequence").isNotNull()
    opened = F.when(opens, F.struct(way.alias("w"), F.col("tcp_sequence").alias("s")))
    out = rows.groupBy("source", *KEY, "run").agg(
        F.min(seq).alias("first_sequence"),
        F.min_by(way, seq).alias("initiator_forward"),
        F.min(us).alias("start_us"),
        F.max(us).alias("end_us"),
        F.count_if(way).alias("packets_ab"),
        F.count_if(~way).alias("packets_ba"),
        F.coalesce(F.sum(F.when(way, F.col("original_len"))), F.lit(0)).cast("bigint").alias("bytes_ab"),
        F.coalesce(F.sum(F.when(~way, F.col("original_len"))), F.lit(0)).cast("bigint").alias("bytes_ba"),
        F.coalesce(F.bit_or(F.when(way, flags)), F.lit(0)).alias("flags_ab"),
        F.coalesce(F.bit_or(F.when(~way, flags)), F.lit(0)).alias("flags_ba"),
        F.max(seq).alias("_last"),
        F.max("wm").alias("_wm"),
        F.max("tied").alias("_tied"),
        F.max("wm_end").alias("_end"),
        F.min(F.when(bit(RST), seq)).alias("_reset"),
        F.min(F.when(bit(FIN) & way, seq)).alias("_fin_ab"),
        F.min(F.when(bit(FIN) & ~way, seq)).alias("_fin_ba"),
        F.min(F.when(opens, seq)).alias("_first_open"),
        F.min(opened).alias("_open_lo"),
        F.max(opened).alias("_open_hi"),
    )
    fin = F.when(F.col("_fin_ab").isNotNull() & F.col("_fin_ba").isNotNull(), F.greatest("_fin_ab", "_fin_ba"))
    ends_last = lambda at: at.isNull() | (at == F.col("_last"))
    opens_first = F.col("_first_open").isNull() | (F.col("_first_open") == F.col("first_sequence")) & (F.col("_open_lo") == F.col("_open_hi"))
    plain = ends_last(F.col("_reset")) & ends_last(fin) & opens_first & (F.col("start_us") + timeouts.active > F.col("_wm")) & ~F.col("_tied")
    idle = F.when(tcp, F.lit(timeouts.tcp_idle)).otherwise(F.lit(timeouts.udp_idle))
    at_idle, at_active = F.col("end_us") + idle, F.col("start_us") + timeouts.active
    reason = (
        F.when(F.col("_reset").isNotNull(), "tcp_reset").when(fin.isNotNull(), "tcp_fin").when(F.least(at_idle, at_active) > F.col("_end"), "eof")
        .when(at_active <= at_idle, "active_timeout").otherwise("idle_timeout")
    )
    cells = [x.split()[0] for x in ENDED.split(", ")]
    return out.withColumns({"plain": plain, "end_reason": reason}).select("source", *KEY, "run", *cells, "plain")


_NEEDED = ("sequence", "wm", "wm_end", "forward", "original_len", "tcp_flags", "tcp_sequence")


def _runs(packets: DataFrame, timeouts: Timeouts, time: str) -> tuple[DataFrame, DataFrame]:
    """Packets of flows with their runs, and the runs' sums."""
    rows, n = foldable(packets, time)
    rows = with_runs(rows, timeouts, time, HOT if n > HOT else None).select("source", *KEY, "run", "tied", F.col(time).alias("us"), *_NEEDED)
    return rows, written(run_sums(rows, timeouts), "flow-runs")


def _ordered(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Packets of the runs that are not plain, each run's together and in capture order."""
    rows = rows.join(runs.where("not plain").select("source", *KEY, "run"), ["source", *KEY, "run"], "left_semi").withColumn("conversation_id", conversation_id())
    rows = rows.select("source", *KEY, "conversation_id", "run", "us", *_NEEDED)
    return rows.repartition("conversation_id", "run").sortWithinPartitions("conversation_id", "run", "sequence", "us", *_TIES)


def _folded(batches: Iterator[pd.DataFrame], timeouts: Timeouts) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """For each batch of ordered rows: ended flows as (row of their key, cells), and (source, sequence, first_sequence).

    A run may go on from batch to batch; only its open flow is held.
    """
    now = fold = key = end = None
    for pdf in batches:
        ended, assigned = [], []
        keys = list(zip(pdf["source"], *[pdf[c] for c in KEY], pdf["conversation_id"], strict=True))
        columns = [pdf[c].tolist() for c in ("run", "us", *_NEEDED)]
        for k, (run, us, seq, wm, wm_end, fwd, size, flags, tcp_seq) in enumerate(zip(*columns, strict=True)):
            if (keys[k][-1], run) != now:
                if fold is not None:
                    ended += [(key, x) for x in fold.finish(end)]
                now, key, end, fold = (keys[k][-1], run), keys[k], wm_end, Folder(pdf["proto"].iat[k], timeouts)
            ended += [(key, x) for x in fold.packet(seq, us, wm, fwd, size, None if flags is None or flags != flags else int(flags), None if tcp_seq is None or tcp_seq != tcp_seq else int(tcp_seq))]
            assigned.append((keys[k][0], seq, fold.last))
        yield pdf, ended, assigned
    if fold is not None:
        yield pd.DataFrame(), [(key, x) for x in fold.finish(end)], []


def sessionize(packets: DataFrame, timeouts: Timeouts = Timeouts(), time: str = "us") -> DataFrame:
    """One row for each flow instance: key, directional counters and flags, end_reason, tcp_state, flow_id."""
    rows, runs = _runs(packets, timeouts, time)
    odd = _ordered(rows, runs)
    cells = [x.split()[0] for x in ENDED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, ended, _ in _folded(batches, timeouts):
            yield pd.DataFrame([(*key, *x) for key, x in ended], columns=["source", *KEY, "conversation_id", *cells])

    kinds = {f.name: f.dataType.simpleString() for f in odd.schema.fields}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in ("source", *KEY, "conversation_id")], ENDED])
    plain = runs.where("plain").withColumn("conversation_id", conversation_id()).select("source", *KEY, "conversation_id", *cells)
    out = plain if runs.where("not plain").isEmpty() else plain.unionByName(odd.mapInPandas(run, schema))
    return out.withColumn("tcp_state", tcp_state()).withColumn("flow_id", flow_id())


def assign(packets: DataFrame, timeouts: Timeouts = Timeouts(), time: str = "us") -> DataFrame:
    """(source, sequence, first_sequence): the instance of each packet in flows, named by its first packet."""
    rows, runs = _runs(packets, timeouts, time)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, assigned in _folded(batches, timeouts):
            yield pd.DataFrame(assigned, columns=["source", "sequence", "first_sequence"])

    plain = rows.join(runs.where("plain").select("source", *KEY, "run", "first_sequence"), ["source", *KEY, "run"]).select("source", "sequence", "first_sequence")
    if runs.where("not plain").isEmpty():
        return plain
    return plain.unionByName(_ordered(rows, runs).mapInPandas(run, "source string, sequence long, first_sequence long"))


def tcp_state() -> Column:
    """What the flags say of a connection; null for others."""
    ab, ba = F.col("flags_ab"), F.col("flags_ba")
    either = ab.bitwiseOR(ba)
    has = lambda f, bit: f.bitwiseAND(F.lit(bit)) != 0
    both_fin, one_fin = has(ab, FIN) & has(ba, FIN), has(either, FIN)
    open_ = has(ab, SYN) & has(ba, SYN) & has(either, ACK)
    state = F.when(has(either, RST), "reset").when(both_fin, "closed").when(one_fin, "half_closed").when(open_, "established").when(has(either, SYN), "syn_seen").otherwise("midstream")
    return F.when(F.col("proto") == "tcp", state)


def conversation_id() -> Column:
    return net.identity(F.col("source"), *[F.col(c).cast("string") if c != "vlans" else F.array_join(F.transform("vlans", lambda v: v.cast("string")), ",") for c in KEY])


def flow_id() -> Column:
    return net.identity(F.lit("instance"), F.col("conversation_id"), F.col("first_sequence").cast("string"))


def idle_sessions(packets: DataFrame, idle_us: int, time: str = "us") -> DataFrame:
    """Flows by the idle time alone, each key by its own clock: gaps and islands, no Python.

    A gap of the idle time or more splits (``session_window`` would join a gap that equals it).
    """
    rows = with_flow_key(packets)
    by = W.partitionBy(*KEY).orderBy(time, "sequence")
    latest = F.max(time).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col(time) - latest >= idle_us, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return totals(rows, [*KEY, "session"], time)


def totals(rows: DataFrame, by: list[str], time: str = "us") -> DataFrame:
    """Directional packets, bytes and flag unions of the groups."""
    way = F.col("forward")
    return rows.groupBy(*by).agg(
        F.min(time).alias("start_us"),
        F.max(time).alias("end_us"),
        F.count_if(way).alias("packets_ab"),
        F.count_if(~way).alias("packets_ba"),
        F.coalesce(F.sum(F.when(way, F.col("original_len"))), F.lit(0)).cast("bigint").alias("bytes_ab"),
        F.coalesce(F.sum(F.when(~way, F.col("original_len"))), F.lit(0)).cast("bigint").alias("bytes_ba"),
        F.coalesce(F.bit_or(F.when(way, F.coalesce("tcp_flags", F.lit(0)))), F.lit(0)).alias("flags_ab"),
        F.coalesce(F.bit_or(F.when(~way, F.coalesce("tcp_flags", F.lit(0)))), F.lit(0)).alias("flags_ba"),
    )


def inherit(events: DataFrame, instances: DataFrame, name: str = "first_sequence") -> DataFrame:
    """Events (source, refs array of packet sequences) with the one instance that all their packets agree on, or null."""
    refs = events.select("event_id", "source", F.explode("refs").alias("sequence")).join(instances.select("source", "sequence", name), ["source", "sequence"], "left")
    agreed = refs.groupBy("event_id").agg(F.when((F.count_distinct(name) == 1) & (F.count(name) == F.count("*")), F.min(name)).alias(name))
    return events.join(agreed, "event_id", "left")


def by_affinity(packets: DataFrame, partitions: int) -> DataFrame:
    """Packets so dealt that all of a pair of hosts, fragments too, come to one partition."""
    low, high = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    return packets.repartition(partitions, low, high, "section", "interface", F.array_join(F.transform("vlans", lambda v: v.cast("string")), ","))
