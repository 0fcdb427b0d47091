"""Packet statistics: exact grouped reports over decoded packets.

Input columns: original_len, src_ip, dst_ip, dst_port, proto, tcp_flags, fragmented, path (layers from the link
upwards). Every packet counts once for each of its keys. Reports are (name, packets, bytes, percent_packets).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.errors import WirelakeError
from wirelake.functions import net

RANKED = ("top-talkers", "endpoints", "conversations", "ports")
#: Fixed value: groups of an exact report, at most, where a bound is asked for.
MAX_GROUPS = 65_536


def _summary() -> Column:
    extra = F.array_compact(F.array(F.lit("all matched packets"), F.when(F.col("fragmented"), F.lit("ip fragments"))))
    return F.concat(extra, _above_link())


def _above_link() -> Column:
    return F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))


def _hierarchy() -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.array_join(F.slice("path", F.lit(1), n), " > "))


def _flags() -> Column:
    return F.array_compact(F.array(*[F.when(net.has_flag(F.col("tcp_flags"), n), F.lit(n)) for n in net.FLAG_TESTS]))


def _conversation() -> Column:
    pair = F.when(F.col("src_ip").isNotNull(), F.array_sort(F.array("src_ip", "dst_ip")))
    return F.array(F.array_join(pair, " <-> "))


KEYS = {
    "summary": _summary,
    "hierarchy": _hierarchy,
    "protocols": _above_link,
    "flags": _flags,
    "top-talkers": lambda: F.array("src_ip"),
    "endpoints": lambda: F.array("src_ip", "dst_ip"),
    "conversations": _conversation,
    "ports": lambda: F.array(F.when(F.col("dst_port").isNotNull(), F.concat("proto", F.lit("/"), F.col("dst_port").cast("string")))),
}


def of_family(packets: DataFrame, family: int | None) -> DataFrame:
    if family is None:
        return packets
    six = F.col("src_ip").contains(":")
    return packets.where(six if family == 6 else ~six)


def totals(packets: DataFrame) -> DataFrame:
    """matched_packets and matched_bytes, one row."""
    return packets.agg(F.count("*").alias("matched_packets"), F.coalesce(F.sum("original_len"), F.lit(0)).cast("bigint").alias("matched_bytes"))


def seeded(groups: DataFrame, names: list[str]) -> DataFrame:
    """The groups with a row of zeros for each name that none has."""
    spark = groups.sparkSession
    all_ = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return all_.join(groups, "name", "left").na.fill(0, ["packets", "bytes"])


def report(packets: DataFrame, mode: str, top: int | None = None, by: str = "packets", family: int | None = None, limit: int | None = None, max_groups: int | None = None) -> DataFrame:
    """Rows of a report; ranked ones by ``by`` and then name, cut at ``top``, the others by name, whole.

    ``limit`` takes that many packets first in capture order. More groups than ``max_groups`` are an error, never an
    approximation.
    """
    packets = of_family(packets, family)
    if limit is not None:
        packets = packets.orderBy("sequence").limit(limit)
    keyed = packets.select(F.explode(F.array_distinct(F.array_compact(KEYS[mode]()))).alias("name"), "original_len")
    groups = keyed.groupBy("name").agg(F.count("*").alias("packets"), F.sum("original_len").cast("bigint").alias("bytes"))
    if max_groups is not None and groups.limit(max_groups + 1).count() > max_groups:
        raise WirelakeError(f"the report has more than {max_groups} groups; narrow the filter")
    if mode == "flags":
        groups = seeded(groups, list(net.FLAG_TESTS))
    return _percent(groups, packets, mode, top, by)


def _percent(groups: DataFrame, packets: DataFrame, mode: str, top: int | None, by: str) -> DataFrame:
    all_ = F.col("matched_packets")
    share = F.when(all_ == 0, F.lit(0.0)).otherwise(F.col("packets") * 100.0 / all_)
    # totals() is one row.
    out = groups.crossJoin(F.broadcast(totals(packets))).select("name", "packets", "bytes", share.alias("percent_packets"))
    if mode in RANKED:
        out = out.orderBy(F.desc(by), F.asc("name"))
        return out.limit(top) if top is not None else out
    return out.orderBy("name")


def count(packets: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    """One row for a named flag, or for a condition; zero if nothing matches."""
    test = net.has_flag(F.col("tcp_flags"), name) if condition is None else condition
    groups = packets.where(test).agg(F.count("*").alias("packets"), F.coalesce(F.sum("original_len"), F.lit(0)).cast("bigint").alias("bytes")).select(F.lit(name).alias("name"), "packets", "bytes")
    return _percent(groups, packets, "count", None, "packets")


def envelope(packets: DataFrame, mode: str, top: int = 10, records_read: int | None = None, malformed_skipped: int = 0, **options) -> dict:
    """A report with its totals, small enough to render."""
    full = report(packets, mode, None, **options)
    groups = full.count()
    rows = [r.asDict() for r in (full.limit(top) if mode in RANKED else full).collect()]
    sums = totals(of_family(packets, options.get("family"))).first().asDict()
    return {"report": mode, "records_read": records_read, **sums, "malformed_skipped": malformed_skipped, "groups_total": groups, "rows_omitted": groups - len(rows), "rows": rows}


def render(found: dict, style: str = "table") -> str:
    """The envelope as table, markdown, csv or json text."""
    if style == "json":
        return json.dumps(found, ensure_ascii=False)
    head = ["name", "packets", "bytes", "percent_packets"]
    rows = [[str(r["name"]), str(r["packets"]), str(r["bytes"]), f"{r['percent_packets']:.2f}"] for r in found["rows"]]
    if style == "csv":
        quote = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x
        return "\n".join(",".join(map(quote, r)) for r in [head, *rows]) + "\n"
    if style == "markdown":
        lines = ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in [head, *rows]]
        return "\n".join([lines[0], "|" + " --- |" * len(head), *lines[1:]]) + "\n"
    widths = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) if not k else x.rjust(w) for k, (x, w) in enumerate(zip(r, widths, strict=True))).rstrip() for r in [head, *rows]) + "\n"
