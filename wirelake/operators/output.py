"""What users read: JSON lines, CSV and tables of results, bounded by rows and time."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.errors import WirelakeError
from wirelake.functions import net

#: Rows and seconds of an interactive result.
ROWS, SECONDS = 10_000, 30
PACKET_COLUMNS = ("sequence", "time", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "flags", "original_len", "app")
FLOW_COLUMNS = ("a_ip", "a_port", "b_ip", "b_port", "proto", "packets_ab", "packets_ba", "bytes_ab", "bytes_ba", "end_reason", "tcp_state")


def json_lines(df: DataFrame, rows: int = ROWS) -> Iterator[str]:
    """One object a line; fields that are null stand as null."""
    yield from (r[0] for r in df.limit(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator())


def csv_lines(df: DataFrame, rows: int = ROWS) -> Iterator[str]:
    """A header and one record a line; nested values as JSON."""
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c).cast("string").alias(c) for c, k in df.dtypes]
    cell = lambda x: "" if x is None else '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x
    yield ",".join(map(cell, df.columns))
    yield from (",".join(map(cell, r)) for r in df.limit(rows).select(*flat).toLocalIterator())


def packet_view(packets: DataFrame) -> DataFrame:
    """Packets as a reader wants them."""
    return packets.withColumns({"time": net.utc_text(net.ms_of_ns(F.col("timestamp_ns"))), "flags": net.flag_text(F.col("tcp_flags"))}).select(*PACKET_COLUMNS)


def flow_view(ended: DataFrame) -> DataFrame:
    return ended.withColumn("duration", net.duration_text((F.col("end_us") - F.col("start_us")) / 1000)).select(*FLOW_COLUMNS, "duration")


def collected(df: DataFrame, rows: int = ROWS, seconds: float = SECONDS) -> list:
    """The rows, or an error after the time is up; what ran for them is cancelled."""
    context, tag = df.sparkSession.sparkContext, f"wirelake-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(tag)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(tag, "a bounded result", interruptOnCancel=True)
    timer.start()
    try:
        return df.limit(rows).collect()
    except Exception:
        if late.is_set():
            raise WirelakeError(f"the query took more than {seconds} seconds") from None
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def write_new(path: str, text: str) -> None:
    """A whole file or none; one that is there is not overwritten."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "x") as f:
        f.write(text)
    try:
        os.link(part, path)
    finally:
        os.unlink(part)


def flow_query(filter_: str = "*", group: str | None = None, count: bool = False, sort: str | None = None, limit: int | None = None) -> str:
    """The query that the options of a flow listing stand for: group, count, sort (falling), limit, in this order."""
    stages = [f"group {group}" if group else None, "count" if count else None, f"sort {'count' if sort == 'flows' else sort} desc" if sort else None, f"limit {limit}" if limit else None]
    return " | ".join([filter_, *[s for s in stages if s]])
