"""From an observation back to the packets that it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.errors import WirelakeError
from wirelake.functions import net

#: References of an observation, and steps to a parent.
MAX_REFS, MAX_STEPS = 4096, 8


def merged(refs: str = "refs", complete: str = "complete") -> list[Column]:
    """Aggregates: sorted distinct references, MAX_REFS at most, and whether they are all."""
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_list(refs))))
    return [F.slice(all_, 1, MAX_REFS).alias(refs), (F.bool_and(complete) & (F.size(all_) <= MAX_REFS)).alias(complete)]


def source_event(events: DataFrame, event_id: str) -> dict:
    """The observation with packet references that ``event_id`` goes back to, by up to MAX_STEPS parents."""
    seen: list[str] = []
    own: dict | None = None
    for _ in range(MAX_STEPS + 1):
        if event_id in seen:
            raise WirelakeError(f"event {event_id} is its own parent")
        seen.append(event_id)
        rows = events.where(F.col("event_id") == event_id).withColumn("parent", net.json_scalar(F.col("payload"), "$.source_event_id")).limit(2).collect()
        if len(rows) != 1:
            raise WirelakeError(f"event {event_id} is there {len(rows)} times")
        row = rows[0].asDict()
        if own is not None and (row["source"], row["sensor"]) != (own["source"], own["sensor"]):
            raise WirelakeError("a parent is of another source or sensor")
        own = row
        if row["parent"] is None:
            return row
        event_id = row["parent"]
    raise WirelakeError(f"no packet within {MAX_STEPS} parents")


def packets_of(records: DataFrame, references: DataFrame) -> DataFrame:
    """Capture records that the references (source, section, interface, sequence) name."""
    return records.join(references.distinct(), ["source", "section", "interface", "sequence"], "left_semi")


def references_of(events: DataFrame) -> DataFrame:
    """(event_id, source, section, interface, sequence) of analyzed events."""
    return events.select("event_id", "source", "section", "interface", F.explode("refs").alias("sequence"))


def prune(manifest: DataFrame, keep_bytes: int, since_ms: int | None = None) -> DataFrame:
    """Files of a raw cache (path, bytes, closed_ms) that stay: the newest up to ``keep_bytes``, none closed before ``since_ms``."""
    from pyspark.sql import Window as W

    # A manifest has a row a file, not a row a packet.
    upto = F.sum("bytes").over(W.orderBy(F.desc("closed_ms"), "path").rowsBetween(W.unboundedPreceding, 0))
    rows = manifest.withColumn("_upto", upto).where(F.col("_upto") <= keep_bytes).drop("_upto")
    return rows if since_ms is None else rows.where(F.col("closed_ms") >= since_ms)
