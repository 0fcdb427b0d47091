"""What of a table stays: compaction with cutoffs by class of event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of event types of the security class.
SECURITY = ("intel.", "notice.", "anomaly.", "policy.")


def is_security(event_type: Column) -> Column:
    out = F.lit(False)
    for p in SECURITY:
        out = out | event_type.startswith(p)
    return out


def retained(events: DataFrame, since_ms: int, security_since_ms: int | None = None) -> DataFrame:
    """Rows at or after their class's cutoff; rows without a time stay, ids stay as they are."""
    cutoff = F.when(is_security(F.col("event_type")), F.lit(since_ms if security_since_ms is None else security_since_ms)).otherwise(F.lit(since_ms))
    return events.where(F.col("timestamp_ms").isNull() | (F.col("timestamp_ms") >= cutoff))


def accepted(events: DataFrame, modules: set[str]) -> DataFrame:
    """Rows whose module is on; kinds of no module always pass."""
    from wirelake.plans.modules import MODULE_OF_PREFIX

    prefix = F.substring_index("event_type", ".", 1)
    off = [p for p, m in MODULE_OF_PREFIX.items() if m not in modules]
    return events.where(~prefix.isin(*off)) if off else events
