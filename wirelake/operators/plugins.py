"""Plugins: functions from an observation to more observations, run beside the query engine.

A plugin names the event types it wants (never ``packet``) and gets each as a dict; what it returns becomes
``notice.plugin`` rows. The first error in a task turns it off for the rest of that task and makes an ``anomaly.plugin`` row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake import schema
from wirelake.errors import WirelakeError
from wirelake.functions import net

#: Objects and bytes that a call may return.
MAX_OBJECTS, MAX_BYTES = 64, 65_536


@dataclass(frozen=True)
class Plugin:
    name: str
    subscriptions: tuple[str, ...]
    process: Callable[[dict], Iterable[dict]]
    max_events: int | None = None


class Registry:
    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def register(self, name: str, subscriptions: Iterable[str], process: Callable[[dict], Iterable[dict]], max_events: int | None = None) -> None:
        kinds = tuple(subscriptions)
        if name in self.plugins or not kinds or "packet" in kinds:
            raise WirelakeError(f"plugin {name}: a new name, and event types other than packet")
        self.plugins[name] = Plugin(name, kinds, process, max_events)

    def run(self, events: DataFrame) -> DataFrame:
        """Observations that the plugins make of ``events``, counters null; no shuffle."""
        plugins = list(self.plugins.values())
        wanted = sorted({k for p in plugins for k in p.subscriptions})
        rows = events.select(*schema.COLUMNS).where(F.col("event_type").isin(*wanted))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.OBSERVATION.fields)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left = {p.name: p.max_events for p in plugins}
            for pdf in batches:
                out = []
                for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                    for p in plugins:
                        if row["event_type"] not in p.subscriptions or left[p.name] == 0:
                            continue
                        if left[p.name] is not None:
                            left[p.name] -= 1
                        try:
                            found = [json.dumps({"source_event_id": row["event_id"], "plugin": p.name} | x) for x in p.process(dict(row))]
                            if len(found) > MAX_OBJECTS or sum(map(len, found)) > MAX_BYTES:
                                raise ValueError("too many objects, or too long")
                            out += [row | {"event_type": "notice.plugin", "packets": None, "bytes": None, "payload": x} for x in found]
                        except Exception as e:  # a plugin must not stop the run
                            left[p.name] = 0
                            anomaly = {"source_event_id": row["event_id"], "plugin": p.name, "anomaly": {"code": "PLUGIN", "message": str(e)[:512]}}
                            out.append(row | {"event_type": "anomaly.plugin", "packets": None, "bytes": None, "payload": json.dumps(anomaly)})
                yield pd.DataFrame(out, columns=schema.COLUMNS, dtype=object)

        made = rows.mapInPandas(run, kinds)
        return made.withColumn("event_id", net.identity(F.lit("plugin"), F.col("event_id"), F.col("payload")))
