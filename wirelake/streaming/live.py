"""Streams: live query windows, flow sessions with state, the notice gate, and checkpointed store writes."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirelake import schema
from wirelake.errors import WirelakeError
from wirelake.operators import flows
from wirelake.plans import pipeline

#: Fixed value: observations of a window.
MAX_WINDOW_ROWS = 10_000


def query_windows(stream: DataFrame, text: str, seconds: int, emit: Callable[[dict], None], checkpoint: str | None = None, max_rows: int = MAX_WINDOW_ROWS, available_now: bool = False):
    """Runs a query over what arrives in each span of ``seconds``, and emits a ``query.window`` envelope of each that is not empty."""
    pipeline.parts_of(text)  # an error of the query comes before the stream starts

    def run(batch: DataFrame, number: int) -> None:
        n = batch.limit(max_rows + 1).count()
        if n > max_rows:
            raise WirelakeError(f"a window has more than {max_rows} observations")
        if n:
            rows = [json.loads(x) for x in pipeline.query(batch, text).toJSON().collect()]
            emit({"event_type": "query.window", "window": number, "seconds": seconds, "observations": n, "rows": rows})

    writer = stream.writeStream.foreachBatch(run)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def write_store(stream: DataFrame, store, checkpoint: str, seconds: int = 5, available_now: bool = False):
    """Publishes each micro-batch as one batch of the store. A batch that was published before a restart is not written again."""
    import hashlib

    def run(batch: DataFrame, number: int) -> None:
        ident = hashlib.sha256(f"{checkpoint}:{number}".encode()).hexdigest()
        if ident not in store.committed():
            store.append(batch.select(*schema.COLUMNS), ident)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def quiet_notices(stream: DataFrame, keys: list[str], time: str = "ts", quiet: str = "60 seconds") -> DataFrame:
    """The first notice of each key within the quiet time."""
    return stream.withWatermark(time, quiet).dropDuplicatesWithinWatermark(keys)


class FlowProcessor(StatefulProcessor):
    """The fold of the batch operator with its state in Spark: a value a key, and a timer at the flow's deadline."""

    def __init__(self, timeouts: flows.Timeouts) -> None:
        self.timeouts = timeouts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "fold binary, wm bigint")

    def _load(self, proto: str) -> tuple[flows.Folder, int | None]:
        found = self.state.get()
        return (pickle.loads(found[0]), found[1]) if found else (flows.Folder(proto, self.timeouts), None)

    def _save(self, fold: flows.Folder, wm: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if fold.flow is None:
            self.state.clear()
            return
        self.state.update((pickle.dumps(fold), wm))
        self.handle.registerTimer(fold.flow.deadline(fold.idle, fold.active)[0] // 1000 + 1)

    def _frame(self, key: tuple, ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in ended], columns=[*STREAM_KEY, *CELLS])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold, wm = self._load(key[STREAM_KEY.index("proto")])
        ended: list[tuple] = []
        pdf = pd.concat(list(rows)).sort_values("sequence")
        past = timerValues.getCurrentWatermarkInMs() * 1000
        for seq, us, fwd, size, flags, tcp_seq in zip(pdf["sequence"], pdf["us"], pdf["forward"], pdf["original_len"], pdf["tcp_flags"], pdf["tcp_sequence"], strict=True):
            wm = max(int(us), past, wm or 0)
            ended += fold.packet(int(seq), int(us), wm, bool(fwd), int(size), None if pd.isna(flags) else int(flags), None if pd.isna(tcp_seq) else int(tcp_seq))
        self._save(fold, wm)
        yield self._frame(key, ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, wm = self._load(key[STREAM_KEY.index("proto")])
        wm = max(wm or 0, timerValues.getCurrentWatermarkInMs() * 1000)
        ended = list(fold.expire(wm))
        self._save(fold, wm)
        yield self._frame(key, ended)

    def close(self) -> None:
        pass


STREAM_KEY = ["source", "a_ip", "a_port", "b_ip", "b_port", "proto", "section", "interface", "vlan"]
CELLS = [x.split()[0] for x in flows.ENDED.split(", ")]


def stream_flows(packets: DataFrame, timeouts: flows.Timeouts = flows.Timeouts(), delay: str = "0 seconds") -> DataFrame:
    """Flows of a packet stream (us and the columns of the batch operator) as they end.

    The watermark moves by micro-batch, so a flow can end later than in a batch run, and what is open at the end stays in the
    state; the flows that end are the same. Needs the RocksDB state store.
    """
    rows = flows.with_flow_key(packets).where(~F.coalesce("fragmented", F.lit(False)) & F.col("proto").isin("tcp", "udp"))
    if "tcp_sequence" not in rows.columns:
        rows = rows.withColumn("tcp_sequence", F.lit(None).cast("long"))
    rows = rows.withColumns({"ts": F.timestamp_micros("us"), "vlan": F.array_join(F.transform("vlans", lambda v: v.cast("string")), ",")}).withWatermark("ts", delay)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([*[f"{c} {kinds[c]}" for c in STREAM_KEY], flows.ENDED])
    return rows.groupBy(*STREAM_KEY).transformWithStateInPandas(FlowProcessor(timeouts), out, "Append", "EventTime")
