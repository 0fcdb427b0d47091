"""Flow-export datagrams off the network: a streaming source that listens on a UDP port.

``spark.readStream.format("udp_exports").option("host", …).option("port", …).option("journal", …)`` gives the datagram table that
``netflow`` decodes: exporter (address and port), arrival (seconds) and data. The listener runs beside the driver; what
it receives is written to the journal folder, which executors share, before an offset names it, so that a batch can be read again.
Datagrams that arrive while none listens are lost, as with any UDP listener. Committed journal files are deleted.
"""

from __future__ import annotations

import os
import pickle
import socket
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "exporter string, arrival long, data binary"
#: Bytes of a datagram, and datagrams of a journal file.
MAX_BYTES, MOST = 65_535, 10_000


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class CollectorReader(DataSourceStreamReader):
    """Offsets count datagrams; a journal file holds those from one offset to the next."""

    def __init__(self, options: dict) -> None:
        self.host, self.port, self.journal = options.get("host", "0.0.0.0"), int(options.get("port", "2055")), options["journal"].removeprefix("file://")
        os.makedirs(self.journal, exist_ok=True)
        self.socket: socket.socket | None = None

    def _files(self) -> list[tuple[int, int, str]]:
        names = [n for n in os.listdir(self.journal) if n.endswith(".datagrams")]
        return sorted((*map(int, n.split(".")[0].split("-")), os.path.join(self.journal, n)) for n in names)

    def _received(self) -> list[tuple[str, int, bytes]]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET6 if ":" in self.host else socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 8 << 20)
            self.socket.bind((self.host, self.port))
            self.socket.setblocking(False)
        out = []
        while len(out) < MOST:
            try:
                data, peer = self.socket.recvfrom(MAX_BYTES)
            except BlockingIOError:
                break
            out.append((f"{peer[0]}:{peer[1]}", int(time.time()), data))
        return out

    def initialOffset(self) -> dict:
        return {"n": max((hi for _, hi, _ in self._files()), default=0)}

    def latestOffset(self) -> dict:
        last = max((hi for _, hi, _ in self._files()), default=0)
        if got := self._received():
            path = os.path.join(self.journal, f"{last:020d}-{last + len(got):020d}.datagrams")
            with open(f"{path}.part", "wb") as f:
                pickle.dump(got, f)
            os.rename(f"{path}.part", path)
            last += len(got)
        return {"n": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(path) for lo, hi, path in self._files() if start["n"] <= lo and hi <= end["n"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from pickle.load(f)

    def commit(self, end: dict) -> None:
        """All but the last file go; that one says where the count stands."""
        files = [f for f in self._files() if f[1] <= end["n"]]
        for _, _, path in files[:-1]:
            os.remove(path)

    def stop(self) -> None:
        if self.socket is not None:
            self.socket.close()
            self.socket = None


class CollectorSource(DataSource):
    """``format("udp_exports")``."""

    @classmethod
    def name(cls) -> str:
        return "udp_exports"

    def schema(self) -> StructType | str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CollectorReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CollectorSource)
