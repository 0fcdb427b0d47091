"""The observation store: append-only batches of partitioned Parquet, each published at once.

A batch is ``data/batch=<id>/event=<kind>/hour=<h>``, written beside the data first and then renamed. A batch id that is
there is not imported again. Paths go through the Hadoop file system, so a store can be wherever Spark reads.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake import schema
from wirelake.errors import StoreError
from wirelake.functions import net
from wirelake.operators import retention

_PHYSICAL = T.StructType([*schema.OBSERVATION.fields, T.StructField("src_ip_key", T.StringType()), T.StructField("dst_ip_key", T.StringType())])
_PARTITIONED = T.StructType([*_PHYSICAL.fields, T.StructField("batch", T.StringType()), T.StructField("event", T.StringType()), T.StructField("hour", T.StringType())])


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        marker = self._path(f"{self.path}/schema.json")
        if self._fs.exists(marker):
            version = json.loads(spark.read.text(f"{self.path}/schema.json").first()[0])["schema_version"]
            if version not in schema.READABLE_VERSIONS:
                raise StoreError(f"the store has version {version}; {schema.READABLE_VERSIONS} can be read")
            self.version = version
        elif self._fs.exists(self._path(f"{self.path}/data")):
            raise StoreError("the store has data and no schema.json")
        else:
            out = self._fs.create(marker, False)
            out.write(bytearray(json.dumps({"schema_version": schema.SCHEMA_VERSION}).encode() + b"\n"))
            out.close()
            self.version = schema.SCHEMA_VERSION

    def _batch(self, batch: str):
        if not re.fullmatch(r"[0-9a-f]{64}", batch):
            raise StoreError("a batch id has 64 hex digits")
        return self._path(f"{self.path}/data/batch={batch}")

    def committed(self) -> list[str]:
        data = self._path(f"{self.path}/data")
        if not self._fs.exists(data):
            return []
        return sorted(s.getPath().getName().removeprefix("batch=") for s in self._fs.listStatus(data) if s.getPath().getName().startswith("batch="))

    def append(self, rows: DataFrame, batch: str) -> None:
        """Publishes the rows as one batch; a failure leaves nothing to be seen."""
        if self.version != schema.SCHEMA_VERSION:
            raise StoreError(f"a store of version {self.version} can only be read")
        target = self._batch(batch)
        if self._fs.exists(target):
            raise StoreError(f"batch {batch} is already imported")
        staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        named = F.when(F.col("event_type").rlike(r"^[A-Za-z0-9._-]{1,64}$"), F.col("event_type")).otherwise(F.concat(F.lit("custom-"), F.substring(F.sha2("event_type", 256), 1, 16)))
        hour = F.coalesce(F.floor(F.col("timestamp_ms") / 3_600_000).cast("string"), F.lit("unknown"))
        full = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.OBSERVATION.fields])
        full = full.withColumns({"src_ip_key": net.ip_key(F.col("src_ip")), "dst_ip_key": net.ip_key(F.col("dst_ip")), "event": named, "hour": hour})
        try:
            # Rows of an hour and kind come together, so a task writes few files; a hot hour is split by Spark.
            full.hint("rebalance", "event", "hour").write.partitionBy("event", "hour").option("compression", "zstd").parquet(staging)
            self._fs.mkdirs(target.getParent())
            if not self._fs.rename(self._path(staging), target):
                raise StoreError(f"batch {batch} could not be published")
        finally:
            if self._fs.exists(self._path(staging)):
                self._fs.delete(self._path(staging), True)

    def physical(self) -> DataFrame:
        """All committed rows with keys and partition columns, which filters prune by."""
        if not self.committed():
            return self.spark.createDataFrame([], _PARTITIONED)
        return self.spark.read.schema(_PARTITIONED).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")

    def events(self) -> DataFrame:
        return self.physical()

    def compact(self, target: str, since_ms: int, security_since_ms: int | None = None) -> dict[str, int]:
        """Copies what the cutoffs retain into a new store outside this one; every batch id stays known."""
        inner = f"{target.rstrip('/')}/".startswith(f"{self.path}/")
        if inner or self._fs.exists(self._path(target)):
            raise StoreError("the target of a compaction is new and outside the store")
        other = Store(self.spark, target)
        seen = F.count(F.lit(1)).alias("read")
        read = retained = 0
        for batch in self.committed():
            rows = self.physical().where(F.col("batch") == batch)
            read += rows.agg(seen).first()["read"]
            kept = retention.retained(rows, since_ms, security_since_ms)
            retained += kept.count()
            other.append(kept.select(*schema.COLUMNS), batch)
        return {"read": read, "retained": retained, "discarded": read - retained}


def foreign(spark: SparkSession, path: str, version: int = schema.SCHEMA_VERSION) -> DataFrame:
    """Rows of a store with another layout: the fixed schema over all its files, whatever their directories say."""
    fields = [f for f in schema.OBSERVATION.fields if version > 1 or f.name not in schema.SINCE_VERSION_2]
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    rows = spark.read.schema(kinds).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.select(*[F.col(f.name) if f in fields else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.OBSERVATION.fields])


def with_hot(committed: DataFrame, hot: DataFrame, batch: str = "batch") -> DataFrame:
    """The committed rows, and the hot ones whose batch is not committed."""
    known = committed.select(batch).distinct()
    return committed.unionByName(hot.join(known, batch, "left_anti").select(*committed.columns))


def append_hot(rows: DataFrame, path: str, batch: str) -> None:
    """Adds rows of a batch that is not published yet to a journal of JSON lines; each write adds files of its own, so that readers see whole
    lines. What the store commits under the batch's id replaces them (``with_hot``)."""
    if not re.fullmatch(r"[0-9a-f]{64}", batch):
        raise StoreError("a batch id has 64 hex digits")
    rows.select(F.lit(batch).alias("batch"), *schema.COLUMNS).write.mode("append").option("ignoreNullFields", "true").json(path)


def hot_journal(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a journal of JSON lines (batch and the observation's columns); a line that is not complete is dropped."""
    kinds = T.StructType([T.StructField("batch", T.StringType()), *[T.StructField(f.name, f.dataType) for f in schema.OBSERVATION.fields], T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull() & F.col("event_id").isNotNull()).drop("_corrupt")
