"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.tables import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str, arrow_rows: int | None = None) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read again.

    A later stage that loses an executor rereads the table instead of computing it anew. ``arrow_rows`` bounds the rows that a
    Python worker gets at a time while the table is made, for rows with whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if arrow_rows is not None:
        spark.conf.set(ARROW_ROWS, str(min(arrow_rows, int(before))))
    try:
        df.write.option("compression", "snappy").parquet(path)  # little native memory for each of many small tables
    finally:
        if arrow_rows is not None:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Gives freed memory of the driver's Python back to the system, which its allocator keeps otherwise; later stages need the room."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def inline_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small constant table as a local relation."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])))
