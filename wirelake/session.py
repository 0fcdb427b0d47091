"""What a Spark session needs for the engine."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that results depend on.
PINNED = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}


#: Environment of Python workers: allocators that give memory back between batches.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "131072"}


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine find the package; on a cluster, ship it as usual (py-files or an archive)."""
    for k, v in WORKERS.items():
        spark.sparkContext.environment.setdefault(k, v)
    home, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (known.get("PYTHONPATH"), home) if x)
    return spark


def local(cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and small work."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    for k, v in (PINNED | conf).items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())
