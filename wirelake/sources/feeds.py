"""Indicator and rule feeds as JSON lines, and layered configuration."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.errors import WirelakeError

INDICATOR = "kind string, value string, source string, severity string"
RULE = "id string, event_type string, field string, equals string, message string, severity string"
#: Fixed value: bytes of a line.
MAX_LINE = 4096


def _feed(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """Strict: a line that is no object of these fields, or too long, is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    names = [x.split()[0] for x in kinds.split(", ")]
    known = F.array(*[F.lit(n) for n in names])
    keys = F.json_object_keys("value")
    bad = lines.where(keys.isNull() | (F.size(F.array_except(keys, known)) > 0) | (F.octet_length("value") > MAX_LINE))
    if not bad.isEmpty():
        raise WirelakeError(f"a bad line in {path}: {bad.first()['value'][:200]}")
    return lines.select(F.from_json("value", kinds, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def indicators(spark: SparkSession, path: str) -> DataFrame:
    return _feed(spark, path, INDICATOR)


def rules(spark: SparkSession, path: str) -> DataFrame:
    return _feed(spark, path, RULE).fillna({"severity": "warning"})


#: Keys of the configuration and their defaults.
DEFAULTS = {"sensor": "default", "profiles": ["complete"], "enabled_modules": [], "disabled_modules": [], "dns_ports": [53], "tcp_idle_seconds": 120, "udp_idle_seconds": 30, "active_seconds": 300, "notices": True, "shuffle_partitions": 0}


def config(paths: list[str | Path], environ: dict[str, str] | None = None) -> dict:
    """The defaults, under each file that exists in order, under WIRELAKE_<KEY> variables; unknown keys are errors."""
    out = dict(DEFAULTS)
    for path in paths:
        if Path(path).exists():
            with open(path, "rb") as f:
                out |= _known(tomllib.load(f), str(path))
    env = os.environ if environ is None else environ
    own = {k.removeprefix("WIRELAKE_").lower(): v for k, v in env.items() if k.startswith("WIRELAKE_")}
    return out | _known({k: tomllib.loads(f"x = {v}")["x"] if not isinstance(DEFAULTS.get(k, ""), str) else v for k, v in own.items()}, "the environment")


def _known(found: dict, where: str) -> dict:
    unknown = found.keys() - DEFAULTS.keys()
    if unknown:
        raise WirelakeError(f"{where} has keys that are not known: {', '.join(sorted(unknown))}")
    for k, v in found.items():
        if type(v) is not type(DEFAULTS[k]):
            raise WirelakeError(f"{where}: {k} is {type(DEFAULTS[k]).__name__}")
    return found
