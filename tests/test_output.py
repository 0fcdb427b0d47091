from __future__ import annotations

import json
import time

import pytest
from frames import EXAMPLE, pcap
from pyspark.sql import functions as F

from wirelake.errors import WirelakeError
from wirelake.operators import flows, output
from wirelake.sources import decode
from wirelake.sources import pcap as P


def test_renderers(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(EXAMPLE))
    rows = decode.decode_records(P.read(spark, str(tmp_path / "a.pcap")))
    view = output.packet_view(rows)
    first = json.loads(next(output.json_lines(view.orderBy("sequence"))))
    assert first["flags"] == "S" and first["time"].startswith("2023-11-14 22:13:20") and first["app"] is None
    lines = list(output.csv_lines(rows.select("sequence", "path", F.lit('a"b,c').alias("x"))))
    assert lines[0] == "sequence,path,x" and len(lines) == 7 and lines[1].endswith('"a""b,c"')
    ended = flows.sessionize(rows.withColumn("us", F.floor(F.col("timestamp_ns") / 1000).cast("bigint")))
    assert output.flow_view(ended).count() == 4
    assert flows.by_affinity(rows, 3).rdd.getNumPartitions() == 3
    output.write_new(str(tmp_path / "o"), "x")
    with pytest.raises(FileExistsError):
        output.write_new(str(tmp_path / "o"), "y")
    assert (tmp_path / "o").read_text() == "x" and len(list(tmp_path.glob("o*"))) == 1


def test_deadline(spark):
    assert len(output.collected(spark.range(8).repartition(4))) == 8

    def drag(batches):
        for b in batches:
            time.sleep(30)
            yield b

    with pytest.raises(WirelakeError):
        output.collected(spark.range(4).mapInPandas(drag, "id long"), seconds=1)


def test_flow_query():
    assert output.flow_query("proto == tcp", "src.ip", True, "flows", 5) == "proto == tcp | group src.ip | count | sort count desc | limit 5"
