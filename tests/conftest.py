from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from decoyscope.schemas import EVENT  # noqa: E402
from decoyscope.settings import configure  # noqa: E402

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def make_events(spark, rows):
    """Canonical events from dicts: id, at (seconds), ip, and any of the keys below."""
    fields = (
        "id string, ts timestamp, ingested timestamp, category string, outcome string, action string, ip string, target string, "
        "service string, honeypot string, protocol string, username string, password string, url string, command string, "
        "operation string, internal boolean"
    )
    names = [item.strip().split(" ")[0] for item in fields.split(",")]
    data = []
    for row in rows:
        full = {
            "category": "network", "outcome": "unknown", "action": "observe", "ip": "10.0.0.2", "target": "192.168.50.10",
            "service": "camera", "protocol": "http", "internal": False, **row,
        }
        full["ts"] = at(full.pop("at"))
        full["ingested"] = at(full["seen"]) if "seen" in full else full["ts"] + timedelta(seconds=1)
        full.setdefault("honeypot", full["service"] + "-01")
        data.append(tuple(full.get(name) for name in names))
    c = F.col
    flat = spark.createDataFrame(data, fields)
    mqtt = EVENT["mqtt"].dataType
    return flat.select(
        "ts",
        F.struct(c("id"), c("ingested"), c("category"), F.lit("info").alias("type"), c("action"), c("outcome")).alias("event"),
        F.struct(c("ip"), F.lit(1).alias("port")).alias("source"),
        F.struct(c("target").alias("ip"), F.lit(2).alias("port")).alias("destination"),
        F.struct(F.lit("tcp").alias("transport"), c("protocol")).alias("network"),
        F.struct(c("service").alias("name")).alias("service"),
        F.struct(c("honeypot").alias("id"), c("service").alias("type")).alias("honeypot"),
        F.struct(F.lit("o").alias("name"), F.lit("honeypot_sensor").alias("type")).alias("observer"),
        F.struct(F.lit("s").alias("sensor_id"), F.lit("1").alias("schema_version"), c("internal"), F.lit(None).cast("string").alias("internal_reason")).alias("meta"),
        F.struct("username", "password").alias("authentication"),
        F.struct(c("url").alias("path")).alias("url"),
        F.struct(F.struct(F.lit(None).cast("string").alias("method")).alias("request"), F.lit(None).cast("string").alias("user_agent")).alias("http"),
        F.struct(*[(c("operation") if f.name == "operation" else F.lit(None).cast(f.dataType)).alias(f.name) for f in mqtt.fields]).alias("mqtt"),
        F.struct(F.lit(None).cast("string").alias("operation")).alias("iot"),
        F.struct(c("command").alias("command_line")).alias("process"),
        F.lit("m").alias("message"),
        F.to_date("ts").alias("event_date"),
    )
