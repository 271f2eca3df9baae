from __future__ import annotations

import hashlib
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from decoyscope.functions import ip, values

ADDRESSES = [
    "198.51.100.20", "2001:db8::20", "999.1.2.3", "2001:::bad", "127.8.9.10", "::1", "0:0:0:0:0:0:0:1", "1::", "::",
    "::ffff:1.2.3.4", "1.2.3", "01.2.3.4", "", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::1:1", "10.0.0.256",
]


def _address(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_address_validity_loopback_and_canonical_form(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    rows = df.select(
        "a", ip.is_valid_ip(F.col("a")).alias("valid"), ip.is_loopback(F.col("a")).alias("loop"),
        ip.ipv4_number(F.col("a")).alias("number"), ip.ipv6_hex(F.col("a")).alias("hex"),
    ).collect()
    for row in rows:
        known = _address(row.a)
        assert row.valid == (known is not None), row.a
        assert row.loop == (known is not None and known.is_loopback), row.a
        if known is not None and known.version == 4:
            assert row.number == int(known)
        if known is not None and known.version == 6:
            assert row.hex == f"{int(known):032x}", row.a


@pytest.mark.parametrize("subnet,host,expected", [
    ("192.168.50.0/24", "192.168.50.20", True), ("192.168.50.0/24", "127.0.0.1", False),
    ("192.168.50.0/24", "192.168.51.2", False), ("192.168.50.0/24", "192.168.50.0", False),
    ("192.168.50.0/24", "192.168.50.255", False), ("fd00::/64", "fd00::5", True), ("fd00::/64", "fd00:1::5", False),
])
def test_lab_hosts(spark, subnet, host, expected):
    df = spark.createDataFrame([(host,)], "a string")
    assert df.select(ip.is_usable_lab_host(F.col("a"), subnet)).first()[0] is expected


def test_public_lab_subnet_is_refused():
    with pytest.raises(ValueError, match="private"):
        ip.is_usable_lab_host(None, "8.8.8.0/24")


def test_quantities_and_percent(spark):
    df = spark.createDataFrame([("1MiB", "1.5%"), ("2kB", "--"), ("3.5 GiB", ""), ("n/a", "7"), ("1XB", None)], "q string, p string")
    rows = df.select(values.byte_quantity(F.col("q")), values.percent(F.col("p"))).collect()
    assert [r[0] for r in rows] == [1048576, 2000, 3758096384, None, None]
    assert [r[1] for r in rows] == [1.5, None, None, 7.0, None]


def test_fingerprint_equals_sorted_compact_json(spark):
    config = {"session_timeout_seconds": 300, "brute_force_threshold": 5, "web_enumeration_threshold": 4,
              "multi_service_threshold": 3, "detector_ruleset_version": "2", "my_schema": "1"}
    schema = ("c struct<session_timeout_seconds:int,brute_force_threshold:int,web_enumeration_threshold:int,"
              "multi_service_threshold:int,detector_ruleset_version:string,schema_version:string>, r string")
    df = spark.createDataFrame([((300, 5, 4, 3, "2", "1"), r) for r in ("abc", "unknown", " ", None)], schema)
    got = [r[0] for r in df.select(values.config_fingerprint(F.col("c"), F.col("r"), "my_schema")).collect()]
    text = json.dumps({**config, "software_revision": "abc"}, sort_keys=True, separators=(",", ":"))
    assert got == [hashlib.sha256(text.encode()).hexdigest(), None, None, None]


def test_time_parsing(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01T02:00:00+02:00",), ("12:30",), ("soon",)], "t string")
    got = [r[0] for r in df.select(values.parse_time(F.col("t")).cast("string")).collect()]
    assert got == ["2026-01-01 00:00:00", "2026-01-01 00:00:00", None, None]
