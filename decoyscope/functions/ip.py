"""IP address expressions built from JVM-side string functions."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"


def _v6_pattern() -> str:
    forms = [f"{_H}(?::{_H}){{7}}", f"{_H}(?::{_H}){{5}}:{_V4}"]
    for left in range(8):
        head = f"{_H}(?::{_H}){{{left - 1}}}" if left else ""
        tail = f"(?:{_H}(?::{_H}){{0,{6 - left}}})?" if left < 7 else ""
        forms.append(f"{head}::{tail}")
        if left < 6:
            forms.append(f"{head}::(?:{_H}:){{0,{5 - left}}}{_V4}")
    return "|".join(forms)


def _loopback_pattern() -> str:
    zero = "0{1,4}"
    forms = [rf"127(?:\.{_OCTET}){{3}}", f"(?:{zero}:){{7}}0{{0,3}}1", rf"(?:{zero}:){{6}}0\.0\.0\.1"]
    for left in range(7):
        head = f"{zero}(?::{zero}){{{left - 1}}}" if left else ""
        forms.append(f"{head}::(?:{zero}:){{0,{6 - left}}}0{{0,3}}1(?:%[^%/]+)?")
        if left < 6:
            forms.append(rf"{head}::(?:{zero}:){{0,{5 - left}}}0\.0\.0\.1(?:%[^%/]+)?")
    return "|".join(forms)


IPV4 = f"^{_V4}$"
IPV6 = f"^(?:{_v6_pattern()})(?:%[^%/]+)?$"
ANY_IP = f"^(?:{_V4}|(?:{_v6_pattern()})(?:%[^%/]+)?)$"
LOOPBACK = f"^(?:{_loopback_pattern()})$"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    return F.coalesce(ip.contains(":") & ip.rlike(IPV6), F.lit(False))


def is_valid_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(ANY_IP), F.lit(False))


def is_loopback(ip: Column) -> Column:
    """127.0.0.0/8 or any spelling of ::1; null and invalid text are not loopback.

    A single pattern, so that the filter stays a small piece of generated code; most addresses do not reach it.
    """
    return F.coalesce((ip.startswith("127.") | ip.contains(":")) & ip.rlike(LOOPBACK), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """Address as BIGINT, null unless the text is a valid IPv4 address."""
    octets = F.transform(F.split(ip, "[.]"), lambda part: part.cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda total, octet: total * 256 + octet)
    return F.when(is_ipv4(ip), number)


def ipv6_hex(ip: Column) -> Column:
    """Canonical 32-digit lower-case form, null unless the text is a valid IPv6 address."""
    bare = F.lower(F.split(ip, "%").getItem(0))
    v4_tail = F.regexp_extract(bare, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    low = ipv4_number(v4_tail)
    tail_groups = F.concat(
        F.conv((F.shiftrightunsigned(low, 16)).cast("string"), 10, 16),
        F.lit(":"),
        F.conv((low % 65536).cast("string"), 10, 16),
    )
    text = F.lower(
        F.when(v4_tail == "", bare).otherwise(
            F.concat(F.regexp_replace(bare, r"\d+\.\d+\.\d+\.\d+$", ""), tail_groups)
        )
    )
    halves = F.split(text, "::", 2)

    def hextets(part: Column) -> Column:
        return F.transform(
            F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")
        )

    left, right = hextets(F.get(halves, F.lit(0))), hextets(F.get(halves, F.lit(1)))
    gap = F.array_repeat(F.lit("0000"), F.lit(8) - F.size(left) - F.size(right))
    return F.when(is_ipv6(ip), F.array_join(F.concat(left, gap, right), ""))


def in_subnet(ip: Column, subnet: str) -> Column:
    """Membership of an address in a literal IPv4 or IPv6 subnet."""
    network = ip_network(subnet, strict=False)
    if network.version == 4:
        return F.coalesce(
            ipv4_number(ip).between(int(network.network_address), int(network.broadcast_address)), F.lit(False)
        )
    first, last = f"{int(network.network_address):032x}", f"{int(network.broadcast_address):032x}"
    return F.coalesce(ipv6_hex(ip).between(first, last), F.lit(False))


def is_usable_lab_host(ip: Column, subnet: str) -> Column:
    """A non-loopback host inside a private subnet, its network and broadcast addresses excluded."""
    network = ip_network(subnet, strict=False)
    if not network.is_private:
        raise ValueError("the lab subnet must be private")
    first, last = int(network.network_address), int(network.broadcast_address)
    if network.version == 4:
        reserved = F.coalesce(ipv4_number(ip).isin(first, last), F.lit(False))
    else:
        reserved = F.coalesce(ipv6_hex(ip).isin(f"{first:032x}", f"{last:032x}"), F.lit(False))
    return in_subnet(ip, subnet) & ~is_loopback(ip) & ~reserved
