"""Time, identifier, unit and safe-arithmetic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte multiples by upper-cased unit.
UNIT_BYTES = {
    "B": 1,
    "KB": 1000,
    "MB": 1000**2,
    "GB": 1000**3,
    "TB": 1000**4,
    "KIB": 1024,
    "MIB": 1024**2,
    "GIB": 1024**3,
    "TIB": 1024**4,
}


def parse_time(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, null when it is not one (bare times of day are refused)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def nonnegative_seconds(earlier: Column, later: Column) -> Column:
    delta = seconds_between(earlier, later)
    return F.when(delta >= 0, delta)


def iso_text(ts: Column) -> Column:
    """One fixed UTC text form; identifiers hash it."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def short_hash(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


def session_key(source_ip: Column, start: Column) -> Column:
    return short_hash("SES-", F.concat_ws("|", source_ip, iso_text(start)))


def detection_key(session_id: Column, rule_id: Column) -> Column:
    return short_hash("DET-", F.concat_ws(":", session_id, rule_id))


def is_finite(value: Column) -> Column:
    """True for a non-null, non-NaN, non-infinite number."""
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def byte_quantity(text: Column) -> Column:
    """'1.5MiB' to bytes, null when number or unit is not understood."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*$"
    amount = F.regexp_extract(text, pattern, 1).try_cast("double")
    units = F.create_map(*[F.lit(item) for pair in UNIT_BYTES.items() for item in pair])
    unit = F.try_element_at(units, F.upper(F.regexp_extract(text, pattern, 2)))
    return F.bround(amount * unit, 0).cast("bigint")


def percent(text: Column) -> Column:
    """'1.5%' to 1.5; empty and '--' are null."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")


def config_fingerprint(config: Column, revision: Column, schema_version_key: str = "schema_version") -> Column:
    """SHA-256 of the compact, key-sorted JSON of the evaluation configuration.

    `schema_version_key` is the name that field carries in the hashed JSON; set it to keep
    fingerprints of an existing deployment. A missing value or an unknown revision gives null.
    """
    fields = {
        "brute_force_threshold": config["brute_force_threshold"],
        "detector_ruleset_version": config["detector_ruleset_version"],
        "multi_service_threshold": config["multi_service_threshold"],
        schema_version_key: config["schema_version"],
        "session_timeout_seconds": config["session_timeout_seconds"],
        "software_revision": revision,
        "web_enumeration_threshold": config["web_enumeration_threshold"],
    }
    complete = has_revision(revision)
    for value in fields.values():
        complete = complete & value.isNotNull()
    text = F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))
    return F.when(complete, F.sha2(text, 256))


def has_revision(revision: Column) -> Column:
    """The revision text is present, not blank and not 'unknown'."""
    text = F.coalesce(revision, F.lit(""))
    return (F.trim(text) != "") & (F.lower(text) != "unknown")
