"""Compact events: projection, attribute list, cleaning and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import constants as C

MESSAGE_CHARS = 1600


def redact(message: Column) -> Column:
    return F.regexp_replace(message, C.SECRET, "$1=[REDACTED]")


def clean_message(message: Column, limit: int = MESSAGE_CHARS) -> Column:
    text = F.regexp_replace(F.translate(message, "\0\r", "  "), "\n", " | ")
    for prefix in C.MESSAGE_PREFIXES:
        text = F.regexp_replace(text, prefix, "")
    return F.substring(F.trim(F.regexp_replace(redact(text), r"\s+", " ")), 1, limit)


def kept_attributes(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, v: k.isin(*C.KEPT_ATTRIBUTES) & v.isNotNull() & (v != ""))


def source_alias(source: Column, attributes: Column) -> Column:
    value = F.lower(F.coalesce(source, F.lit("unknown")))
    return F.when(value.contains("structured"), F.when(F.map_contains_key(attributes, "http_status_code"), "http").otherwise("container_or_application")).otherwise(value)


def milliseconds(value: Column) -> Column:
    """Milliseconds as text of epoch seconds or milliseconds."""
    return F.when(value < 1e10, value * 1000).otherwise(value).cast("bigint").cast("string")


def compact(events: DataFrame, *keep: str) -> DataFrame:
    """Enriched, scored events as the incident stages carry them, and the columns `keep`."""
    optional = ["service_family", "inferred_service", "inferred_service_family", "component", "framework", "runtime", "library", "exception_type", "error_family", "domain"]
    return events.select(
        *keep, "event_id", F.unix_millis("event_ts").cast("string").alias("event_time"), "event_ts", F.upper("severity").alias("severity"), F.coalesce(F.nullif(F.trim("service"), F.lit("")), F.lit("unknown")).alias("service"),
        source_alias(F.col("source"), F.col("attributes")).alias("source"), clean_message(F.col("message")).alias("message"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in optional],
        "risk_score", F.col("window_count_1m").alias("occurrences_1m"), kept_attributes(F.col("attributes")).alias("attributes"), "correlation_tokens",
    )


def as_json(events: DataFrame) -> DataFrame:
    """event_id and the compact event as JSON without null fields."""
    return events.select("event_id", F.to_json(F.struct(*[c for c in events.columns if c not in ("event_ts", "correlation_tokens")]), {"ignoreNullFields": "true"}).alias("payload"))
