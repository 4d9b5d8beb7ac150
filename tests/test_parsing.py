import pytest
from pyspark.sql import functions as F

from logweave.functions import context, parsing, scoring, signal

LINES = {
    "F-1": "2026-09-16 15:03:00 [ERROR] payment-api: primary DB timeout",
    "F-2": '{"level":50,"msg":"db connection refused","service":"order-service","time":"2026-09-16T15:03:05"}',
    "F-3": '10.220.13.38 - - [17/Mar/2026:18:47:33 +0300] "GET /api/payment/1 HTTP/1.1" 502 123',
    "F-4": "Mar 17 18:47:33 web01 sshd[123]: Failed password for root",
    "F-5": 'level=error msg="cache miss timeout" port=6379 user_id=42',
    "F-6": "Traceback (most recent call last): | File x | ValueError: bad",
    "F-7": "I0405 12:27:01.474459 1 main.go:277] starting",
    "F-8": "worker background job completed",
    "F-9": '{"level":"INFO","error":null}',
    "F-10": "<131>1 2026-09-16T15:03:05Z web01 payments conn reset",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(k, 1, v) for k, v in LINES.items()] + [("blank", 1, "  ")], "file string, line_no int, event string")
    ingest = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return {r["file"]: r.asDict() for r in context.enrich(parsing.parse(rows, ingest=ingest)).collect()}


@pytest.mark.parametrize(
    "key, want",
    [
        ("F-1", {"source": "structured_text", "severity": "ERROR", "message": "payment-api: primary DB timeout", "event_ts_parsed": True, "inferred_service": "payment-api", "inferred_service_family": "payment", "error_family": "timeout", "domain": "payment"}),
        ("F-2", {"source": "json", "severity": "ERROR", "message": "db connection refused", "service": "order-service", "service_family": "order", "error_family": "connection", "domain": "order", "event_ts_parsed": True}),
        ("F-3", {"source": "structured_text", "severity": "ERROR", "message": "GET /api/payment/1 HTTP/1.1 (HTTP 502)", "host": "10.220.13.38", "error_family": "http_5xx", "inferred_service": "payment-api", "event_ts_parsed": False}),
        ("F-4", {"source": "syslog", "severity": "ERROR", "message": "sshd[123]: Failed password for root", "service": "sshd[123]", "error_family": "other"}),
        ("F-5", {"source": "kv", "severity": "ERROR", "message": "cache miss timeout", "attributes": {"port": "6379", "user_id": "42"}, "error_family": "timeout"}),
        ("F-6", {"source": "structured_text", "severity": "ERROR", "exception_type": "ValueError", "error_family": "application_error"}),
        ("F-7", {"source": "structured_text", "parser_fallback": True, "severity": "INFO", "message": LINES["F-7"]}),
        ("F-8", {"source": "plain_text", "severity": "INFO", "message": LINES["F-8"], "inferred_service": "worker"}),
        ("F-9", {"source": "json", "severity": "ERROR"}),
        ("F-10", {"source": "syslog", "severity": "ERROR", "message": "payments: conn reset", "host": "web01", "event_ts_parsed": False}),
    ],
)
def test_fixture(parsed, key, want):
    assert {k: parsed[key][k] for k in want} == want


def test_blank_events_go(parsed):
    assert set(parsed) == set(LINES)


def test_case_insensitive_bracket_class_eats_the_head(parsed):
    assert parsed["F-6"]["message"].startswith("raceback (most recent")


def test_lenient_timestamps(spark):
    row = spark.range(1).select(*[parsing.timestamp(F.lit(t), lenient).isNotNull().alias(f"c{k}") for k, (t, lenient) in enumerate([("2026-09-16T15:03:05Z", False), ("2026-09-16T15:03:05Z", True), ("2026-09-16 15:03:05,498", False), ("2026-09-16 15:03:05,498", True), ("2026-09-16T15:03:05+03:00", True)])]).first()
    assert list(row) == [False, True, False, True, True]


@pytest.mark.parametrize(
    "severity, count, entropy, confidence, score, actionable",
    [("ERROR", 1, 4.0, 0.5, 50, True), ("WARNING", 120, 4.0, 0.5, 48, False), ("WARNING", 500, 4.0, 0.5, 60, True), ("INFO", 600, 4.0, 0.5, 20, False), ("INFO", 1, 6.5, 0.3, 45, False), ("FATAL", 1, 4.0, 0.5, 10, False), ("CRITICAL", 500, 6.5, 0.3, 100, True)],
)
def test_scores(spark, severity, count, entropy, confidence, score, actionable):
    row = scoring.score(spark.createDataFrame([(severity, count, entropy, confidence)], "severity string, window_count_1m long, entropy double, confidence double")).first()
    assert (row["risk_score"], row["is_actionable"]) == (score, actionable)


def test_confidence(spark):
    row = spark.range(1).select(signal.confidence(F.lit("a b <*> <NUM>"), F.lit(1)).alias("a"), signal.confidence(F.lit("a b"), F.lit(10)).alias("b")).first()
    assert row["a"] == 0.25 and row["b"] == 0.75


def test_masks_and_protected_words(spark):
    row = spark.range(1).select(signal.prepared(F.lit("User 'x'  Failed from 10.0.0.1 port 22 at /var/log/a.log 0xFF"), F.create_map(F.lit("port"), F.lit("22"))).alias("t")).first()
    assert row["t"] == "FIX_user x FIX_failed from <IP> <PORT> <PORT> at <PATH> <HEX>" or row["t"].startswith("FIX_user x FIX_failed from <IP> port <PORT> at <PATH>")
