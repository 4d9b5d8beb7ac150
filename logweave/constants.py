"""Word lists, tables, patterns and limits that results depend on."""

from __future__ import annotations

# Names of months and levels in the patterns below.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
LEVELS = "INFO|ERROR|WARN|WARNING|DEBUG|TRACE|FATAL|CRITICAL"

# First lines of log events (the built-in header), and the checks for lines that look like headers.
HEADER = (
    r"^(?:\{"
    r"|<\d{1,3}>"
    r"|\S+\s+\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:[.,]\d{3,6})?"
    r"|\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"
    r"|\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}"
    r"|\d{1,3}(?:\.\d{1,3}){3}\s+\S+\s+\S+\s+\["
    rf"|(?:{MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}"
    r"|[IWEF]\d{4}\s+\d{2}:\d{2}:\d{2}"
    rf"|(?:{LEVELS})\s+\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}"
    rf"|(?:{LEVELS})\s*[:|\-]"
    r"|Traceback \(most recent call last\):"
    r")"
)
STRONG_HEADERS = (
    rf"(?i)^(?:\d{{4}}-\d{{2}}-\d{{2}}[T\s]\d{{2}}:\d{{2}}:\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}}|(?:{MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})",
    r"(?i)^\S+\s+\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}",
    r"^\d{1,3}(?:\.\d{1,3}){3}\s+\S+\s+\S+\s+\[",
    r"^\s*\{",
    r"^<\d{1,3}>",
    r"^[IWEF]\d{4}\s+\d{2}:\d{2}:\d{2}",
    rf"(?i)^(?:{LEVELS})\s+\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}",
    rf"(?i)^(?:{LEVELS})\s*[:|\-]",
)
CATCH_ALLS = ("^.*", "^.*$", ".*", r"^\S+", r"^\S+$")

# Format detection and the parsers' patterns.
FORMAT_SYSLOG = rf"^(?:{MONTHS})\s+\d+\s+\d{{2}}:\d{{2}}:\d{{2}}"
FORMAT_STRUCTURED = (
    r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+\S+\s+\S+\s+\[",
    r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}",
    r"^\d{2}/\d{2}/\d{4}\s\d{2}:\d{2}:\d{2}",
    r"^[IWEF]\d{4}\s\d{2}:\d{2}:\d{2}\.\d+",
    rf"^(?:{LEVELS})\s+\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\[",
)
RFC5424 = r"<(\d+)>v?\d?\s+([\d\-T:\.Z\+]+)\s+(\S+)\s+(\S+)\s+(.*)"
RFC3164 = r"(?:<(\d+)>)?\s*([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s+(.*)"
ACCESS_LOG = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(.*?)"\s+(\d{3})\s+(\d+)'
BRACKETED = r"(?i)^\[?([\d\-:\sT\.Z]+)\]?\s*(?:\[(ERROR|WARN|WARNING|INFO|DEBUG|CRITICAL|FATAL)\])?\s*(.*)"
KEY_VALUE = r'([a-zA-Z0-9_]+)=(".*?"|\S+)'
LEADING_DATE = r"^([\d\-:\sT\.Z/]+)\s*\[?"
BRACKET_LEVEL = r"(?i)\[(ERROR|WARN|WARNING|INFO|DEBUG|CRITICAL|FATAL)\]"
KV_BRACKET_LEVEL = r"(?i)\[(ERROR|WARN|INFO|DEBUG|CRITICAL|FATAL)\]"
UPGRADE_LEVEL = r"(?i)\[(ERROR|WARN|CRITICAL|FATAL|DEBUG)\]"
UPGRADE_WORDS = ("failed", "timeout", "exception", "error")
SYSLOG_LEVELS = {0: "EMERGENCY", 1: "ALERT", 2: "CRITICAL", 3: "ERROR", 4: "WARNING", 5: "NOTICE", 6: "INFO", 7: "DEBUG"}
NUMERIC_LEVELS = {"10": "TRACE", "20": "DEBUG", "30": "INFO", "40": "WARNING", "50": "ERROR", "60": "FATAL"}

# Context inference.
SERVICE_KEYS = ("service", "service_name", "app", "application", "syslog_app_name")
CLASS_NAME = r"\b([A-Z][A-Za-z0-9]+(?:Service|Controller|Client|Worker))\b"
API_PATH = r"(?i)/api/([a-z][a-z0-9_-]{1,40})\b"
EXCEPTION_NAME = r"\b([A-Za-z][A-Za-z0-9_]*(?:Exception|Error))\b"
TOKEN = r"(?i)[a-z][a-z0-9_/-]{2,}"
CLASS_PREFIXES = ("payment", "order", "identity", "gateway", "checkout", "user", "auth")
SERVICE_NOUNS = ("payment", "order", "identity", "gateway", "checkout", "redis", "scheduler", "worker", "database", "postgres")
DOMAIN_NOUNS = ("payment", "order", "identity", "gateway", "checkout", "database", "redis", "scheduler", "worker", "user")
STOP_WORDS = ("the", "and", "with", "from", "because", "failed", "error", "warn", "info", "request", "process", "attempt")

# Templates.
PROTECTED = ("login", "logout", "failed", "refused", "connect", "timeout", "success", "denied", "authorized", "started", "stopped", "password", "invalid", "user", "root")
MASKED_ATTRIBUTES = ("user_id", "dest_ip", "source_ip", "token", "session_id", "port", "process_id")
MASKS = (
    ("<IP>", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("<UUID>", r"\b[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b"),
    ("<NUM>", r"\b\d+\b"),
    ("<HEX>", r"\b0x[0-9a-fA-F]+\b"),
    ("<PATH>", r"(/[a-zA-Z0-9\._\-]+)+"),
)

# Scores.
SEVERITY_SCORES = {"DEBUG": 0, "INFO": 10, "NOTICE": 20, "WARNING": 30, "ERROR": 50, "CRITICAL": 80, "ALERT": 90, "EMERGENCY": 100}
ALWAYS_ACTIONABLE = ("ERROR", "CRITICAL", "ALERT", "EMERGENCY")

# Compact events.
KEPT_ATTRIBUTES = ("service", "service_name", "app", "application", "host", "hostname", "trace_id", "span_id", "request_id", "correlation_id", "http_status_code", "response_size_bytes", "syslog_app_name")
SECRET = r"(?i)(password|passwd|token|secret|api[_-]?key)=([^\s,;&]+)"

MESSAGE_PREFIXES = (
    r"(?i)^\s*(?:stdout|stderr)\s+F\s+",
    r"(?i)^\s*(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|ALERT|FATAL|EMERGENCY)\s*[:\-]?\s*",
)

# Causal graph.
DEPENDENCIES = (
    ("database", "payment"), ("database", "order"), ("database", "gateway"), ("database", "checkout"), ("postgres", "payment"), ("postgres", "order"), ("redis", "payment"), ("redis", "order"),
    ("redis", "gateway"), ("identity", "payment"), ("identity", "order"), ("identity", "gateway"), ("payment", "gateway"), ("payment", "checkout"), ("order", "gateway"), ("order", "checkout"), ("checkout", "gateway"),
)
ALIASES = {
    "payment-api": "payment", "payment-service": "payment", "payment-worker": "payment", "order-api": "order", "order-service": "order", "order-worker": "order", "identity-api": "identity",
    "identity-service": "identity", "auth": "identity", "auth-service": "identity", "postgresql": "database", "postgres-db": "database", "postgres": "database", "db": "database", "database-service": "database",
    "redis-cache": "redis", "redis-service": "redis", "gateway-api": "gateway", "gateway-service": "gateway", "checkout-api": "checkout", "checkout-service": "checkout",
}
INFRASTRUCTURE = ("database", "redis", "cache", "kafka", "queue", "identity", "storage", "dns")
APPLICATIONS = ("payment", "order", "checkout", "gateway", "notification", "search", "user", "recommendation", "api", "application")
