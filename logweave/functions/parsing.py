"""Format detection and the parsers, as column expressions: no row leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import constants as C

Map = "map<string,string>"
SPACES = " \t\n\x0b\f\r"


def any_of(column: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(p) for p in patterns))


def lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def one_line(raw: Column) -> Column:
    """Trimmed, line feeds as spaces, carriage returns dropped."""
    return F.translate(strip(raw), "\n\r", " ")


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def group(column: Column, pattern: str, k: int) -> Column:
    """Group k of the first match, null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(column, pattern, k), F.lit(""))


def detect(event: Column) -> Column:
    """json, syslog, structured_text, kv or plain_text; null for blank events."""
    return let(strip(event), _format)


def _format(e: Column) -> Column:
    return (
        F.when(e == "", F.lit(None))
        .when(e.startswith("{") & F.try_parse_json(e).isNotNull(), "json")
        .when(e.startswith("<") | e.rlike(C.FORMAT_SYSLOG), "syslog")
        .when(e.startswith("[") | e.contains("|") | any_of(e, C.FORMAT_STRUCTURED), "structured_text")
        .when(e.contains("=") & e.contains(" ") & ~e.startswith("{"), "kv")
        .otherwise("plain_text")
    )


def routed(event: Column) -> Column:
    """The format that parsing takes: anything that begins with a brace is json without a look at its validity."""
    return let(strip(event), lambda e: F.when(e.startswith("{"), "json").otherwise(_format(e)))


def timestamp(text: Column, lenient: bool = False) -> Column:
    """Whole seconds of the five accepted forms, in UTC; null for others. lenient also takes Z, zone offsets after T, and commas before milliseconds."""
    return let(strip(text), lambda t: _timestamp(t, lenient))


def _timestamp(t: Column, lenient: bool) -> Column:
    whole = F.regexp_replace(F.regexp_replace(t, "T", " "), r"[.,]\d+", "")
    plain = r"^\d{4}-\d{1,2}-\d{1,2}(?:T|\s+)\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?$"
    zoned = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\s+(?:Z|[+-]\d{2}:?\d{2})$"
    single = F.regexp_replace(whole, r"\s+", " ")
    at = F.when(t.rlike(plain), F.try_to_timestamp(single, F.lit("yyyy-M-d H:m:s")))
    at = at.when(t.rlike(zoned), F.coalesce(F.try_to_timestamp(single, F.lit("yyyy-M-d H:m:s XXX")), F.try_to_timestamp(single, F.lit("yyyy-M-d H:m:s XX"))))
    if lenient:
        loose = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}(?:[.,]\d+)?\s*(?:Z|[+-]\d{2}:?\d{2})?$"
        bare = F.regexp_replace(single, r"\s*(?:Z|[+-]\d{2}:?\d{2})$", "")
        zone = F.regexp_extract(single, r"(Z|[+-]\d{2}:?\d{2})$", 1)
        with_zone = F.concat_ws(" ", bare, zone)
        at = at.when(t.rlike(loose), F.coalesce(F.try_to_timestamp(with_zone, F.lit("yyyy-M-d H:m:s XXX")), F.try_to_timestamp(with_zone, F.lit("yyyy-M-d H:m:s XX")), F.try_to_timestamp(bare, F.lit("yyyy-M-d H:m:s"))))
    return at.otherwise(F.lit(None).cast("timestamp"))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(at: Column, severity: Column, message: Column, host: Column | None = None, attributes: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(at.alias("event_ts"), severity.alias("severity"), message.alias("message"), (none if host is None else host).alias("host"), (F.create_map().cast(Map) if attributes is None else attributes.cast(Map)).alias("attributes"))


def parse_json(raw: Column, lenient: bool = False) -> Column:
    """Null where the event is no JSON object. Empty, zero, false and null values count as missing, as do empty lists and objects."""
    text = one_line(raw)
    both = F.struct(F.try_parse_json(text).alias("value"), F.from_json(text, Map).alias("entries"), text.alias("text"))
    return let(both, lambda b: _json_fields(b["value"], b["entries"], b["text"], lenient))


def _json_fields(value: Column, entries: Column, text: Column, lenient: bool) -> Column:
    keys = {"at": ("timestamp", "time", "@timestamp"), "level": ("level", "severity", "status"), "text": ("message", "msg")}

    def get(key: str) -> Column:
        missing = ("null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")
        found = lambda v: let(F.to_json(v), lambda literal: F.when(~literal.isin(*missing), F.coalesce(F.try_variant_get(v, "$", "string"), literal)))
        return let(F.try_variant_get(value, f"$['{key}']", "variant"), found)

    def first(values: Column, names: tuple[str, ...]) -> tuple[Column, Column]:
        """The first value that counts, and the keys that looking for it has taken out."""
        of = [values[n] for n in names]
        taken = F.array(*map(F.lit, names))
        for k in range(len(names) - 1, 0, -1):
            taken = F.when(F.coalesce(*of[:k]).isNotNull(), F.array(*map(F.lit, names[:k]))).otherwise(taken)
        return F.coalesce(*of), taken

    def build(values: Column) -> Column:
        (at, gone_at), (level, gone_level), (message, gone_text) = (first(values, names) for names in keys.values())
        rest = let(F.concat(gone_at, gone_level, gone_text), lambda gone: F.map_filter(entries, lambda k, v: ~F.array_contains(gone, k)))
        named = let(F.upper(strip(F.coalesce(level, F.lit("INFO")))), lambda x: lookup(C.NUMERIC_LEVELS, x, x))
        return let(rest, lambda r: fields(timestamp(at, lenient), named, strip(F.coalesce(message, F.to_json(r))), None, r))

    values = F.struct(*[get(k).alias(k) for names in keys.values() for k in names])
    return F.when(value.isNotNull() & text.startswith("{") & entries.isNotNull(), let(values, build))


def parse_syslog(raw: Column, lenient: bool = False) -> Column:
    return let(one_line(raw), lambda text: _syslog_fields(text, lenient))


def _syslog_fields(text: Column, lenient: bool) -> Column:
    def build(pattern: str, priority: Column, default: Column | None = None) -> Column:
        p = "(?s)" + pattern
        code = F.pmod(priority, F.lit(8)) if default is None else F.coalesce(F.pmod(priority, F.lit(8)), default)
        app = strip(F.regexp_extract(text, p, 4))
        level = lookup(C.SYSLOG_LEVELS, code.cast("int"), F.lit("INFO"))
        attributes = F.map_filter(F.create_map(F.lit("syslog_app_name"), app, F.lit("syslog_priority"), priority.cast("string")), lambda k, v: v.isNotNull())
        return F.when(text.rlike(p), fields(timestamp(F.regexp_extract(text, p, 2), lenient), level, F.concat(app, F.lit(": "), strip(F.regexp_extract(text, p, 5))), strip(F.regexp_extract(text, p, 3)), attributes))

    number = lambda pattern: F.regexp_extract(text, "(?s)" + pattern, 1).try_cast("bigint")
    return F.coalesce(build(C.RFC5424, number(C.RFC5424)), build(C.RFC3164, number(C.RFC3164), F.lit(6)))


def parse_access(raw: Column, lenient: bool = False) -> Column:
    return let(one_line(raw), lambda text: _access_fields(text, lenient))


def _access_fields(text: Column, lenient: bool) -> Column:
    p = "(?s)" + C.ACCESS_LOG
    status = F.regexp_extract(text, p, 4).try_cast("int")
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")
    message = F.concat(strip(F.regexp_extract(text, p, 3)), F.lit(" (HTTP "), status.cast("string"), F.lit(")"))
    size = F.regexp_replace(F.regexp_extract(text, p, 5), "^0+(?=.)", "")
    return F.when(text.rlike(p), fields(timestamp(F.regexp_extract(text, p, 2), lenient), level, message, F.regexp_extract(text, p, 1), F.create_map(F.lit("http_status_code"), status.cast("string"), F.lit("response_size_bytes"), size)))


def parse_structured(raw: Column, lenient: bool = False) -> Column:
    return let(one_line(raw), lambda text: F.coalesce(_access_fields(text, lenient), _bracket_fields(text, lenient)))


def _bracket_fields(text: Column, lenient: bool) -> Column:
    p = "(?s)" + C.BRACKETED
    rest = F.regexp_extract(text, p, 3)
    at = F.regexp_replace(F.regexp_extract(text, p, 1), r"^[\[\] ]+|[\[\] ]+$", "")
    return F.when(text.rlike(p), fields(timestamp(at, lenient), F.upper(F.coalesce(group(text, p, 2), F.lit("INFO"))), F.when(rest == "", text).otherwise(strip(rest))))


def parse_kv(raw: Column, lenient: bool = False) -> Column:
    """Last key wins; numbers are written as they are inferred (leading zeros and quotes go)."""
    p = "(?s)" + C.KEY_VALUE
    clean = lambda v: F.regexp_replace(v, "^[\"']+|[\"']+$", "")
    number = lambda v: F.when(v.rlike(r"^\d+$"), F.regexp_replace(v, "^0+(?=.)", "")).otherwise(v)

    def entries(text: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("v"))
        last = lambda found: F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["k"] == e["k"]))
        return F.map_from_entries(F.transform(let(pairs, last), lambda e: F.struct(e["k"].alias("key"), number(clean(e["v"])).alias("value"))))

    return let(one_line(raw), lambda text: let(entries(text), lambda found: _kv_fields(text, found, lenient)))


def _kv_fields(text: Column, entries: Column, lenient: bool) -> Column:
    def get(key: str) -> Column:
        v = F.try_element_at(entries, F.lit(key))
        return F.when((v == "") | v.try_cast("double").eqNullSafe(F.lit(0.0)), None).otherwise(v)

    def taken(first: str, second: str) -> Column:
        return F.when(get(first).isNull(), F.array(F.lit(first), F.lit(second))).otherwise(F.array(F.lit(first)))

    gone = F.concat(taken("timestamp", "time"), taken("level", "severity"), taken("msg", "message"))
    level = F.coalesce(get("level"), get("severity"), group(text, C.KV_BRACKET_LEVEL, 1), F.lit("INFO"))
    message = F.coalesce(get("msg"), get("message"), after_dash(text))
    trimmed = lambda v: F.regexp_replace(v, "^[\"' ]+|[\"' ]+$", "")
    return fields(timestamp(F.coalesce(get("timestamp"), get("time")), lenient), trimmed(F.upper(level)), trimmed(message), None, let(gone, lambda g: F.map_filter(entries, lambda k, v: ~F.array_contains(g, k))))


def after_dash(text: Column) -> Column:
    return F.element_at(F.split(text, " - ", -1), -1)


def parse_plain(raw: Column, lenient: bool = False) -> Column:
    return let(one_line(raw), lambda text: _plain_fields(text, lenient))


def _plain_fields(text: Column, lenient: bool) -> Column:
    return fields(timestamp(F.regexp_extract(text, C.LEADING_DATE, 1), lenient), F.upper(F.coalesce(group(text, C.BRACKET_LEVEL, 1), F.lit("INFO"))), strip(after_dash(text)))


def upgraded(severity: Column, raw: Column) -> Column:
    """INFO becomes the level in brackets, or ERROR where the event speaks of a failure."""
    words = let(F.lower(raw), lambda text: reduce(lambda a, b: a | b, (text.contains(w) for w in C.UPGRADE_WORDS)))
    found = lambda level: F.when(~level.eqNullSafe("INFO"), level).when(raw.rlike(C.UPGRADE_LEVEL), F.upper(F.regexp_extract(raw, C.UPGRADE_LEVEL, 1))).when(words, "ERROR").otherwise(level)
    return let(F.upper(severity), found)


def event_id(*parts: Column) -> Column:
    """13 hex digits of the SHA-1 of the parts, joined by bars; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 13)


def parse(events: DataFrame, event_col: str = "event", order: tuple[str, ...] = ("file", "line_no"), ingest: Column | None = None, lenient: bool = False) -> DataFrame:
    """Canonical events: the columns of `order`, then event_id, event_ts, event_ts_parsed, severity, message, source, service, host, raw, attributes, parser_fallback.

    Blank events go. An event that its format's parser can't read is read as plain text, and keeps the format as its source. Time that
    can't be read is the ingest time (a constant of the run unless given).
    """
    e = F.col(event_col)
    now = F.current_timestamp() if ingest is None else ingest
    rows = events.where(strip(e) != "").withColumn("_source", routed(e))
    parsed = F.when(F.col("_source") == "json", parse_json(e, lenient)).when(F.col("_source") == "syslog", parse_syslog(e, lenient)).when(F.col("_source") == "structured_text", parse_structured(e, lenient)).when(F.col("_source") == "kv", parse_kv(e, lenient)).otherwise(parse_plain(e, lenient))
    rows = rows.withColumn("_out", let(parsed, lambda p: F.struct(F.coalesce(p, parse_plain(e, lenient)).alias("fields"), p.isNull().alias("fallback"))))
    f = lambda name: F.col(f"_out.fields.{name}")
    service = F.coalesce(*[F.nullif(F.try_element_at(f("attributes"), F.lit(k)), F.lit("")) for k in C.SERVICE_KEYS])
    return rows.select(
        *order, event_id(*[F.col(c) for c in order], e).alias("event_id"), F.coalesce(f("event_ts"), now).alias("event_ts"), f("event_ts").isNotNull().alias("event_ts_parsed"),
        upgraded(f("severity"), e).alias("severity"), F.coalesce(F.nullif(f("message"), F.lit("")), e).alias("message"), F.col("_source").alias("source"), service.alias("service"), f("host").alias("host"), e.alias("raw"), f("attributes").alias("attributes"),
        F.col("_out.fallback").alias("parser_fallback"),
    )
