"""Context of an event: service, component, framework, error family, domain, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import constants as C
from logweave.functions.parsing import group, lookup


def normal_service(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "_", "-")


def family(value: Column) -> Column:
    """The service without one suffix of its kind."""
    return F.regexp_replace(normal_service(value), "-(?:service|api|worker|client)$", "")


def graph_family(value: Column) -> Column:
    """Families as the causal graph names them: aliases, suffixes, synonyms of the database."""
    v = normal_service(F.coalesce(value, F.lit("unknown")))
    bare = family(v)
    return F.when(v == "", "unknown").otherwise(lookup(C.ALIASES, v, F.when(bare.isin("db", "postgres", "postgresql"), "database").otherwise(bare)))


def component(raw: Column) -> Column:
    return group(raw, C.CLASS_NAME, 1)


def exception_type(raw: Column) -> Column:
    return group(raw, C.EXCEPTION_NAME, 1)


def infer_service(raw: Column, message: Column) -> Column:
    """A route, else the prefix of an application class, else the first noun of the list."""
    low = F.lower(F.concat_ws(" ", raw, message))
    route = F.lower(group(raw, C.API_PATH, 1))
    name = component(raw)
    prefix = F.lower(F.regexp_replace(name, "(?i)(?:Service|Controller|Client|Worker)$", ""))
    by_class = F.when(prefix.isin(*C.CLASS_PREFIXES), F.when(name.rlike("Service$"), F.concat(prefix, F.lit("-service"))).otherwise(prefix))
    nouns = [F.when(low.rlike(rf"\b{n}(?:-api|-service)?\b"), F.when(low.rlike(rf"\b{n}-api\b"), f"{n}-api").otherwise(n)) for n in C.SERVICE_NOUNS]
    return F.coalesce(F.concat(route, F.lit("-api")), by_class, *nouns)


def framework(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("springframework"), "spring").when(low.contains("django"), "django").when(low.contains("flask"), "flask").when(low.contains("fastapi") | low.contains("uvicorn"), "fastapi")


def runtime(raw: Column) -> Column:
    low = F.lower(raw)
    python = low.contains("traceback") & (low.contains(".py") | low.contains("python"))
    jvm = low.contains("java.lang.") | low.contains("java:") | low.contains("org.springframework")
    return F.when(low.contains("node:internal") | low.contains("axios"), "nodejs").when(python, "python").when(jvm, "jvm")


def library(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("axios"), "axios").when(low.contains("resttemplate") | low.contains("org.springframework.web.client"), "spring-resttemplate")


def error_family(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return (
        F.when(has("retry"), "retry")
        .when(has("timeout", "timed out"), "timeout")
        .when(has("connection", "econnreset"), "connection")
        .when(has("http 5"), "http_5xx")
        .when(has("not found"), "not_found")
        .when(has("nullpointer", "exception", "traceback", "error"), "application_error")
        .otherwise("other")
    )


def domain(text: Column, service_family: Column | None = None) -> Column:
    low = F.lower(text)
    found = F.coalesce(*[F.when(low.rlike(rf"\b{n}(?:-api|-service)?\b"), n) for n in C.DOMAIN_NOUNS], F.lit("unknown"))
    if service_family is None:
        return found
    known = F.lower(service_family)
    return F.when(known.isNotNull() & (known != "") & (known != "unknown"), known).otherwise(found)


def tokens(text: Column) -> Column:
    """Distinct tokens in lower case without stop words."""
    return F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(0)), F.lower)), F.array(*[F.lit(w) for w in C.STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def enrich(events: DataFrame) -> DataFrame:
    """Canonical events with their context."""
    text = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("raw"))
    raw = F.coalesce(F.nullif(F.col("raw"), F.lit("")), F.col("message"))
    given = F.coalesce(F.nullif(F.trim("service"), F.lit("")), *[F.nullif(F.trim(F.try_element_at(F.col("attributes"), F.lit(k))), F.lit("")) for k in C.SERVICE_KEYS])
    rows = events.withColumns({"_given": given, "_guess": infer_service(raw, F.col("message"))})
    known = F.col("_given").isNotNull()
    rows = rows.withColumns(
        {
            "service": F.when(known, normal_service(F.col("_given"))).otherwise("unknown"),
            "service_family": F.when(known, family(F.col("_given"))).otherwise("unknown"),
            "inferred_service": F.when(~known, normal_service(F.col("_guess"))),
            "inferred_service_family": F.when(~known, family(F.col("_guess"))),
            "component": component(raw), "framework": framework(raw), "runtime": runtime(raw), "library": library(raw), "exception_type": exception_type(raw),
            "error_family": error_family(text),
        }
    )
    return rows.withColumns({"domain": domain(text, F.col("service_family")), "correlation_tokens": tokens(text)}).drop("_given", "_guess")
