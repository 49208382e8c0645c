"""Access rules, request keys and key/value row checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import as_col, whole_match

# Scopes, key limits and patterns.
SCOPES = {
    "jobs": "jobs:read",
    "runs": "runs:read",
    "runs_write": "runs:write",
    "events": "events:read",
    "sources": "sources:read",
    "sources_write": "sources:write",
}
KEY_MAX_BYTES = 256
VALUE_MAX_BYTES = 8192
NAMESPACE_PATTERN = "^[a-zA-Z0-9_]+$"
REQUEST_KEY_PATTERN = "^[A-Za-z0-9_-]{20,128}$"


def required_scopes(
    method: str | Column,
    path: str | Column,
    *,
    kv_read: str = "kv:read",
    kv_write: str = "kv:write",
) -> Column:
    """Scopes a request needs; an empty array when no rule applies.

    The key/value scope names are deployment-specific and passed in.
    """
    m, p = as_col(method), as_col(path)

    def need(*names: str) -> Column:
        return F.array(*[F.lit(SCOPES.get(n, n)) for n in names])

    run, source, kv = p.startswith("/runs/"), p.startswith("/sources/"), p.startswith("/kv/")
    stream = run & (p.endswith("/events") | p.endswith("/events.ndjson"))
    get = (
        F.when(p.isin("/jobs", "/health/storage"), need("jobs"))
        .when(stream, need("runs", "events"))
        .when((p == "/runs") | run, need("runs"))
        .when((p == "/sources") | source, need("sources"))
        .when(p == "/events", need("events"))
        .when(kv, need(kv_read))
    )
    post = (
        F.when(p == "/plans", need("jobs"))
        .when(p == "/runs", need("runs_write"))
        .when(p == "/sources", need("sources_write"))
        .when(kv, need(kv_write))
    )
    delete = F.when(source, need("sources_write")).when(kv, need(kv_write))
    rules = (
        F.when(m == "GET", get)
        .when(m == "POST", post)
        .when(m == "DELETE", delete)
        .when((m == "PUT") & kv, need(kv_write))
    )
    return F.coalesce(rules, F.array().cast("array<string>"))


def missing_scopes(required: Column, granted: Column) -> Column:
    return F.array_except(required, F.coalesce(granted, F.array().cast("array<string>")))


def request_key_valid(key: str | Column) -> Column:
    return whole_match(key, REQUEST_KEY_PATTERN)


def scoped_request_key(principal: str | Column, key: str | Column) -> Column:
    """Keys of different principals never meet."""
    who, k = as_col(principal), as_col(key)
    return F.when(who.isNull() | (who == ""), k).otherwise(
        F.concat(F.sha2(who, 256), F.lit(":"), k)
    )


def kv_check(
    namespace: str | Column,
    key: str | Column,
    value: str | Column,
    *,
    base64: bool = False,
) -> Column:
    """First failed check of a key/value write, or ``ok``."""
    ns, k, v = as_col(namespace), as_col(key), as_col(value)
    bad_text = F.lit(False)
    if base64:
        v = F.try_to_binary(v, F.lit("base64"))
        bad_text = v.isNull()
    return (
        F.when(k.isNull() | (F.octet_length(k) == 0), "key_required")
        .when(bad_text, "value_not_base64")
        .when(F.octet_length(k) > KEY_MAX_BYTES, "key_too_large")
        .when(F.octet_length(v) > VALUE_MAX_BYTES, "value_too_large")
        .when(~F.coalesce(whole_match(ns, NAMESPACE_PATTERN), F.lit(False)), "namespace_invalid")
        .otherwise("ok")
    )
