"""Queries over metric observations, access logs and spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.operators import journal as J
from runlens.operators import metrics as M
from runlens.operators.quantiles import nearest_rank
from runlens.queries import checks, journal

BUCKET = 1 << 16
QUANTILES = (0.5, 0.95, 0.99)

# Label sets that always appear, whether or not a row carries them.
KNOWN_TYPES = (("click",), ("error",), ("purchase",), ("signup",), ("view",), ("deploy",))


def event_counters(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.load(spark, sf, "events")
    return M.counters(
        events, ["event_type"], amount=F.octet_length("props"), known=KNOWN_TYPES
    )


def eviction_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Evicted journal rows and expired request bodies, by kind."""
    log = tables.load(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", " Journal ")
        .when(F.col("event_type") == "view", "")
        .otherwise("other").alias("kind"),
        (F.get_json_object("props", "$.k").cast("long") - 10).alias("bytes"),
    )
    return M.eviction_counters(log)


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    """``events.value`` as latency: event type names the operation, the user the outcome."""
    operation = (
        F.when(F.col("event_type") == "click", " Journal_Append")
        .when(F.col("event_type") == "view", "journal_read")
        .otherwise(F.col("event_type"))
    )
    outcome = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, "ERROR").otherwise("hit")
    return tables.load(spark, sf, "events").select(
        operation.alias("operation"), outcome.alias("outcome"), (F.col("value") - 0.5).alias("value_ms")
    )


def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    wide = M.latency_histogram(_latencies(spark, sf))
    rows = M.histogram_rows(wide, ["operation", "outcome"], M.LATENCY_BUCKETS)
    return rows.select("operation", "outcome", "le", "n")


def histogram_totals(spark: SparkSession, sf: str) -> DataFrame:
    wide = M.latency_histogram(_latencies(spark, sf))
    return wide.select("operation", "outcome", "count", F.round("sum", 6).alias("sum"))


_LATENCY_SQL = """obs AS (
  SELECT CASE event_type WHEN 'click' THEN 'journal_append' WHEN 'view' THEN 'journal_read'
              ELSE event_type END AS operation,
         CASE user_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'hit' END AS outcome,
         value - 0.5 AS v
  FROM events WHERE value - 0.5 >= 0
), known(operation, outcome) AS (
  VALUES ('idempotency_lookup', 'hit'), ('idempotency_lookup', 'miss'),
         ('idempotency_lookup', 'expired'), ('idempotency_lookup', 'error'),
         ('idempotency_store', 'ok'), ('idempotency_store', 'error'),
         ('journal_append', 'ok'), ('journal_append', 'quota_exceeded'), ('journal_append', 'error'),
         ('journal_read', 'ok'), ('journal_read', 'error')
), every_obs AS (
  SELECT operation, outcome, v FROM obs UNION ALL SELECT operation, outcome, NULL FROM known
)"""


def container_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Run durations without labels: days between order and shipping as seconds."""
    runs = tables.load(spark, sf, "lineitem").select(F.col("l_quantity").alias("seconds"))
    wide = M.histogram(runs, [], "seconds", M.CONTAINER_BUCKETS)
    return M.histogram_rows(wide, [], M.CONTAINER_BUCKETS).select("le", "n")


def gauge_clamped(spark: SparkSession, sf: str) -> DataFrame:
    deltas = tables.load(spark, sf, "events").select(
        F.col("event_type").alias("transport"),
        F.col("event_id").alias("ord"),
        (F.get_json_object("props", "$.k").cast("long") - 50).alias("delta"),
    )
    return M.gauge_clamped(deltas, "transport", "ord", "delta", bucket_rows=BUCKET)


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.load(spark, sf, "events")
    return nearest_rank(events, ["event_type"], "value", QUANTILES)


def latency_quantiles_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of all prices as one hot key, in rounds of narrowing down to small windows."""
    lines = tables.load(spark, sf, "lineitem")
    return nearest_rank(lines, [], "l_extendedprice", QUANTILES, bound=500)


def span_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier deliveries as spans: name = ship status, outcome = return flag."""
    spans = tables.load(spark, sf, "lineitem").select(
        F.concat(F.lit("ship."), F.lower("l_linestatus")).alias("span"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("outcome"),
        F.col("l_extendedprice").alias("duration_ms"),
    )
    return M.span_rollup(spans, QUANTILES)


def _access_log(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` as access log; the language part of the URL becomes an API prefix."""
    parts = (
        tables.load(spark, sf, "pages")
        .select("page_id", "url", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1).alias("p"))
        .select(
            "page_id",
            F.col("url").startswith("https").alias("tls"),
            F.split_part("p", F.lit("/"), F.lit(2)).alias("lang"),
            F.regexp_replace(F.regexp_replace("p", "^/[a-z]+", ""), "/$", "").alias("rest"),
        )
    )
    tls, lang, rest = F.col("tls"), F.col("lang"), F.col("rest")
    path = (
        F.when(tls & (lang == "en"), "/runs")
        .when(tls & (lang == "de"), F.concat(F.lit("/runs"), rest, F.lit(":cancel")))
        .when(lang == "en", F.concat(F.lit("/runs"), rest))
        .when(lang == "de", F.concat(F.lit("/runs"), rest, F.lit("/events")))
        .when(lang == "fr", F.concat(F.lit("/sources"), rest))
        .otherwise(F.concat(F.lit("/kv/ns"), rest))
    )
    page = F.col("page_id")
    granted = F.when(page % 3 == 0, F.array(F.lit("runs:read"))).otherwise(
        F.array(F.lit("runs:read"), F.lit("events:read"), F.lit("kv:write"))
    )
    return parts.select(
        "page_id",
        F.when(page % 4 == 0, "POST").when(page % 4 == 1, "DELETE").otherwise("GET").alias("method"),
        path.alias("path"),
        F.when(page % 5 == 0, 404).otherwise(200).alias("code"),
        granted.alias("granted"),
    )


_ACCESS_SQL = r"""raw AS (
  SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1) AS p FROM pages
), parts AS (
  SELECT page_id, url, split_part(p, '/', 2) AS lang,
         regexp_replace(regexp_replace(p, '^/[a-z]+', ''), '/$', '') AS rest
  FROM raw
), log AS (
  SELECT page_id,
    CASE page_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'DELETE' ELSE 'GET' END AS method,
    CASE WHEN starts_with(url, 'https') AND lang = 'en' THEN '/runs'
         WHEN starts_with(url, 'https') AND lang = 'de' THEN '/runs' || rest || ':cancel'
         WHEN lang = 'en' THEN '/runs' || rest
         WHEN lang = 'de' THEN '/runs' || rest || '/events'
         WHEN lang = 'fr' THEN '/sources' || rest
         ELSE '/kv/ns' || rest END AS path,
    CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS code,
    CASE WHEN page_id % 3 = 0 THEN ['runs:read'] ELSE ['runs:read', 'events:read', 'kv:write'] END AS granted
  FROM parts
), routed AS (
  SELECT *, CASE WHEN path = '/runs' THEN '/runs'
                 WHEN starts_with(path, '/runs/') AND suffix(path, ':cancel') THEN '/runs/{id}:cancel'
                 WHEN starts_with(path, '/runs/') AND suffix(path, '/events') THEN '/runs/{id}/events'
                 WHEN starts_with(path, '/runs/') THEN '/runs/{id}'
                 WHEN starts_with(path, '/sources/') THEN '/sources/{name}'
                 ELSE path END AS route
  FROM log
)"""


def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.http_counters(_access_log(spark, sf))


def access_audit(spark: SparkSession, sf: str) -> DataFrame:
    audited = M.access_audit(_access_log(spark, sf))
    return audited.select(
        "page_id",
        "method",
        "path",
        F.array_join("required", ",").alias("required"),
        F.array_join("missing", ",").alias("missing"),
        "allowed",
    )


def storage_health(spark: SparkSession, sf: str) -> DataFrame:
    """Stored bytes are taken from the documents' texts, so the check needs no file listing."""
    files = tables.load(spark, sf, "documents").select(
        F.octet_length("text").cast("long").alias("size")
    )
    return M.storage_health(
        files,
        J.total_bytes(tables.journal(spark, sf)),
        max_bytes=2_600_000,
        journal_max_bytes=100_000,
        schema_version=3,
    ).drop("driver")


def exposition_text(spark: SparkSession, sf: str) -> DataFrame:
    """Counter and histogram text of the access log and event values."""
    hits = route_counts(spark, sf)
    events = tables.load(spark, sf, "events")
    wide = M.histogram(events, ["event_type"], "value", M.LATENCY_BUCKETS)
    parts = [
        M.expose_header(hits, "http_requests_total", "Total HTTP requests", "counter"),
        M.expose_counter(
            hits, "http_requests_total", ["method", "route", "code"], order_by=["route", "method", "code"]
        ),
        M.expose_header(hits, "event_value", "", "histogram"),
        M.expose_histogram(wide, "event_value", ["event_type"], M.LATENCY_BUCKETS),
    ]
    return reduce(DataFrame.unionByName, parts).select("metric", F.col("pos").cast("long").alias("pos"), "line")


def runner_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Denials, added sources, resumes, container runs, invalid manifests and information gauges as text."""
    events = tables.load(spark, sf, "events")
    denials = M.denial_counters(events.select(
        F.when(F.col("event_type") == "error", "policy.denied").when(F.col("event_type") == "view", "")
        .otherwise(F.col("event_type")).alias("reason")
    ))
    added = M.source_counters(tables.load(spark, sf, "supplier").select(
        F.when(F.col("s_nationkey") % 3 == 0, " Git ").when(F.col("s_nationkey") % 3 == 1, " ").otherwise("OCI").alias("type")
    ))
    resumed = M.cursor_counters(journal.cursor_resume(spark, sf))
    lines = tables.load(spark, sf, "lineitem")
    containers = M.container_counters(lines, lines.filter("l_returnflag = 'R'"))
    invalid = M.invalid_manifests(checks.manifest_lint(spark, sf), ["p_partkey"])
    parts = [
        M.expose_header(events, "policy_denials_total", "Policy denials by reason", "counter"),
        M.expose_counter(denials, "policy_denials_total", ["reason"]),
        M.expose_counter(added, "sources_added_total", ["type"]),
        M.expose_counter(resumed, "sse_resume_total", [], "resumes"),
        M.expose_counter(resumed, "sse_cursor_expired_total", [], "expired"),
        M.expose_counter(containers, "container_runs_total", [], "runs"),
        M.expose_counter(containers, "container_pulls_total", [], "pulls"),
        M.expose_counter(invalid, "addon_manifest_invalid_total", [], "invalid"),
        M.expose_info(events, "build_info", {"version": "1.2", "commit": 'a"b'}),
        M.expose_profile(events, "security_profile", "secure"),
        M.expose_profile(events, "idle_profile", ""),
    ]
    return reduce(DataFrame.unionByName, parts).select("metric", F.col("pos").cast("long").alias("pos"), "line")


QUERIES = {
    f.__name__: f
    for f in (
        event_counters, eviction_counters, value_histogram, histogram_totals, container_histogram,
        gauge_clamped, latency_quantiles, latency_quantiles_hot, span_rollup, route_counts,
        access_audit, storage_health,
        exposition_text, runner_counters,
    )
}

_LE = ["1", "2", "5", "10", "25", "50", "100", "250", "500", "1000", "2500", "5000"]

SQL = {
    "runner_counters": f"""
        WITH denied AS (SELECT CASE event_type WHEN 'error' THEN 'policy.denied' ELSE event_type END AS reason, count(*) AS n
                        FROM events WHERE event_type <> 'view' GROUP BY 1),
             added AS (SELECT CASE s_nationkey % 3 WHEN 0 THEN 'git' ELSE 'oci' END AS type, count(*) AS n
                       FROM supplier WHERE s_nationkey % 3 <> 1 GROUP BY 1),
             resumed AS ({journal.SQL["cursor_resume"]}),
             one(metric, line) AS (
               SELECT 'sse_resume_total', 'sse_resume_total ' || count(*) FROM resumed
               UNION ALL SELECT 'sse_cursor_expired_total', 'sse_cursor_expired_total ' || count(*) FILTER (outcome = 'expired') FROM resumed
               UNION ALL SELECT 'container_runs_total', 'container_runs_total ' || count(*) FROM lineitem
               UNION ALL SELECT 'container_pulls_total', 'container_pulls_total ' || count(*) FROM lineitem WHERE l_returnflag = 'R'
               UNION ALL SELECT 'addon_manifest_invalid_total', 'addon_manifest_invalid_total ' || count(DISTINCT p_partkey)
                         FROM ({checks.SQL["manifest_lint"]})
               UNION ALL SELECT 'policy_denials_total', 'policy_denials_total{{reason="' || reason || '"}} ' || n FROM denied
               UNION ALL SELECT 'sources_added_total', 'sources_added_total{{type="' || type || '"}} ' || n FROM added
               UNION ALL SELECT 'build_info', 'build_info{{commit="a\\"b",version="1.2"}} 1'
               UNION ALL SELECT 'security_profile', 'security_profile{{profile="secure"}} 1'
               UNION ALL SELECT 'idle_profile', 'idle_profile{{profile=""}} 0')
        SELECT metric, 0 AS pos, line FROM one
        UNION ALL SELECT 'policy_denials_total', -2, '# HELP policy_denials_total Policy denials by reason'
        UNION ALL SELECT 'policy_denials_total', -1, '# TYPE policy_denials_total counter'""",
    "event_counters": """
        SELECT event_type, CAST(sum(n) AS BIGINT) AS count, CAST(sum(a) AS BIGINT) AS amount FROM (
          SELECT event_type, 1 AS n, strlen(props) AS a FROM events
          UNION ALL SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'deploy']), 0, 0
        ) GROUP BY event_type""",
    "eviction_counters": """
        SELECT kind, CAST(sum(n) AS BIGINT) AS count, CAST(sum(b) AS BIGINT) AS amount FROM (
          SELECT CASE event_type WHEN 'error' THEN 'journal' WHEN 'view' THEN 'unknown' ELSE 'other' END AS kind,
                 1 AS n, greatest(CAST(json_extract_string(props, '$.k') AS BIGINT) - 10, 0) AS b
          FROM events
          UNION ALL SELECT 'journal', 0, 0 UNION ALL SELECT 'idempotency', 0, 0
        ) GROUP BY kind""",
    "value_histogram": f"""
        WITH {_LATENCY_SQL}
        SELECT operation, outcome, le, count(v) FILTER (WHERE le = '+Inf' OR v <= TRY_CAST(le AS DOUBLE)) AS n
        FROM every_obs, (SELECT unnest({[*_LE, '+Inf']}) AS le)
        GROUP BY ALL""",
    "histogram_totals": f"""
        WITH {_LATENCY_SQL}
        SELECT operation, outcome, count(v) AS count,
               round(CAST(coalesce(sum(CAST(v AS DECIMAL(28, 9))), 0) AS DOUBLE), 6) AS sum
        FROM every_obs GROUP BY ALL""",
    "container_histogram": """
        SELECT le, count(*) FILTER (WHERE le = '+Inf' OR l_quantity <= TRY_CAST(le AS DOUBLE)) AS n
        FROM lineitem, (SELECT unnest(['0.5', '1', '2', '5', '10', '20', '60', '120', '300', '+Inf']) AS le)
        GROUP BY le""",
    "gauge_clamped": """
        WITH d AS (
          SELECT event_type AS transport, event_id AS ord,
                 CAST(json_extract_string(props, '$.k') AS BIGINT) - 50 AS delta
          FROM events
        ), s AS (
          SELECT *, CAST(sum(delta) OVER (PARTITION BY transport ORDER BY ord) AS BIGINT) AS cs FROM d
        )
        SELECT transport, ord, delta,
               cs - least(0, min(cs) OVER (PARTITION BY transport ORDER BY ord)) AS value
        FROM s""",
    "latency_quantiles": """
        SELECT event_type, q, count(value) AS n,
               CASE q WHEN 0.5 THEN quantile_disc(value, 0.5) WHEN 0.95 THEN quantile_disc(value, 0.95)
                      ELSE quantile_disc(value, 0.99) END AS value
        FROM events, (SELECT CAST(unnest([0.5, 0.95, 0.99]) AS DOUBLE) AS q)
        GROUP BY event_type, q""",
    "latency_quantiles_hot": """
        SELECT q, count(l_extendedprice) AS n,
               CASE q WHEN 0.5 THEN quantile_disc(l_extendedprice, 0.5) WHEN 0.95 THEN quantile_disc(l_extendedprice, 0.95)
                      ELSE quantile_disc(l_extendedprice, 0.99) END AS value
        FROM lineitem, (SELECT CAST(unnest([0.5, 0.95, 0.99]) AS DOUBLE) AS q) GROUP BY q""",
    "span_rollup": """
        SELECT 'ship.' || lower(l_linestatus) AS span,
               CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS outcome,
               count(*) AS count,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 9))) AS DOUBLE) AS total_ms,
               quantile_disc(l_extendedprice, 0.5) AS p50_ms,
               quantile_disc(l_extendedprice, 0.95) AS p95_ms,
               quantile_disc(l_extendedprice, 0.99) AS p99_ms
        FROM lineitem GROUP BY 1, 2""",
    "route_counts": f"WITH {_ACCESS_SQL} SELECT route, method, code, count(*) AS count FROM routed GROUP BY ALL",
    "access_audit": f"""
        WITH {_ACCESS_SQL}, ruled AS (
          SELECT *, CASE
            WHEN method = 'GET' AND starts_with(path, '/runs/') AND suffix(path, '/events')
              THEN ['runs:read', 'events:read']
            WHEN method = 'GET' AND (path = '/runs' OR starts_with(path, '/runs/')) THEN ['runs:read']
            WHEN method = 'GET' AND starts_with(path, '/sources/') THEN ['sources:read']
            WHEN method = 'GET' AND starts_with(path, '/kv/') THEN ['kv:read']
            WHEN method = 'POST' AND path = '/runs' THEN ['runs:write']
            WHEN method = 'DELETE' AND starts_with(path, '/sources/') THEN ['sources:write']
            WHEN method <> 'GET' AND starts_with(path, '/kv/') THEN ['kv:write']
            ELSE [] END AS req
          FROM log
        ), checked AS (
          SELECT *, list_filter(req, lambda s: NOT list_contains(granted, s)) AS miss FROM ruled
        )
        SELECT page_id, method, path, array_to_string(req, ',') AS required,
               array_to_string(miss, ',') AS missing, len(miss) = 0 AS allowed
        FROM checked""",
    "storage_health": """
        WITH f AS (SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes_used FROM documents),
             j AS (SELECT CAST(sum(strlen(props)) AS BIGINT) AS journal_bytes FROM events)
        SELECT bytes_used < 2600000 AS ok, bytes_used, CAST(2600000 AS BIGINT) AS max_bytes, journal_bytes,
               CAST(100000 AS BIGINT) AS journal_max_bytes,
               journal_bytes >= 100000 OR bytes_used >= 2340000 AS eviction_active, 3 AS schema_version
        FROM f, j""",
    "exposition_text": f"""
        WITH {_ACCESS_SQL}, hits AS (SELECT route, method, code, count(*) AS n FROM routed GROUP BY ALL),
        sums AS (
          SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) AS s
          FROM events GROUP BY event_type
        ), buckets AS (
          SELECT event_type, le, pos - 1 AS pos,
                 count(*) FILTER (WHERE le = '+Inf' OR value <= TRY_CAST(le AS DOUBLE)) AS n
          FROM events, (SELECT unnest({[*_LE, '+Inf']}) AS le, generate_subscripts({[*_LE, '+Inf']}, 1) AS pos)
          GROUP BY ALL
        )
        SELECT 'http_requests_total' AS metric, -2 AS pos, '# HELP http_requests_total Total HTTP requests' AS line
        UNION ALL SELECT 'http_requests_total', -1, '# TYPE http_requests_total counter'
        UNION ALL SELECT 'event_value', -1, '# TYPE event_value histogram'
        UNION ALL SELECT 'http_requests_total', 0, 'http_requests_total{{method="' || method || '",route="'
               || route || '",code="' || code || '"}} ' || n FROM hits
        UNION ALL SELECT 'event_value', pos, 'event_value_bucket{{event_type="' || event_type || '",le="' || le || '"}} ' || n
               FROM buckets
        UNION ALL SELECT 'event_value', 13, 'event_value_sum{{event_type="' || event_type || '"}} '
               || CASE WHEN s < 1000000 THEN regexp_replace(CAST(s AS VARCHAR), '\\.0$', '')
                       ELSE regexp_replace(digits[1:1] || '.' || digits[2:], '\\.$', '') || 'e+' || lpad(CAST(whole - 1 AS VARCHAR), 2, '0')
                  END
               FROM (SELECT *, rtrim(replace(CAST(CAST(s AS DECIMAL(28, 9)) AS VARCHAR), '.', ''), '0') AS digits,
                            length(CAST(CAST(floor(s) AS BIGINT) AS VARCHAR)) AS whole FROM sums)
        UNION ALL SELECT 'event_value', 14, 'event_value_count{{event_type="' || event_type || '"}} ' || n FROM sums""",
}
