"""Queries over keyed state and idempotent requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.functions.access import kv_check, request_key_valid, scoped_request_key
from runlens.functions.payload import canonical_hash
from runlens.operators import keyed as K
from runlens.operators import requests as Q
from runlens.operators import snapshots as SN

BUCKET = 1 << 16
QUOTA = 200_000
TTL_MS = 600_000


def kv_latest(spark: SparkSession, sf: str) -> DataFrame:
    live = K.latest(tables.kv_changes(spark, sf), ["namespace", "k"], "ord", op="op")
    return live.select("namespace", "k", "v", "ord")


_LATEST = """latest AS (
  SELECT 'ns' || user_id % 4 AS namespace, CAST(user_id AS VARCHAR) AS k,
         max_by(props, event_id) AS v, max(event_id) AS ord,
         max_by(event_type, event_id) AS last_type
  FROM events GROUP BY user_id
)"""


def kv_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return K.deletes(tables.kv_changes(spark, sf), bucket_rows=BUCKET)


def kv_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as the stored rows, later orders replace the balance of their customer."""
    current = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("value")
    )
    changes = tables.load(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("name"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("ord"),
    )
    return K.upsert(current, changes, ["name"], "ord")


def kv_namespace_size(spark: SparkSession, sf: str) -> DataFrame:
    live = K.latest(tables.kv_changes(spark, sf), ["namespace", "k"], "ord", op="op")
    return K.namespace_sizes(live)


def kv_prefix_page(spark: SparkSession, sf: str) -> DataFrame:
    page = K.prefix_page(
        tables.kv_documents(spark, sf).select("namespace", "k", F.octet_length("v").cast("long").alias("size")),
        "en", "src1", "src1:", 25,
    )
    return page.select("k", "size", "next_cursor")


PAGE_LANGS = ("en", "de", "es", "fr")


def kv_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page of document keys for every customer: prefixes of sources, some with a cursor."""
    key = F.col("c_custkey")
    source = F.concat(F.lit("src"), (key % 13).cast("string"), F.lit(":"))
    requests = tables.load(spark, sf, "customer").select(
        key.alias("request"),
        F.element_at(F.array(*[F.lit(x) for x in PAGE_LANGS]), (key % 4 + 1).cast("int")).alias("namespace"),
        F.when(key % 3 == 0, "src").when(key % 3 == 1, source)
        .otherwise(F.concat(source, (key % 10).cast("string"))).alias("prefix"),
        F.when(key % 5 == 0, "").otherwise(F.concat(source, (key % 900).cast("string"))).alias("cursor"),
        (key % 40).cast("int").alias("limit"),
    )
    live = tables.kv_documents(spark, sf).select(
        "namespace", "k", F.octet_length("v").cast("long").alias("size")
    )
    return SN.prefix_pages(live, requests).select("request", "place", "k", "size", "next_cursor")


def kv_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The change log in three change sets, each folded into the stored snapshot."""
    changes = tables.kv_changes(spark, sf)
    top = changes.agg(F.max("ord")).scalar()
    third = F.least(F.expr("2L"), F.floor(F.col("ord") * 3 / top))
    snapshot = SN.Snapshot(spark, ["namespace", "k"], "ord", slots=8)
    for number in range(3):
        snapshot.apply(changes.filter(third == number))
    return snapshot.live().select("namespace", "k", "v", "ord")


def kv_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Row checks of every document write; keys of source src3 are blown up to be too long."""
    rows = tables.kv_documents(spark, sf)
    key = F.when(F.col("k").startswith("src3"), F.repeat("k", 60)).otherwise(F.col("k"))
    space = F.when(F.col("namespace") == "es", "e-s").otherwise(F.col("namespace"))
    space = F.when(F.col("namespace") == "fr", F.concat("namespace", F.lit("\n"))).otherwise(space)
    return rows.groupBy(kv_check(space, key, F.col("v")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def kv_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Quota decisions for all document writes, namespace by namespace."""
    return K.admission(tables.kv_documents(spark, sf), QUOTA, bucket_rows=BUCKET)


def kv_change_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Quota decisions for a log with updates and deletes that never overflows."""
    decided = K.admission(tables.kv_changes(spark, sf), 1_000_000, bucket_rows=BUCKET)
    return decided.groupBy("namespace", "decision").agg(F.count(F.lit(1)).alias("n"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load(spark, sf, "events").select(
        F.concat(F.lit("key-"), (F.col("user_id") % 3).cast("string")).alias("key"),
        F.lit("POST /runs").alias("endpoint"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("hash"),
        (F.col("event_type") != "error").alias("valid"),
    )


def idem_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Admission of every request under an expiry anchored at the first accepted one."""
    decided = Q.admission(_requests(spark, sf), TTL_MS)
    return decided.select("key", "seq", "decision", "anchor_seq")


def idem_sql(key: str, ttl_ms: int) -> str:
    return f"""
WITH RECURSIVE rows AS (
  SELECT {key} AS key, event_id AS seq, epoch_ms(ts) AS ms, event_type AS hash,
         event_type <> 'error' AS valid
  FROM events
), cand AS (
  SELECT key, ms, min(seq) AS seq, min_by(hash, seq) AS hash FROM rows WHERE valid GROUP BY key, ms
), nxt AS (
  SELECT key, ms, min(ms) OVER (PARTITION BY key ORDER BY ms
                                RANGE BETWEEN {ttl_ms + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms
  FROM cand
), chain AS (
  SELECT key, min(ms) AS ms FROM cand GROUP BY key
  UNION ALL
  SELECT n.key, n.next_ms FROM chain c JOIN nxt n ON n.key = c.key AND n.ms = c.ms
  WHERE n.next_ms IS NOT NULL
), opened AS (
  SELECT key, ms, seq, hash FROM chain JOIN cand USING (key, ms)
)
SELECT r.key, r.seq,
       CASE WHEN o.seq IS NULL THEN 'rejected' WHEN o.seq = r.seq THEN 'accepted'
            WHEN o.hash = r.hash THEN 'replay' ELSE 'conflict' END AS decision,
       o.seq AS anchor_seq
FROM rows r LEFT JOIN opened o
  ON o.key = r.key AND r.ms BETWEEN o.ms AND o.ms + {ttl_ms} AND r.seq >= o.seq
"""


IDEM_TTL_SQL = idem_sql("'key-' || user_id % 3", TTL_MS)


def idem_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Order requests against responses stored for customers."""
    store = tables.load(spark, sf, "customer").select(
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"),
        F.lit("POST /runs").alias("endpoint"),
        F.col("c_mktsegment").alias("body_sha256"),
        F.lit(201).alias("status"),
        F.col("c_name").alias("body"),
        F.when(F.col("c_nationkey") == 0, 0)
        .otherwise(F.unix_millis(F.timestamp_add("DAY", F.col("c_nationkey") * 100, F.lit("1996-01-01").cast("timestamp"))))
        .alias("ttl_expires_at"),
    )
    requests = tables.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request"),
        F.concat(F.lit("k"), (F.col("o_custkey") * 2).cast("string")).alias("key"),
        F.lit("POST /runs").alias("endpoint"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("hash"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("now_ms"),
    )
    return Q.lookup(requests, store).select("request", "outcome", "status", "stored_body")


def idem_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Scoped request keys; every seventh customer is anonymous."""
    key = F.concat(F.lit("order_key_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    key = F.when(F.col("o_orderkey") % 11 == 0, "short").otherwise(key)
    key = F.when(F.col("o_orderkey") % 13 == 1, F.concat(key, F.lit("\n"))).otherwise(key)
    who = F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return tables.load(spark, sf, "orders").select(
        "o_orderkey", scoped_request_key(who, key).alias("scoped"), request_key_valid(key).alias("valid")
    )


def declared_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Declared against computed hashes of event bodies."""
    computed = F.sha2("props", 256)
    declared = (
        F.when(F.col("event_id") % 4 == 0, "")
        .when(F.col("event_id") % 4 == 1, F.upper(F.sha2("props", 256)))
        .when(F.col("event_id") % 4 == 2, F.sha2("event_type", 256))
        .otherwise("xyz")
    )
    return (
        tables.load(spark, sf, "events")
        .groupBy(Q.declared_hash_check(declared, computed).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def canonical_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical hash of request bodies whose keys come unsorted and number text is kept.

    Some bodies hold a lone surrogate escape, some are nested thousands deep.
    """
    deep = F.lit(3000)
    plain = F.concat(
        F.lit('{"value": '), F.format_string("%.2f", "value"),
        F.lit(', "args": '), F.col("props"),
        F.lit(', "job": "<'), F.col("event_type"), F.lit('>" }'),
    )
    body = (
        F.when(F.col("event_id") % 29 == 4, F.concat(F.lit('{"\\ud800b": '), F.col("props"), F.lit(', "a" : 1.50}')))
        .when(
            F.col("event_id") % 301 == 5,
            F.concat(F.repeat(F.lit("[ "), deep), F.col("event_id").cast("string"), F.repeat(F.lit("]"), deep)),
        )
        .otherwise(plain)
    )
    events = tables.load(spark, sf, "events").select("event_id", "event_type", "value", "props")
    return events.select("event_id", canonical_hash(body).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        kv_latest, kv_deletes, kv_upsert, kv_namespace_size, kv_prefix_page, kv_pages, kv_compacted,
        kv_checks,         kv_admission, kv_change_admission, idem_lookup, idem_ttl, idem_keys, declared_hashes,
        canonical_bodies,
    )
}

SQL = {
    "kv_latest": f"WITH {_LATEST} SELECT namespace, k, v, ord FROM latest WHERE last_type <> 'error'",
    "kv_deletes": """
        SELECT namespace, k, ord, coalesce(prev <> 'error', false) AS existed FROM (
          SELECT 'ns' || user_id % 4 AS namespace, CAST(user_id AS VARCHAR) AS k, event_id AS ord, event_type,
                 lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev
          FROM events
        ) WHERE event_type = 'error'""",
    "kv_upsert": """
        WITH newest AS (
          SELECT o_custkey * 2 AS name, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1
        )
        SELECT c_custkey AS name, c_acctbal AS value, CAST(NULL AS BOOLEAN) AS created
        FROM customer WHERE c_custkey NOT IN (SELECT name FROM newest)
        UNION ALL
        SELECT name, value, c_custkey IS NULL FROM newest LEFT JOIN customer ON c_custkey = name""",
    "kv_namespace_size": f"""
        WITH {_LATEST}
        SELECT namespace, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes
        FROM latest WHERE last_type <> 'error' GROUP BY namespace""",
    "kv_prefix_page": """
        WITH page AS (
          SELECT source || ':' || doc_id AS k, strlen(text) AS size FROM documents
          WHERE lang = 'en' AND starts_with(source || ':' || doc_id, 'src1')
            AND source || ':' || doc_id > 'src1:'
          ORDER BY 1 LIMIT 26
        ), numbered AS (SELECT *, row_number() OVER (ORDER BY k) AS r FROM page)
        SELECT k, size, (SELECT max(CASE WHEN r = 25 THEN k END) FROM numbered HAVING count(*) > 25) AS next_cursor
        FROM numbered WHERE r <= 25""",
    "kv_compacted": f"WITH {_LATEST} SELECT namespace, k, v, ord FROM latest WHERE last_type <> 'error'",
    "kv_pages": """
        WITH req AS (
          SELECT c_custkey AS request,
                 CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'fr' END AS namespace,
                 CASE c_custkey % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'src' || c_custkey % 13 || ':'
                      ELSE 'src' || c_custkey % 13 || ':' || c_custkey % 10 END AS prefix,
                 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'src' || c_custkey % 13 || ':' || c_custkey % 900 END AS cur,
                 CASE WHEN c_custkey % 40 = 0 THEN 256 ELSE c_custkey % 40 END AS lim
          FROM customer
        ), met AS (
          SELECT request, lim, source || ':' || doc_id AS k, strlen(text) AS size,
                 row_number() OVER (PARTITION BY request ORDER BY source || ':' || doc_id) AS place,
                 count(*) OVER (PARTITION BY request) AS total
          FROM req JOIN documents ON lang = namespace AND starts_with(source || ':' || doc_id, prefix)
                                 AND source || ':' || doc_id > cur
        )
        SELECT request, place, k, size,
               CASE WHEN total > lim THEN max(CASE WHEN place = lim THEN k END) OVER (PARTITION BY request) END AS next_cursor
        FROM met QUALIFY place <= lim""",
    "kv_checks": """
        SELECT CASE WHEN source = 'src3' OR starts_with(source, 'src3')
                      THEN CASE WHEN strlen(source || ':' || doc_id) * 60 > 256 THEN 'key_too_large' END
                    WHEN strlen(text) > 8192 THEN 'value_too_large'
                    WHEN lang IN ('es', 'fr') THEN 'namespace_invalid' ELSE 'ok' END AS outcome,
               count(*) AS n
        FROM documents GROUP BY 1""",
    "kv_admission": f"""
        WITH RECURSIVE writes AS (
          SELECT lang AS namespace, doc_id AS ord, strlen(source || ':' || doc_id) + strlen(text) AS size,
                 strlen(text) > 8192 AS too_large
          FROM documents
        ), queued AS (
          SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ord) AS r FROM writes WHERE NOT too_large
        ), walk AS (
          SELECT namespace, ord, r, size <= {QUOTA} AS ok, CASE WHEN size <= {QUOTA} THEN size ELSE 0 END AS used
          FROM queued WHERE r = 1
          UNION ALL
          SELECT q.namespace, q.ord, q.r, w.used + q.size <= {QUOTA},
                 CASE WHEN w.used + q.size <= {QUOTA} THEN w.used + q.size ELSE w.used END
          FROM walk w JOIN queued q ON q.namespace = w.namespace AND q.r = w.r + 1
        )
        SELECT namespace, ord, CASE WHEN ok THEN 'ok' ELSE 'quota_exceeded' END AS decision FROM walk
        UNION ALL SELECT namespace, ord, 'value_too_large' FROM writes WHERE too_large""",
    "kv_change_admission": """
        SELECT 'ns' || user_id % 4 AS namespace, 'ok' AS decision, count(*) AS n FROM events GROUP BY 1""",
    "idem_lookup": """
        WITH store AS (
          SELECT 'k' || c_custkey AS key, c_mktsegment AS body_hash, c_name AS body,
                 CASE WHEN c_nationkey = 0 THEN 0
                      ELSE epoch_ms(TIMESTAMP '1996-01-01' + to_days(CAST(c_nationkey * 100 AS INTEGER))) END AS expires
          FROM customer
        ), asked AS (
          SELECT o_orderkey AS request, 'k' || o_custkey * 2 AS key, epoch_ms(o_orderdate) AS now_ms,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS hash
          FROM orders
        ), judged AS (
          SELECT request, body,
                 CASE WHEN body_hash IS NULL THEN 'miss'
                      WHEN expires > 0 AND now_ms > expires THEN 'expired'
                      WHEN body_hash <> hash THEN 'conflict' ELSE 'replay' END AS outcome
          FROM asked LEFT JOIN store USING (key)
        )
        SELECT request, outcome, CASE WHEN outcome = 'replay' THEN 201 END AS status,
               CASE WHEN outcome = 'replay' THEN body END AS stored_body
        FROM judged""",
    "idem_ttl": IDEM_TTL_SQL,
    "idem_keys": """
        WITH k AS (
          SELECT o_orderkey, o_custkey,
                 CASE WHEN o_orderkey % 11 = 0 THEN 'short'
                      ELSE 'order_key_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END
                 || CASE WHEN o_orderkey % 13 = 1 THEN chr(10) ELSE '' END AS key
          FROM orders
        )
        SELECT o_orderkey,
               CASE WHEN o_custkey % 7 = 0 THEN key ELSE sha256('c' || o_custkey) || ':' || key END AS scoped,
               regexp_full_match(key, '[A-Za-z0-9_-]{20,128}') AS valid
        FROM k""",
    "declared_hashes": """
        SELECT CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'conflict'
                                 ELSE 'invalid_hash' END AS outcome, count(*) AS n
        FROM events GROUP BY 1""",
    "canonical_bodies": r"""
        SELECT event_id, CASE
               WHEN event_id % 29 = 4 THEN sha256('{"a":1.50,"' || chr(65533) || 'b":' || replace(props, ' ', '') || '}')
               WHEN event_id % 301 = 5 THEN sha256(repeat('[', 3000) || event_id || repeat(']', 3000))
               ELSE sha256('{"args":' || replace(props, ' ', '') || ',"job":"\u003c' || event_type || '\u003e","value":'
                      || printf('%.2f', value) || '}') END AS hash
        FROM events""",
}
