"""Queries over the run journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.functions.payload import is_json
from runlens.operators import journal as J
from runlens.sources.export import ndjson_lines

BUDGET = 30_000
# Bucket width of the running aggregates; the default fits cluster-size tables.
BUCKET = 1 << 16


def journal_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return J.total_bytes(tables.journal(spark, sf))


def journal_admission(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.journal(spark, sf)
    return log.groupBy(J.append_outcome(8).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(J.payload_bytes()).alias("bytes")
    )


def journal_retained(spark: SparkSession, sf: str) -> DataFrame:
    kept = J.retained(tables.journal(spark, sf), BUDGET, bucket_rows=BUCKET)
    return kept.select("seq", "run_id", "event_type", "payload")


def journal_evictions(spark: SparkSession, sf: str) -> DataFrame:
    return J.evictions(tables.journal(spark, sf), BUDGET, bucket_rows=BUCKET)


def journal_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: byte-budget retention, then the bounds of every run."""
    return J.bounds(J.retained(tables.journal(spark, sf), BUDGET, bucket_rows=BUCKET))


_KEPT = f"""kept AS (
  SELECT * FROM (
    SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS run_id, event_type, props AS payload, ts,
           sum(strlen(props)) OVER (ORDER BY event_id DESC) AS used
    FROM events WHERE strlen(props) BETWEEN 1 AND {BUDGET}
  ) WHERE used <= {BUDGET}
)"""


def journal_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """One cursor per customer, some blank, some no number."""
    key = F.col("c_custkey")
    text = (
        F.when(key % 10 == 0, " ")
        .when(key % 10 == 1, F.concat(F.lit("x"), key.cast("string")))
        .otherwise(F.concat(F.lit(" "), (key * 7).cast("string")))
    )
    runs = tables.key_space(spark, sf, "events", "user_id", "1.25")
    return tables.load(spark, sf, "customer").select(
        key.alias("subscriber"), (key % runs).cast("string").alias("run_id"), text.alias("cursor")
    )


def cursor_resume(spark: SparkSession, sf: str) -> DataFrame:
    kept = J.retained(tables.journal(spark, sf), BUDGET, bucket_rows=BUCKET)
    return J.resume_classes(journal_cursors(spark, sf), kept).select(
        "subscriber", "run_id", "after_seq", "earliest", "latest", "outcome"
    )


_RUNS = "(SELECT CAST(floor(max(user_id) * 1.25) AS BIGINT) + 1 FROM events)"

CURSORS_SQL = f"""cursors AS (
  SELECT c_custkey AS subscriber, CAST(c_custkey % {_RUNS} AS VARCHAR) AS run_id,
         CASE c_custkey % 10 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE c_custkey * 7 END AS after_seq
  FROM customer
)"""

_RESUME = f"""
WITH {_KEPT}, {CURSORS_SQL},
bounds AS (SELECT run_id, min(seq) AS earliest, max(seq) AS latest FROM kept GROUP BY run_id)
SELECT subscriber, c.run_id, after_seq, coalesce(earliest, 0) AS earliest,
       coalesce(latest, 0) AS latest,
       CASE WHEN after_seq IS NULL THEN 'invalid'
            WHEN after_seq > 0 AND earliest > 0 AND (after_seq < earliest OR after_seq > latest)
            THEN 'expired' ELSE 'ok' END AS outcome
FROM cursors c LEFT JOIN bounds b USING (run_id)
"""


def journal_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Rows every resumable cursor still has to see."""
    kept = J.retained(tables.journal(spark, sf), BUDGET, bucket_rows=BUCKET)
    return J.resume_rows(journal_cursors(spark, sf), kept).groupBy("subscriber", "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def journal_tail_hot(spark: SparkSession, sf: str) -> DataFrame:
    """What is left for every customer, event types taken as runs: many cursors on each hot run."""
    log = tables.journal(spark, sf).select("seq", F.col("event_type").alias("run_id"))
    types = log.select("run_id").distinct().withColumn("number", F.length("run_id") % 4)
    top = log.agg(F.max("seq")).scalar()
    cursors = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("subscriber"),
        (F.col("c_custkey") % 4).cast("int").alias("number"),
        (F.col("c_custkey") * 37 % (top + 1)).cast("string").alias("cursor"),
    )
    cursors = cursors.join(types, "number").drop("number")
    return J.resume_counts(cursors, log, bucket_rows=256)


_TAIL = f"""
WITH r AS ({_RESUME}), {_KEPT}
SELECT subscriber, r.run_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq
FROM r JOIN kept k ON k.run_id = r.run_id AND k.seq > r.after_seq
WHERE outcome = 'ok' GROUP BY ALL
"""


def journal_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return J.range_scan(tables.journal(spark, sf), "42", 500).select("seq", "event_type", "payload")


def run_sequence(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.journal(spark, sf).select("run_id", F.col("seq").alias("arrival"))
    return J.run_sequence(log, "arrival", bucket_rows=BUCKET)


def global_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Dense sequence for the admitted rows only, continuing after 1000."""
    log = (
        tables.journal(spark, sf)
        .filter(J.payload_bytes() <= 8)
        .select("run_id", F.col("seq").alias("arrival"))
    )
    return J.assign_seq(log, "arrival", high_mark=1000, bucket_rows=BUCKET)


def replay_buffer(spark: SparkSession, sf: str) -> DataFrame:
    held = J.replay_buffer(
        tables.journal(spark, sf), max_events=20, retention_seconds=5 * 86400, bucket_rows=BUCKET
    )
    return held.select("run_id", "seq")


def replay_buffer_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The buffer at its default size, event types taken as runs: each has a large share of all rows."""
    log = tables.journal(spark, sf).withColumn("run_id", F.col("event_type"))
    return J.replay_buffer(log, retention_seconds=20 * 86400, bucket_rows=4096).select("run_id", "seq")


_BUFFER = """
WITH ranked AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r,
         max_by(ts, event_id) OVER (PARTITION BY user_id) AS last_ts
  FROM events
), tail AS (
  SELECT *, min(CASE WHEN ts >= last_ts - INTERVAL 5 DAY THEN seq END)
              OVER (PARTITION BY run_id) AS first_seq
  FROM ranked WHERE r <= 21
)
SELECT run_id, seq FROM tail WHERE seq >= first_seq AND r <= 20
"""


def replay_from_id(spark: SparkSession, sf: str) -> DataFrame:
    """Replay of the bounded buffer after a last seen id; unknown ids replay everything."""
    held = replay_buffer(spark, sf)
    runs = tables.key_space(spark, sf, "events", "user_id", "1.25")
    asked = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("subscriber"),
        (F.col("c_custkey") % runs).cast("string").alias("run_id"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise((F.col("c_custkey") * 9).cast("string")).alias("last_id"),
    )
    return J.replay_from(held, asked).groupBy("subscriber").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )


_REPLAY_FROM = f"""
WITH held AS ({_BUFFER}),
asked AS (
  SELECT c_custkey AS subscriber, CAST(c_custkey % {_RUNS} AS VARCHAR) AS run_id,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 9 END AS last_id
  FROM customer
), known AS (
  SELECT subscriber, a.run_id, h.seq AS after_seq
  FROM asked a LEFT JOIN held h ON h.run_id = a.run_id AND h.seq = a.last_id
)
SELECT subscriber, count(*) AS n, min(seq) AS first_seq
FROM known k JOIN held h ON h.run_id = k.run_id AND (after_seq IS NULL OR h.seq > after_seq)
GROUP BY subscriber
"""


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-order deliveries: arrival = event id, sequence disturbed by the payload."""
    return tables.load(spark, sf, "events").select(
        F.col("user_id").alias("subscriber"),
        F.col("event_id").alias("arrival"),
        (F.col("event_id") - F.get_json_object("props", "$.k").cast("long") * 5).alias("seq"),
    )


def delivery_filter(spark: SparkSession, sf: str) -> DataFrame:
    cursors = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("subscriber"), F.col("c_custkey").alias("after_seq")
    )
    return J.monotone_delivery(_messages(spark, sf), cursors, bucket_rows=BUCKET)


_MESSAGES = """messages AS (
  SELECT user_id AS subscriber, event_id AS arrival,
         event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) * 5 AS seq
  FROM events
)"""

_DELIVERY = f"""
WITH {_MESSAGES}, seen AS (
  SELECT *, max(seq) OVER (PARTITION BY subscriber ORDER BY arrival
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM messages
)
SELECT subscriber, arrival, seq
FROM seen LEFT JOIN customer ON c_custkey = subscriber
WHERE seq > greatest(coalesce(c_custkey, 0), coalesce(top, 0))
"""


def replay_live_union(spark: SparkSession, sf: str) -> DataFrame:
    """Rows up to a split point come from the journal, overlapping rows also arrive live."""
    log = tables.load(spark, sf, "events").select(
        F.col("user_id").alias("subscriber"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("arrival"),
    )
    old = F.col("subscriber") * 20
    return J.replay_and_live(
        log.filter(F.col("seq") <= old + 1000), log.filter(F.col("seq") > old), bucket_rows=BUCKET
    )


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = tables.load(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("run_id"))
    hits = J.point_lookup(wanted, tables.runs(spark, sf), ["run_id"])
    return hits.groupBy("found", "status").agg(F.count(F.lit(1)).alias("n"))


def ndjson_export(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the retained journal. Some payloads repeat a key, which is valid; some have text
    behind their value, which ends their run's export."""
    kept = J.retained(tables.journal(spark, sf), BUDGET, bucket_rows=BUCKET)
    payload = (
        F.when(F.col("seq") % 11 == 3, F.regexp_replace("payload", r"^\{", '{"k": "twice",'))
        .when((F.col("seq") % 53 == 7) & (F.col("run_id") % 3 == 0), F.concat("payload", F.lit(" x")))
        .otherwise(F.col("payload"))
    )
    return ndjson_lines(kept.withColumn("payload", payload)).select("run_id", "seq", "line")


def payload_validity(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.journal(spark, sf)
    return log.groupBy("event_type").agg(
        F.count_if(is_json("payload")).alias("valid"), F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        journal_bytes, journal_admission, journal_retained, journal_evictions, journal_bounds,
        cursor_resume, journal_tail, journal_tail_hot, journal_range_scan, run_sequence, global_sequence,
        replay_buffer, replay_buffer_hot, replay_from_id, delivery_filter, replay_live_union, point_lookup,
        ndjson_export, payload_validity,
    )
}

SQL = {
    "journal_bytes": "SELECT CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS journal_bytes FROM events",
    "journal_admission": """
        SELECT CASE WHEN strlen(props) = 0 THEN 'payload_required'
                    WHEN strlen(props) > 8 THEN 'quota_exceeded' ELSE 'ok' END AS outcome,
               count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes
        FROM events GROUP BY 1""",
    "journal_retained": f"WITH {_KEPT} SELECT seq, run_id, event_type, payload FROM kept",
    "journal_evictions": f"""
        WITH {_KEPT}
        SELECT 'journal' AS kind, count(*) AS evictions,
               CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS evicted_bytes
        FROM events WHERE strlen(props) BETWEEN 1 AND {BUDGET}
          AND event_id NOT IN (SELECT seq FROM kept)""",
    "journal_bounds": f"""
        WITH {_KEPT}
        SELECT run_id, min(seq) AS earliest, max(seq) AS latest FROM kept GROUP BY run_id""",
    "cursor_resume": _RESUME,
    "journal_tail": _TAIL,
    "journal_tail_hot": """
        WITH log AS (SELECT event_id AS seq, event_type AS run_id FROM events),
             bounds AS (SELECT run_id, length(run_id) % 4 AS number, min(seq) AS lo, max(seq) AS hi FROM log GROUP BY ALL),
             asked AS (SELECT c_custkey AS subscriber, c_custkey % 4 AS number,
                              c_custkey * 37 % ((SELECT max(seq) FROM log) + 1) AS cur FROM customer),
             good AS (SELECT subscriber, run_id, cur FROM asked JOIN bounds USING (number)
                      WHERE NOT (cur > 0 AND lo > 0 AND (cur < lo OR cur > hi)))
        SELECT subscriber, run_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq
        FROM good JOIN log USING (run_id) WHERE seq > cur GROUP BY ALL""",
    "journal_range_scan": """
        SELECT event_id AS seq, event_type, props AS payload FROM events
        WHERE user_id = 42 AND event_id > 500 ORDER BY event_id""",
    "run_sequence": """
        SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS arrival,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run_seq
        FROM events""",
    "global_sequence": """
        SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS arrival,
               1000 + row_number() OVER (ORDER BY event_id) AS seq
        FROM events WHERE strlen(props) <= 8""",
    "replay_buffer": _BUFFER,
    "replay_buffer_hot": """
        WITH ranked AS (
          SELECT event_type AS run_id, event_id AS seq, ts,
                 row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r,
                 max_by(ts, event_id) OVER (PARTITION BY event_type) AS last_ts FROM events
        ), tail AS (
          SELECT *, min(CASE WHEN ts >= last_ts - INTERVAL 20 DAY THEN seq END) OVER (PARTITION BY run_id) AS first_seq
          FROM ranked WHERE r <= 1001
        )
        SELECT run_id, seq FROM tail WHERE seq >= first_seq AND r <= 1000""",
    "replay_from_id": _REPLAY_FROM,
    "delivery_filter": _DELIVERY,
    "replay_live_union": """
        WITH live AS (
          SELECT user_id AS subscriber, event_id AS seq FROM events
          WHERE event_id > user_id * 20 + 1000
        )
        SELECT user_id AS subscriber, event_id AS seq, 'replay' AS origin FROM events
        WHERE event_id <= user_id * 20 + 1000
        UNION ALL SELECT subscriber, seq, 'live' FROM live""",
    "point_lookup": """
        SELECT o_orderkey IS NOT NULL AS found,
               CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'completed'
                                  WHEN 'O' THEN 'failed' END AS status,
               count(*) AS n
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey * 2 GROUP BY ALL""",
    "ndjson_export": f"""
        WITH {_KEPT},
             body AS (SELECT run_id, seq, event_type, ts, CASE WHEN seq % 11 = 3
                             THEN '{{"k":"twice",' || substr(CAST(json(payload) AS VARCHAR), 2)
                             ELSE CAST(json(payload) AS VARCHAR) END AS payload,
                             seq % 11 <> 3 AND seq % 53 = 7 AND run_id::BIGINT % 3 = 0 AS bad FROM kept),
             stop AS (SELECT run_id, min(seq) AS cut FROM body WHERE bad GROUP BY run_id)
        SELECT run_id, seq,
               '{{"sequence":' || seq || ',"timestamp":"'
               || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), '\\.?0+$', '')
               || 'Z","event":"' || event_type || '","data":' || payload || '}}' AS line
        FROM body LEFT JOIN stop USING (run_id) WHERE cut IS NULL OR seq < cut""",
    "payload_validity": """
        SELECT event_type, count(*) FILTER (WHERE json_valid(props)) AS valid, count(*) AS n
        FROM events GROUP BY event_type""",
}
