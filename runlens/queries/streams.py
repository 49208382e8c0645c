"""Streaming jobs run to the end of their input; each equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.operators.logs import with_envelope
from runlens.queries.journal import BUDGET, CURSORS_SQL, SQL as JOURNAL_SQL, journal_cursors
from runlens.queries.keyed import QUOTA, SQL as KEYED_SQL, idem_sql
from runlens.queries.logs import SQL as LOG_SQL
from runlens.queries.runs import RUN_STATUS_SQL
from runlens.session import scratch_path
from runlens.streaming import commits
from runlens.streaming import jobs as S


BATCHES = 4
STREAM_TTL_MS = 86_400_000


def _stream(spark: SparkSession, sf: str, name: str, order: str) -> DataFrame:
    """A table arriving as a stream in ``BATCHES`` micro-batches, by ranges of a long column."""
    rows = tables.load(spark, sf, name)
    path = scratch_path(spark, f"arrivals-{name}")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // BATCHES + 1
    for i in range(BATCHES):
        first = (low or 0) + i * step
        part = rows.filter((F.col(order) >= first) & (F.col(order) < first + step))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_run_state(spark: SparkSession, sf: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "P", "running")
        .when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("failed")
    )
    reports = _stream(spark, sf, "orders", "o_orderkey").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"),
        status.alias("status"), F.col("o_orderdate").alias("ts"),
    )
    path = S.drain(S.live_run_state(reports), "run-state", mode="update")
    return S.newest_per_key(spark, path, ["run_id"])


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "events", "event_id").select(
        F.col("event_id").alias("arrival"), F.col("user_id").cast("string").alias("run_id"),
        "event_type", F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("ts"),
    )


def stream_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest all events, rows above eight payload bytes refused, and fan out a global feed."""
    base = scratch_path(spark, "journal")
    feed = S.table_sink(f"{base}/feed")
    S.ingest(
        _arrivals(spark, sf), base, arrival="arrival", max_bytes=8,
        downstream=[None, lambda batch, batch_id: feed(with_envelope(batch), batch_id)],
    )
    return spark.read.parquet(f"{base}/feed").select("seq", "run_id", "arrival", "payload")


def _store(spark: SparkSession, sf: str) -> str:
    """All events in a journal store, ingested in several commits with small zones."""
    base = scratch_path(spark, "store")
    S.ingest(_arrivals(spark, sf), base, arrival="arrival", max_bytes=BUDGET, zone_rows=1000)
    return base


def store_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Retention by the zone table: only the newest zones are read."""
    kept = commits.retained(spark, _store(spark, sf), BUDGET)
    return kept.select(F.col("arrival").alias("seq"), "run_id", "event_type", "payload")


def store_evictions(spark: SparkSession, sf: str) -> DataFrame:
    return commits.evictions(spark, _store(spark, sf), BUDGET)


def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of the journal is stored, the last three fifths arrive live; every customer
    follows a run from a cursor."""
    stored = tables.journal(spark, sf)
    last = stored.agg(F.max("seq")).scalar()
    live = _stream(spark, sf, "events", "event_id").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("arrival"),
        F.col("event_id").alias("seq"),
    )
    cursors = journal_cursors(spark, sf)
    return S.resume_and_tail(
        stored.filter(F.col("seq") * 2 < last), live.filter(F.col("seq") * 5 >= last * 2), cursors,
        scratch_path(spark, "followed"),
    )


def stream_idem(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's requests under one key, answered for a day; expired responses leave the state."""
    rows = _stream(spark, sf, "events", "event_id").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"),
        F.lit("POST /runs").alias("endpoint"), F.col("event_id").alias("seq"), "ts",
        F.col("event_type").alias("hash"), (F.col("event_type") != "error").alias("valid"),
    )
    path = S.drain(S.admit_requests(rows, STREAM_TTL_MS), "requests")
    return spark.read.parquet(path).drop("batch")


def stream_kv(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "documents", "doc_id").select(
        F.col("doc_id").alias("ord"), F.col("lang").alias("namespace"),
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("k"),
        F.col("text").alias("v"), F.lit("put").alias("op"),
    )
    path = S.drain(S.admit_changes(rows, QUOTA), "kv")
    return spark.read.parquet(path).drop("batch")


def stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    ends = tables.load(spark, sf, "conversations").groupBy("conv_id", "role").agg(
        F.max("turn").alias("end")
    )
    chunks = (
        _stream(spark, sf, "conversations", "turn")
        .join(ends, ["conv_id", "role"])
        .select(
            F.col("conv_id").alias("run_id"), F.col("role").alias("channel"),
            F.col("turn").alias("seq"), F.col("text").alias("chunk"),
            (F.col("turn") == F.col("end")).alias("last"),
        )
    )
    return spark.read.parquet(S.drain(S.lines(chunks), "lines")).drop("batch")


def stream_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Every run is tailed by two subscribers with different cursors."""
    events = _stream(spark, sf, "events", "event_id").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("arrival"),
        (F.col("event_id") - F.get_json_object("props", "$.k").cast("long") * 5).alias("seq"),
    )
    cursors = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("subscriber"),
        F.expr("c_custkey div 2").cast("string").alias("run_id"),
        F.col("c_custkey").alias("after_seq"),
    )
    return spark.read.parquet(S.drain(S.deliver(events, cursors), "delivery")).drop("batch")


def stream_recent(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded buffer of each run after the last event."""
    events = _stream(spark, sf, "events", "event_id").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "ts"
    )
    path = S.drain(S.recent_events(events, 20, 5 * 86400), "recent")
    rows = spark.read.parquet(path)
    newest = rows.groupBy("run_id").agg(F.max("newest").alias("newest"))
    return rows.join(newest, ["run_id", "newest"], "left_semi").select("run_id", "seq")


QUERIES = {
    f.__name__: f
    for f in (
        stream_run_state, stream_journal, stream_resume, stream_idem, stream_kv, stream_lines,
        stream_delivery, stream_recent, store_retained, store_evictions,
    )
}

SQL = {
    "stream_run_state": RUN_STATUS_SQL,
    "stream_journal": """
        SELECT row_number() OVER (ORDER BY event_id) AS seq, CAST(user_id AS VARCHAR) AS run_id,
               event_id AS arrival,
               '{"k":' || json_extract_string(props, '$.k') || ',"run_id":"' || user_id || '"}' AS payload
        FROM events WHERE strlen(props) BETWEEN 1 AND 8""",
    "stream_idem": idem_sql("'user-' || user_id", STREAM_TTL_MS),
    "stream_resume": f"""
        WITH {CURSORS_SQL},
             last AS (SELECT max(event_id) AS top FROM events),
             stored AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq FROM events, last
                        WHERE event_id * 2 < top),
             bounds AS (SELECT run_id, min(seq) AS earliest, max(seq) AS latest FROM stored GROUP BY run_id),
             followed AS (SELECT subscriber, c.run_id, after_seq FROM cursors c LEFT JOIN bounds b USING (run_id)
                          WHERE after_seq <= 0 OR (after_seq > 0 AND (earliest IS NULL OR earliest <= 0
                                OR after_seq BETWEEN earliest AND latest)))
        SELECT subscriber, f.run_id, event_id AS seq,
               CASE WHEN event_id * 2 < top THEN 'replay' ELSE 'live' END AS origin
        FROM followed f JOIN events e ON CAST(e.user_id AS VARCHAR) = f.run_id AND event_id > after_seq, last""",
    "store_retained": JOURNAL_SQL["journal_retained"],
    "store_evictions": JOURNAL_SQL["journal_evictions"],
    "stream_kv": KEYED_SQL["kv_admission"],
    "stream_lines": LOG_SQL["log_lines"],
    "stream_delivery": """
        WITH messages AS (
          SELECT c_custkey AS subscriber, CAST(user_id AS VARCHAR) AS run_id, event_id AS arrival,
                 event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) * 5 AS seq,
                 c_custkey AS after_seq
          FROM events JOIN customer ON c_custkey // 2 = user_id
        ), seen AS (
          SELECT *, max(seq) OVER (PARTITION BY subscriber ORDER BY arrival
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
          FROM messages
        )
        SELECT subscriber, run_id, arrival, seq FROM seen
        WHERE seq > greatest(after_seq, coalesce(top, after_seq))""",
    "stream_recent": """
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
        SELECT run_id, seq FROM tail WHERE seq >= first_seq AND r <= 20""",
}
