"""Streaming jobs: ingest, live run state, delivery, admission, key/value quota, lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.operators.journal import BUFFER_EVENTS, BUFFER_SECONDS, resume_classes, resume_rows
from runlens.operators.keyed import NAMESPACE_MAX_BYTES, change_check, entry_bytes
from runlens.operators.requests import TTL_MS
from runlens.operators.runs import status_fold
from runlens.session import ROCKSDB_PROVIDER, scratch_path, setting, written
from runlens.streaming import processors as P
from runlens.streaming.commits import ZONE_ROWS, Sink, commit

# How late a request may arrive behind the newest one seen, with stored responses still in place.
LATENESS = "10 minutes"

# Groups of keys that a processor takes in one call each; a stream keeps the number it started with.
SLOTS = 1024

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch folder; a replayed batch overwrites its own folder only."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def journal_sink(
    path: str,
    *,
    arrival: str,
    max_bytes: int,
    downstream: Sequence[Sink | None] = (),
    zone_rows: int = ZONE_ROWS,
) -> Sink:
    """``foreachBatch`` writer into the journal store below ``path``: a commit per batch, then
    every downstream sink. Missing sinks are skipped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        commit(
            batch, path, arrival=arrival, max_bytes=max_bytes, downstream=downstream, zone_rows=zone_rows
        )

    return write


def table_sink(path: str) -> Sink:
    """Keep every batch in its own folder of ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(batch, path, batch_id)

    return write


def start(
    stream: DataFrame, sink: Sink, *, mode: str = "append", checkpoint: str | None = None
) -> StreamingQuery:
    """Run everything available now through ``sink``."""
    place = checkpoint or scratch_path(stream.sparkSession, "stream")
    with setting(stream.sparkSession, STATE_PROVIDER, ROCKSDB_PROVIDER):
        return (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", place)
            .foreachBatch(sink)
            .trigger(availableNow=True)
            .start()
        )


def drain(stream: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> str:
    """Run a stream to its end into a batch-partitioned table and return the table's path."""
    path = scratch_path(stream.sparkSession, name)
    start(stream, table_sink(path), mode=mode, checkpoint=checkpoint).awaitTermination()
    return path


def ingest(stream: DataFrame, path: str, *, arrival: str, max_bytes: int, **options) -> None:
    """Ingest a stream of events into the journal below ``path``."""
    start(stream, journal_sink(path, arrival=arrival, max_bytes=max_bytes, **options)).awaitTermination()


def live_run_state(reports: DataFrame) -> DataFrame:
    """Status fold over a stream (use update mode)."""
    return status_fold(reports)


def newest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current row per key of a table written in update mode."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
        .select(*keys, "__row.*")
    )


def _slot(slots: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("slot")


def deliver(
    events: DataFrame, subscriptions: DataFrame, sent: DataFrame | None = None, *, slots: int = SLOTS
) -> DataFrame:
    """Tail per (subscriber, run): stream of events against static ``after_seq`` cursors.

    ``sent`` (subscriber, run_id, after_seq) is the highest sequence a subscriber already has when
    the stream starts; it takes the place of the cursor.

    A subscriber gets the events above its start and above all that came before them in the run. The
    latter does not depend on the subscriber: the state is one number per run, kept in ``slots`` groups
    of runs, and only events that rise above it are joined with the subscriptions.
    """
    keys = ["subscriber", "run_id"]
    starts = subscriptions.groupBy(*keys).agg(F.min("after_seq").alias("__after"))
    if sent is not None:
        had = sent.groupBy(*keys).agg(F.max("after_seq").alias("__sent"))
        starts = starts.join(had, keys, "left").withColumn("__after", F.coalesce("__sent", "__after"))
    followed = events.join(subscriptions.select("run_id").distinct(), "run_id", "left_semi")
    rising = (
        followed.select(_slot(slots, "run_id"), "run_id", "arrival", "seq")
        .groupBy("slot")
        .transformWithStateInPandas(P.Delivery(), P.DELIVERY_SCHEMA, "append", "none")
    )
    met = rising.join(starts.select(*keys, "__after"), "run_id").filter(F.col("seq") > F.col("__after"))
    return met.select(*keys, "arrival", "seq")


def resume_and_tail(
    stored: DataFrame, live: DataFrame, cursors: DataFrame, path: str, *, checkpoint: str | None = None
) -> DataFrame:
    """Journal replay, then the live stream, per subscriber, each sequence once.

    ``cursors`` is (subscriber, run_id, cursor text), ``stored`` the journal as it is now, ``live``
    a stream of (run_id, arrival, seq) that may repeat stored events. Expired and invalid cursors get nothing, as
    their subscription is refused. Stored rows after the cursor are written first; the highest
    stored sequence of the run, or the cursor if that is higher, is where the stream starts for
    each subscriber, so both sides meet there. Started again from its checkpoint
    the stream goes on where it ended; the replay is written once.

    Returns (subscriber, run_id, seq, origin) below ``path``.
    """
    spark = stored.sparkSession
    followed = (
        resume_classes(cursors, stored)
        .filter("outcome = 'ok'")
        .select("subscriber", "run_id", "after_seq", F.greatest("after_seq", "latest").alias("sent"))
    )
    followed = written(followed, "followed")
    columns = ["subscriber", "run_id", "seq"]
    replay = resume_rows(cursors, stored).select(*columns, F.lit("replay").alias("origin"))
    if not _exists(spark, f"{path}/batch=-1"):
        _replace_batch(replay, path, -1)
    sent = followed.select("subscriber", "run_id", F.col("sent").alias("after_seq"))
    tail = deliver(live, followed, sent).select(*columns, F.lit("live").alias("origin"))
    start(tail, table_sink(path), checkpoint=checkpoint).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole table stands at ``path``."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def admit_requests(requests: DataFrame, ttl_ms: int = TTL_MS, *, lateness: str = LATENESS) -> DataFrame:
    """Idempotent admission of a stream of (key, endpoint, seq, ts, hash, valid).

    A stored response is dropped from the state by an event-time timer, once the watermark has passed its
    expiry: state holds the keys in use within ``ttl_ms`` and ``lateness``, not all keys ever seen.
    Rows further behind the newest ``ts`` than ``lateness`` are late and dropped, as no
    stored response is left to decide them by.
    """
    ts = F.col("ts").cast("timestamp")
    rows = requests.select(
        "key", "endpoint", "seq", ts.alias("ts"), F.unix_millis(ts).alias("ms"), "hash", "valid"
    ).withWatermark("ts", lateness)
    return rows.groupBy("key", "endpoint").transformWithStateInPandas(
        P.RequestAdmission(ttl_ms), P.REQUEST_SCHEMA, "append", "EventTime"
    )


def admit_changes(changes: DataFrame, limit: int = NAMESPACE_MAX_BYTES) -> DataFrame:
    rows = changes.select(
        "namespace", "ord", "k", "op", entry_bytes().alias("size"), change_check().alias("check")
    )
    return rows.groupBy("namespace").transformWithStateInPandas(
        P.KvQuota(limit), P.KV_SCHEMA, "append", "none"
    )


def lines(chunks: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """Lines of a stream of (run_id, channel, seq, chunk, last); open ones are held by ``slots`` groups."""
    rows = chunks.select(_slot(slots, "run_id", "channel"), "run_id", "channel", "seq", "chunk", "last")
    return rows.groupBy("slot").transformWithStateInPandas(
        P.LineAssembly(), P.LINE_SCHEMA, "append", "none"
    )


def recent_events(
    events: DataFrame, max_events: int = BUFFER_EVENTS, retention_seconds: int = BUFFER_SECONDS
) -> DataFrame:
    rows = events.select("run_id", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return rows.groupBy("run_id").transformWithStateInPandas(
        P.RecentEvents(max_events, retention_seconds * 1000), P.RECENT_SCHEMA, "append", "none"
    )
