"""Run journal: admission, byte-budget retention, bounds, resume, replay, delivery.

Journal rows: ``seq LONG, run_id STRING, event_type STRING, payload STRING, ts TIMESTAMP``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import parse_cursor
from runlens.operators.running import BUCKET_ROWS, numbered, running

# Default journal budget, replay-buffer size and retention.
JOURNAL_MAX_BYTES = 64 * 1024 * 1024
BUFFER_EVENTS = 1000
# Smallest bucket of sequences by which a run's newest rows are found.
FINE_ROWS = 1024
BUFFER_SECONDS = 300
# Sequences in a bucket of the grid on which cursors meet rows.
GRID_ROWS = 1 << 12

_LONG_MIN = -(1 << 63)


def payload_bytes(col: str | Column = "payload") -> Column:
    return F.octet_length(F.col(col) if isinstance(col, str) else col).cast("long")


def append_outcome(max_bytes: int = JOURNAL_MAX_BYTES) -> Column:
    """Why an append is refused, or ``ok``. Checks run in this order."""
    size = payload_bytes()
    return (
        F.when(F.col("run_id").isNull() | (F.col("run_id") == ""), "run_id_required")
        .when(size.isNull() | (size == 0), "payload_required")
        .when(size > max_bytes, "quota_exceeded")
        .otherwise("ok")
    )


def admitted(journal: DataFrame, max_bytes: int = JOURNAL_MAX_BYTES) -> DataFrame:
    return journal.filter(append_outcome(max_bytes) == "ok")


def truncate_ms(col: str | Column = "ts") -> Column:
    """Timestamps are kept in whole milliseconds."""
    return F.date_trunc("MILLISECOND", F.col(col) if isinstance(col, str) else col)


def assign_seq(
    arrivals: DataFrame,
    arrival: str,
    *,
    high_mark: int | Column = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Global dense sequence in arrival order, continuing after ``high_mark``."""
    start = F.lit(high_mark) + 1 if isinstance(high_mark, int) else high_mark + 1
    return numbered(arrivals, [], arrival, "seq", start=start, bucket_rows=bucket_rows)


def run_sequence(
    events: DataFrame, arrival: str, *, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Per-run sequence in arrival order."""
    return numbered(events, ["run_id"], arrival, "run_seq", bucket_rows=bucket_rows)


def retention_cut(
    journal: DataFrame, max_bytes: int, *, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row ``cut``: the lowest sequence still inside the byte budget.

    Evicting oldest-first until each new payload fits leaves the longest suffix by sequence
    whose payload bytes stay within the budget. Bucket sums find the bucket the cut falls
    into; only that bucket is then read row by row (its range reaches the scan as a filter).
    """
    rows = admitted(journal, max_bytes).select("seq", payload_bytes().alias("bytes"))
    bucket = F.expr(f"seq div {int(bucket_rows)}L")
    totals = rows.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("bytes"))
    newest_first = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        totals.withColumn("newer", F.coalesce(F.sum("bytes").over(newest_first), F.lit(0)))
        .filter((F.col("newer") <= max_bytes) & (F.col("newer") + F.col("bytes") > max_bytes))
        .agg(F.max("b").alias("b"), F.max_by("newer", "b").alias("newer"))
        .select(
            (F.col("b") * bucket_rows).alias("low"),
            ((F.col("b") + 1) * bucket_rows).alias("high"),
            "newer",
        )
    )
    low, high, newer = (edge.select(c).scalar() for c in ("low", "high", "newer"))
    inside = Window.orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        rows.filter((F.col("seq") >= low) & (F.col("seq") < high))
        .withColumn("used", F.sum("bytes").over(inside))
        .filter(F.col("used") + newer <= max_bytes)
        .agg(F.min("seq").alias("seq"))
    )
    return kept.select(F.coalesce(F.col("seq"), high, F.lit(_LONG_MIN)).alias("cut"))


def retained(
    journal: DataFrame,
    max_bytes: int = JOURNAL_MAX_BYTES,
    *,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rows still held after byte-budget eviction."""
    cut = retention_cut(journal, max_bytes, bucket_rows=bucket_rows)
    return admitted(journal, max_bytes).filter(F.col("seq") >= cut.scalar())


def evictions(
    journal: DataFrame,
    max_bytes: int = JOURNAL_MAX_BYTES,
    *,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Count and bytes of evicted rows (the complement of :func:`retained`)."""
    cut = retention_cut(journal, max_bytes, bucket_rows=bucket_rows)
    return (
        admitted(journal, max_bytes)
        .filter(F.col("seq") < cut.scalar())
        .agg(
            F.count(F.lit(1)).alias("evictions"),
            F.coalesce(F.sum(payload_bytes()), F.lit(0)).alias("evicted_bytes"),
        )
        .select(F.lit("journal").alias("kind"), "evictions", "evicted_bytes")
    )


def total_bytes(journal: DataFrame) -> DataFrame:
    return journal.agg(F.coalesce(F.sum(payload_bytes()), F.lit(0)).alias("journal_bytes"))


def bounds(journal: DataFrame) -> DataFrame:
    """Lowest and highest retained sequence per run."""
    return journal.groupBy("run_id").agg(
        F.min("seq").alias("earliest"), F.max("seq").alias("latest")
    )


def range_scan(journal: DataFrame, run_id: str, after_seq: int = 0) -> DataFrame:
    """Events of one run strictly after a sequence; both predicates reach the scan."""
    return journal.filter((F.col("run_id") == run_id) & (F.col("seq") > after_seq)).orderBy("seq")


def resume_classes(cursors: DataFrame, journal: DataFrame) -> DataFrame:
    """Classify ``cursors(run_id, cursor STRING)`` as ok, expired or invalid.

    A positive cursor is expired when the run holds rows and the cursor lies outside their
    bounds. Runs without rows, and cursors of zero or less, are ok.
    """
    seq = parse_cursor("cursor")
    known = F.col("earliest") > 0
    outside = (F.col("after_seq") < F.col("earliest")) | (F.col("after_seq") > F.col("latest"))
    return (
        cursors.withColumn("after_seq", seq)
        .join(bounds(journal), "run_id", "left")
        .withColumns(
            {
                "earliest": F.coalesce("earliest", F.lit(0)),
                "latest": F.coalesce("latest", F.lit(0)),
            }
        )
        .withColumn(
            "outcome",
            F.when(F.col("after_seq").isNull(), "invalid")
            .when((F.col("after_seq") > 0) & known & outside, "expired")
            .otherwise("ok"),
        )
    )


def _resumable(cursors: DataFrame, journal: DataFrame, bucket_rows: int) -> DataFrame:
    """(subscriber, run_id, after_seq, __b): ``ok`` cursors and the bucket they lie in."""
    good = resume_classes(cursors, journal).filter(F.col("outcome") == "ok")
    bucket = F.expr(f"after_seq div {int(bucket_rows)}L")
    return good.select("subscriber", "run_id", "after_seq", bucket.alias("__b"))


def resume_grid(cursors: DataFrame, journal: DataFrame, bucket_rows: int = GRID_ROWS) -> DataFrame:
    """(subscriber, run_id, after_seq, __b): every bucket of its run a cursor still has rows in.

    Later buckets than the cursor's are wanted whole. Only bucket numbers are paired here, a
    ``bucket_rows``-th of the rows.
    """
    good = _resumable(cursors, journal, bucket_rows).withColumnRenamed("__b", "__from")
    held = journal.select("run_id", F.expr(f"seq div {int(bucket_rows)}L").alias("__b")).distinct()
    return good.join(held, "run_id").filter(F.col("__b") >= F.col("__from")).drop("__from")


def resume_rows(cursors: DataFrame, journal: DataFrame, *, bucket_rows: int = GRID_ROWS) -> DataFrame:
    """Journal rows each ``ok`` cursor still has to see (subscriber, run_id, cursor).

    Rows meet cursors on (run, bucket of sequences), in the buckets where a cursor has rows left. Of
    the rows formed only those in a cursor's own bucket can be too many, so the join makes no more
    than its output and ``bucket_rows`` per cursor, and a hot run is spread over its buckets.
    """
    wanted = resume_grid(cursors, journal, bucket_rows)
    rows = journal.withColumn("__b", F.expr(f"seq div {int(bucket_rows)}L"))
    met = rows.join(wanted, ["run_id", "__b"]).filter(F.col("seq") > F.col("after_seq"))
    return met.select(*journal.columns, "subscriber")


def resume_counts(cursors: DataFrame, journal: DataFrame, *, bucket_rows: int = GRID_ROWS) -> DataFrame:
    """(subscriber, run_id, n, first_seq, last_seq) of the rows of ``resume_rows``, without them.

    Totals per (run, bucket), added up from the newest down, answer for all buckets after a cursor's
    own; rows are met in that bucket only. Cursors without rows left are left out.
    """
    good = _resumable(cursors, journal, bucket_rows)
    rows = journal.select("run_id", "seq", F.expr(f"seq div {int(bucket_rows)}L").alias("__b"))
    totals = rows.groupBy("run_id", "__b").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")
    )
    none = F.lit(None).cast("long")
    marks = good.select("run_id", "__b", F.lit(0).cast("long").alias("n"), none.alias("lo"), none.alias("hi"))
    every = totals.unionByName(marks).groupBy("run_id", "__b").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    newer = Window.partitionBy("run_id").orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = every.select(
        "run_id", "__b", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("__n"),
        F.min("lo").over(newer).alias("__lo"), F.max("hi").over(newer).alias("__hi"),
    )
    edge = (
        rows.join(good, ["run_id", "__b"])
        .filter(F.col("seq") > F.col("after_seq"))
        .groupBy("subscriber", "run_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    )
    joined = good.join(after, ["run_id", "__b"]).join(edge, ["subscriber", "run_id"], "left")
    return joined.select(
        "subscriber",
        "run_id",
        (F.col("__n") + F.coalesce("n", F.lit(0))).alias("n"),
        F.coalesce("lo", "__lo").alias("first_seq"),
        F.coalesce("__hi", "hi").alias("last_seq"),
    ).filter("n > 0")


def _start_of_newest(rows: DataFrame, limit: int, size: int) -> DataFrame:
    """(run_id, __start): from here on lie at least the newest ``limit`` rows of a run.

    Whole buckets of ``size`` sequences are counted on the map side and kept from the newest down
    until they hold enough.
    """
    newer = Window.partitionBy("run_id").orderBy(F.col("__b").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = rows.groupBy("run_id", F.expr(f"seq div {int(size)}L").alias("__b")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    needed = counts.withColumn("__newer", F.coalesce(F.sum("__n").over(newer), F.lit(0)))
    return (
        needed.filter(F.col("__newer") < limit)
        .groupBy("run_id")
        .agg((F.min("__b") * size).alias("__start"))
    )


def replay_buffer(
    events: DataFrame,
    *,
    max_events: int = BUFFER_EVENTS,
    retention_seconds: int = BUFFER_SECONDS,
    now: Column | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Events a per-run bounded buffer holds after its last add.

    On every add the buffer drops the leading events older than ``now - retention`` and then
    keeps the newest ``max_events``. ``now`` defaults to the run's newest event. The closed
    form looks at the newest ``max_events + 1`` rows of a run, starts at the first of them
    inside the retention, and keeps ``max_events``. Row counts per (run, bucket of sequences),
    first coarse, then fine, give a sequence from which a run's newest ``max_events + 1`` rows
    are complete, so the final window sees at most ``max_events`` and one fine bucket more.
    """
    limit = max_events + 1
    newest = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
    whole = Window.partitionBy("run_id")
    held = events
    for size in (bucket_rows, min(bucket_rows, max(FINE_ROWS, max_events))):
        start = _start_of_newest(held.select("run_id", "seq"), limit, size)
        held = events.join(start, "run_id").filter(F.col("seq") >= F.col("__start")).drop("__start")
    tail = held.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= limit)
    last = now if now is not None else F.max_by("ts", "seq").over(whole)
    cutoff = last - F.make_dt_interval(secs=F.lit(retention_seconds))
    return (
        tail.withColumn("__cutoff", cutoff)
        .withColumn(
            "__first",
            F.min(F.when(F.col("ts") >= F.col("__cutoff"), F.col("seq"))).over(whole),
        )
        .filter((F.col("seq") >= F.col("__first")) & (F.col("__r") <= max_events))
        .select(*events.columns)
    )


def replay_from(buffer: DataFrame, last_ids: DataFrame) -> DataFrame:
    """Replay a buffer per (subscriber, run_id, last_id).

    Events after ``last_id`` are sent; an empty or unknown id replays everything held.
    """
    asked = last_ids.withColumn("__seq", F.expr("try_cast(last_id AS BIGINT)"))
    hit = (
        asked.join(
            buffer.select("run_id", F.col("seq").alias("__seq"), F.lit(True).alias("__held")),
            ["run_id", "__seq"],
            "left",
        )
        .select(
            "subscriber",
            "run_id",
            F.when(F.col("__held"), F.col("__seq")).alias("__after"),
        )
    )
    return (
        buffer.join(hit, "run_id")
        .filter(F.col("__after").isNull() | (F.col("seq") > F.col("__after")))
        .drop("__after")
    )


def monotone_delivery(
    messages: DataFrame,
    cursors: DataFrame | None = None,
    *,
    keys: tuple[str, ...] = ("subscriber",),
    arrival: str = "arrival",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Drop messages whose sequence is not above the highest already sent.

    ``messages`` carry keys, ``arrival LONG`` and ``seq LONG``; ``cursors`` give the
    sequence each subscriber starts after.
    """
    seen = running(
        messages, keys, arrival, {"__top": ("max", F.col("seq"))}, before=True,
        bucket_rows=bucket_rows,
    )
    if cursors is not None:
        start = cursors.select(*keys, F.col("after_seq").alias("__start"))
        seen = seen.join(start, list(keys), "left")
    else:
        seen = seen.withColumn("__start", F.lit(0).cast("long"))
    floor = F.greatest(F.col("__top"), F.coalesce("__start", F.lit(0).cast("long")))
    return seen.filter(F.col("seq") > floor).select(*messages.columns)


def replay_and_live(
    replay: DataFrame,
    live: DataFrame,
    *,
    keys: tuple[str, ...] = ("subscriber",),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Journal replay followed by live messages, each sequence delivered once.

    Replayed rows come in sequence order. A live row is sent when it lies above everything
    replayed and above every earlier live row, so only the live side needs a running maximum;
    the replay side contributes its highest sequence per subscriber.
    """
    keys = list(keys)
    top = replay.groupBy(*keys).agg(F.max("seq").alias("after_seq"))
    sent = monotone_delivery(live, top, keys=tuple(keys), bucket_rows=bucket_rows)
    columns = [c for c in replay.columns if c in live.columns and c != "arrival"]
    return replay.select(*columns, F.lit("replay").alias("origin")).unionByName(
        sent.select(*columns, F.lit("live").alias("origin"))
    )


def point_lookup(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Exact-key lookups for a table of keys; ``found`` is false on a miss."""
    marked = table.withColumn("found", F.lit(True))
    return keys.join(marked, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
