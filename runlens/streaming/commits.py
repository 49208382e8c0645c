"""Journal store: events ingested in commits, each fixed by a manifest.

Layout below one folder::

    events/commit=<c>/zone=<z>/   admitted rows with their sequence
    refused/commit=<c>/           refused rows with the reason
    manifest/commit=<c>/          a row per zone of the commit: rows, bytes, sequence range, marks
    fanout/sink=<s>/commit=<c>/   a row once sink ``s`` has taken commit ``c``

A commit exists when its manifest does: readers take the folders that manifests name, so what a
failed attempt left behind is never seen, and the next attempt overwrites it. Whether rows are
new is decided by the manifests' arrival mark and not by a batch number. A replayed batch, or a
stream that starts anew because its checkpoint is lost, therefore adds nothing twice and numbers on where the
last commit ended. Downstream sinks run after the manifest, from the stored rows; a sink that
failed, or that the ingest never reached, gets its missing commits before the next one.

The manifest rows are the zone table too: byte-budget retention walks it from the newest zone on
and reads only the folders it keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.operators.journal import append_outcome, assign_seq, payload_bytes, truncate_ms

Sink = Callable[[DataFrame, int], None]

# Sequences in a zone, the unit of pruning.
ZONE_ROWS = 1 << 20

ZONES = (
    "zone long, rows long, bytes long, largest long, low long, high long, "
    "arrival_high long, seq_high long, refused long, skipped long, commit long"
)
_DONE = "done boolean, sink int, commit long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def zones(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows of all commits; a commit without admitted rows has one with a null zone."""
    return _read(spark, f"{path}/manifest", ZONES)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The committed events, with ``seq``, ``bytes``, ``zone`` and ``commit``."""
    committed = zones(spark, path).agg(F.max("commit")).scalar()
    return spark.read.parquet(f"{path}/events").filter(F.col("commit") <= committed)


def refused(spark: SparkSession, path: str) -> DataFrame:
    committed = zones(spark, path).agg(F.max("commit")).scalar()
    return spark.read.parquet(f"{path}/refused").filter(F.col("commit") <= committed)


def _fan_out(spark: SparkSession, path: str, sinks: Sequence[Sink | None], schema) -> None:
    """Give every sink the commits it has no mark for, in order."""
    known = [r[0] for r in zones(spark, path).select("commit").distinct().orderBy("commit").collect()]
    marks = _read(spark, f"{path}/fanout", _DONE).select("sink", "commit").collect()
    done = {(r["sink"], r["commit"]) for r in marks}
    for commit in known:
        for number, sink in enumerate(sinks):
            if sink is None or (number, commit) in done:
                continue
            place = f"{path}/events/commit={commit}"
            sink(_read(spark, place, schema), commit)
            mark = spark.createDataFrame([(True,)], "done boolean")
            mark.write.mode("overwrite").parquet(f"{path}/fanout/sink={number}/commit={commit}")


def commit(
    batch: DataFrame,
    path: str,
    *,
    arrival: str,
    max_bytes: int,
    downstream: Sequence[Sink | None] = (),
    zone_rows: int = ZONE_ROWS,
) -> None:
    """Ingest one batch of ``(arrival, run_id, payload, ts, ...)``.

    ``arrival`` is a long that grows from batch to batch, like an offset: rows at or below the
    highest one committed are known and skipped. The batch is evaluated once. Refused are rows
    without run or payload, and payloads above ``max_bytes``. One writer per store.
    """
    spark = batch.sparkSession
    mark = zones(spark, path).agg(F.max("commit"), F.max("arrival_high"), F.max("seq_high")).first()
    number = 0 if mark[0] is None else mark[0] + 1
    outcome = F.when(F.col(arrival) <= F.lit(mark[1]), "known").otherwise(append_outcome(max_bytes))
    checked = batch.withColumn("outcome", F.coalesce(outcome, append_outcome(max_bytes))).persist()
    try:
        good = checked.filter(F.col("outcome") == "ok").drop("outcome")
        stamped = assign_seq(good, arrival, high_mark=int(mark[2] or 0))
        stamped = stamped.withColumns(
            {"ts": truncate_ms("ts"), "bytes": payload_bytes(), "zone": F.expr(f"seq div {int(zone_rows)}L")}
        )
        counts = checked.agg(
            F.max(arrival).alias("arrival_high"),
            F.count_if(~F.col("outcome").isin("ok", "known")).alias("refused"),
            F.count_if(F.col("outcome") == "known").alias("skipped"),
            F.count_if(F.col("outcome") != "known").alias("new"),
        ).first()
        if counts["new"]:
            place = f"commit={number}"
            stamped.write.mode("overwrite").partitionBy("zone").parquet(f"{path}/events/{place}")
            bad = checked.filter(~F.col("outcome").isin("ok", "known"))
            bad.write.mode("overwrite").parquet(f"{path}/refused/{place}")
            kept = _read(spark, f"{path}/events/{place}", "seq long, bytes long, zone long")
            per_zone = kept.groupBy("zone").agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum("bytes").alias("bytes"),
                F.max("bytes").alias("largest"),
                F.min("seq").alias("low"),
                F.max("seq").alias("high"),
            )
            before = int(mark[2] or 0)
            common = (counts["arrival_high"], counts["refused"], counts["skipped"])
            rows = [(*r, common[0], r["high"], *common[1:]) for r in per_zone.collect()]
            rows = rows or [(*[None] * 6, common[0], before, *common[1:])]
            manifest = spark.createDataFrame(rows, ZONES.removesuffix(", commit long"))
            # the one file of this write appears by a rename: the commit point
            manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{place}")
        if any(sink is not None for sink in downstream):
            _fan_out(spark, path, downstream, stamped.schema)
    finally:
        checked.unpersist()


def _edge(table: DataFrame, max_bytes: int) -> DataFrame:
    """(zone, newer): the zone in which the budget ends and the bytes of the zones after it."""
    newest_first = Window.orderBy(F.col("zone").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = table.filter("zone IS NOT NULL").groupBy("zone").agg(F.sum("bytes").alias("bytes"))
    return (
        totals.withColumn("newer", F.coalesce(F.sum("bytes").over(newest_first), F.lit(0)))
        .filter((F.col("newer") <= max_bytes) & (F.col("newer") + F.col("bytes") > max_bytes))
        .agg(F.max("zone").alias("zone"), F.max_by("newer", "zone").alias("newer"))
    )


def retention_cut(spark: SparkSession, path: str, max_bytes: int) -> tuple[int, int]:
    """(zone, seq): the lowest zone that is read and the lowest sequence inside the byte budget.

    The zone table gives the zone in which the budget ends; of that zone alone the sequences and
    byte counts are read, no payloads. ``max_bytes`` has to be at least what the rows were
    admitted with.
    """
    table = zones(spark, path)
    largest = table.agg(F.max("largest")).first()[0] or 0
    if largest > max_bytes:
        raise ValueError(f"the store holds a payload of {largest} bytes; the budget is {max_bytes}")
    zone, newer = _edge(table, max_bytes).first()
    if zone is None:
        return 0, 0
    inside = Window.orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = events(spark, path).filter(F.col("zone") == zone).select("seq", "bytes")
    seq = (
        rows.withColumn("used", F.sum("bytes").over(inside))
        .filter(F.col("used") + newer <= max_bytes)
        .agg(F.min("seq"))
        .first()[0]
    )
    if seq is not None:
        return zone, seq
    above = table.filter(F.col("zone") > zone).agg(F.min("zone"), F.min("low")).first()
    return (zone + 1, (1 << 63) - 1) if above[0] is None else tuple(above)


def retained(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Committed rows still held after byte-budget eviction; older zones are not read."""
    zone, seq = retention_cut(spark, path, max_bytes)
    return events(spark, path).filter((F.col("zone") >= zone) & (F.col("seq") >= seq))


def evictions(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Count and bytes of evicted rows, from the zone table and the cut zone's byte counts."""
    zone, seq = retention_cut(spark, path, max_bytes)
    older = zones(spark, path).filter(F.col("zone") < zone).select("rows", "bytes")
    cut = events(spark, path).filter((F.col("zone") == zone) & (F.col("seq") < seq))
    both = older.unionByName(cut.select(F.lit(1).cast("long").alias("rows"), "bytes"))
    return both.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("evictions"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("evicted_bytes"),
    ).select(F.lit("journal").alias("kind"), "evictions", "evicted_bytes")
