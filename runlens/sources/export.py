"""Text exports: newline-delimited events and step reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.payload import compact_json, is_json
from runlens.functions.text import rfc3339_ms
from runlens.operators.journal import bounds


def ndjson_lines(journal: DataFrame) -> DataFrame:
    """One ``{sequence,timestamp,event,data}`` line per row; payload numbers stay as written.

    A payload that is no JSON ends its run's export, so rows from the first bad sequence of a
    run on are left out (the bad rows alone are grouped, not the journal).
    """
    name = F.to_json(F.array("event_type"))
    line = F.concat(
        F.lit('{"sequence":'), F.col("seq").cast("string"),
        F.lit(',"timestamp":"'), rfc3339_ms("ts"),
        F.lit('","event":'), name.substr(F.lit(2), F.length(name) - 2),
        F.lit(',"data":'), compact_json("payload"), F.lit("}"),
    )
    stop = journal.filter(~is_json("payload")).groupBy("run_id").agg(F.min("seq").alias("__stop"))
    return (
        journal.join(stop, "run_id", "left")
        .filter(F.col("__stop").isNull() | (F.col("seq") < F.col("__stop")))
        .withColumn("line", line)
        .drop("__stop")
    )


def export_status(run_ids: DataFrame, journal: DataFrame) -> DataFrame:
    """``expired`` for asked-for runs that hold no rows any more, else ``ok``."""
    held = bounds(journal).withColumn("status", F.lit("ok"))
    return run_ids.join(held, "run_id", "left").select(
        "run_id", F.coalesce("status", F.lit("expired")).alias("status")
    )


def write_ndjson(journal: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the lines ordered by (run, sequence).

    Range partitioning on both columns lets a hot run span several files.
    """
    lines = ndjson_lines(journal)
    ordered = (
        lines.repartitionByRange(partitions, "run_id", "seq")
        if partitions
        else lines.repartitionByRange("run_id", "seq")
    )
    ordered.sortWithinPartitions("run_id", "seq").select("line").write.text(path)


def write_step_report(results: DataFrame, path: str) -> None:
    """Step results as JSON lines."""
    results.write.json(path)
